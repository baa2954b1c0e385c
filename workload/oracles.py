"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from textrisk.functions import labels, risk, rules
from textrisk.functions.normalize import EXOTIC_SPACES, ZERO_WIDTH
from textrisk.operators.features import CHAR_BLOCK, WORD_BLOCK
from textrisk.operators.metrics import SELECTION_RULE
from textrisk.operators.multiset import DIGESTS, HEX, PER_DIGEST
from textrisk.operators.models import EMBEDDING_C, EMBEDDING_MODEL, TFIDF_C, TFIDF_MODEL
from workload.overlay import LEADS
from workload.queries import HEURISTIC_THRESHOLD, KEYWORDS, ML_THRESHOLD, OTHER_KEYWORDS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):04X}}}" for c in chars)


def _lead(number: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(lead)}" for i, lead in enumerate(LEADS))
    return f"CASE ({number}) % {len(LEADS)} {whens} END"


OVERLAY = f'SELECT doc_id AS "Id", {_lead("doc_id")} || text AS text, lang FROM documents'
LABELED_OVERLAY = f"SELECT o.* FROM ({OVERLAY}) o JOIN labels l ON l.doc_id = o.\"Id\""

# ---- rules in RE2: no look-around and an ASCII-only word boundary -------------------------

_NOT_WORD = r"[^\p{L}\p{N}_]"


def _gap(match: re.Match) -> str:
    # Text between two words: one non-word character, or two with the rest of the gap inside.
    return f"(?:{_NOT_WORD}|{_NOT_WORD}.{{0,{int(match.group(1)) - 2}}}{_NOT_WORD})"


def _body(pattern: str) -> str:
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return re.sub(r"\\b\.\{0,(\d+)\}\\b", _gap, inner) + f"(?:$|{_NOT_WORD})"


def hit_sql(pattern: str, column: str) -> str:
    return f"regexp_matches({column}, {q(f'(?s)(?:^|{_NOT_WORD}){_body(pattern)}')})"


def unnegated_sql(pattern: str, column: str) -> str:
    before = f"regexp_extract({column}, {q(f'(?s)^((?:.*?{_NOT_WORD})??){_body(pattern)}')}, 1)"
    negator = q("(?:" + "|".join(rules.NEGATORS) + r")\s*$")
    return (
        f"({hit_sql(pattern, column)} AND NOT regexp_matches("
        f"right({before}, {rules.NEGATION_REACH}), {negator}))"
    )


def family_sql(family: rules.RuleFamily, column: str) -> str:
    sql = unnegated_sql if family.rule_id == rules.NEGATABLE_RULE else hit_sql
    return f"({sql(family.english, column)} OR {sql(family.vietnamese, column)})"


# ---- the scan, as common table expressions ------------------------------------------------

_ZW, _SP = _class(ZERO_WIDTH), _class(EXOTIC_SPACES)


def _keep(char_class: str) -> str:
    return f"length(regexp_replace(text, '[^{char_class}]', '', 'g'))"


def _listed(items: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN {value} END" for cond, value in items)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def scan_ctes(source: str, keywords: tuple[str, ...] = KEYWORDS, high=0.96, low=0.05) -> str:
    """``scored``: every column of the scan for ``source``, which has Id and text."""
    families = rules.RULE_FAMILIES
    hits = ", ".join(f"{family_sql(f, 'comparison_text')} AS hit{i}" for i, f in enumerate(families))
    hit_names = [(f"hit{i}", q(f.rule_id)) for i, f in enumerate(families)]
    hit_reasons = [(f"hit{i}", q(f.reason)) for i, f in enumerate(families)]
    hit_weights = [(f"hit{i}", f"{f.weight}::DOUBLE") for i, f in enumerate(families)]
    signals = [
        ("zw > 0", "'zero_width_characters:' || zw"),
        ("ctl > 0", "'control_characters:' || ctl"),
        ("sp > 0", "'unusual_whitespace:' || sp"),
        ("mixed", "'mixed_latin_confusable_scripts'"),
        ("marks >= 4 AND marks / greatest(length(text), 1) > 0.08", "'dense_combining_marks:' || marks"),
    ]
    keyword = " OR ".join(f"contains(lower(normalized_text), {q(k)})" for k in keywords)
    return f"""
WITH src AS ({source}),
counted AS (
  SELECT *, {_keep(_ZW)} AS zw, {_keep(_SP)} AS sp,
    {_keep(r'\p{Cc}\p{Cf}')} - {_keep(r'\n\r\t')} - {_keep(_ZW)} AS ctl,
    {_keep(r'\x{0300}-\x{036F}')} AS marks,
    nfc_normalize(regexp_replace(regexp_replace(
      replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
      '[{_SP}]', ' ', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\p{{Cf}}]', '', 'g')) AS composed
  FROM src),
normalized AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(composed, '[ \\t]+', ' ', 'g'),
    ' *\\n *', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS normalized_text FROM counted),
compared AS (
  SELECT *, replace(lower(normalized_text), 'ß', 'ss') AS comparison_text,
    regexp_matches(normalized_text, '\\p{{Latin}}')
      AND regexp_matches(normalized_text, '[\\p{{Cyrillic}}\\p{{Greek}}]') AS mixed
  FROM normalized),
hits AS (SELECT *, {hits} FROM compared),
parts AS (
  SELECT *, {_listed(hit_names)} AS matched_rules, {_listed(hit_reasons)} AS rule_reasons,
    {_listed(hit_weights)} AS weights, {_listed(signals)} AS signals,
    least(1.0::DOUBLE, CASE WHEN zw > 0 THEN 0.25::DOUBLE ELSE 0 END
      + CASE WHEN ctl > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN sp > 0 THEN 0.1::DOUBLE ELSE 0 END
      + CASE WHEN mixed THEN 0.45::DOUBLE ELSE 0 END
      + CASE WHEN marks >= 4 THEN 0.2::DOUBLE ELSE 0 END) AS unicode_score,
    CASE WHEN {keyword} THEN {high}::DOUBLE ELSE {low}::DOUBLE END AS ml
  FROM hits),
weighted AS (
  SELECT *, CASE WHEN len(weights) = 0 THEN 0::DOUBLE ELSE round(least(1.0::DOUBLE, list_max(weights)
    + least({rules.FAMILY_CAP}::DOUBLE, {rules.FAMILY_STEP}::DOUBLE * (len(weights) - 1))), 6) END
    AS heuristic_score FROM parts),
blended AS (
  SELECT *, 0.62::DOUBLE * ml + 0.30::DOUBLE * heuristic_score + 0.08::DOUBLE * unicode_score AS risk
  FROM weighted),
decided AS (
  SELECT *, CASE WHEN risk >= 0.72 THEN 'block' WHEN risk >= 0.45 THEN 'warn_sanitize' ELSE 'allow' END
    AS decision FROM blended),
reasoned AS (
  SELECT *, list_concat(list_concat(CASE WHEN ml >= 0.5 THEN [{q(risk.ML_REASON)}] ELSE [] END,
    rule_reasons), list_transform(signals, lambda s: replace(s, '_', ' '))) AS found FROM decided),
scored AS (
  SELECT *, round(ml, 6) AS ml_score, round(risk, 6) AS risk_score,
    CASE decision WHEN 'block' THEN 'HIGH RISK' WHEN 'warn_sanitize' THEN 'MEDIUM RISK'
      ELSE 'LOW RISK' END AS risk_level,
    CASE WHEN len(found) > 0 THEN found ELSE [{q(risk.NO_REASON)}] END AS reason_list,
    CASE WHEN decision = 'warn_sanitize' THEN {q(risk.WRAP_HEADER)} || chr(10) || normalized_text
      || chr(10) || {q(risk.WRAP_FOOTER)} END AS sanitized_text
  FROM reasoned)
"""


def _scan(select: str, source: str = OVERLAY, tail: str = "") -> str:
    return f"{scan_ctes(source)} SELECT {select} FROM scored {tail}"


_FLAT = """risk_score, ml_score, heuristic_score, unicode_score, decision,
  CAST(to_json(reason_list) AS VARCHAR) AS reasons"""


def _flat(source: str = OVERLAY, id_col: str = "Id") -> str:
    return _scan(f'"Id" AS "{id_col}", {_FLAT}', source)


# ---- metrics ------------------------------------------------------------------------------


def _div(part: str, whole: str) -> str:
    return f"round(CASE WHEN ({whole}) = 0 THEN 0 ELSE ({part})::DOUBLE / ({whole}) END, 9)"


_RATIOS = f"""{_div('tn + tp', 'tn + fp + fn + tp')} AS accuracy,
  {_div('tp', 'tp + fp')} AS precision_jailbreak,
  {_div('tp', 'tp + fn')} AS recall_jailbreak,
  {_div('2 * tp', '2 * tp + fp + fn')} AS f1_jailbreak,
  {_div('fp', 'fp + tn')} AS false_positive_rate,
  {_div('fn', 'fn + tp')} AS false_negative_rate"""

_UNSCORED = "count(*) FILTER (target IS NULL OR prediction IS NULL) AS unscored_rows"
_CELLS = """count(*) FILTER (target = 0 AND prediction = 0) AS tn,
  count(*) FILTER (target = 0 AND prediction = 1) AS fp,
  count(*) FILTER (target = 1 AND prediction = 0) AS fn,
  count(*) FILTER (target = 1 AND prediction = 1) AS tp"""

_SUPPORT = "tn + fp AS support_benign, fn + tp AS support_jailbreak"


def _auc(rows: str, key: str) -> str:
    """Mann-Whitney AUC per key from tie-averaged ranks."""
    return f"""
  SELECT {key}, CASE WHEN p = 0 OR n = 0 THEN NULL
    ELSE round((rank_sum - p * (p + 1) / 2.0) / (p::DOUBLE * n), 9) END AS roc_auc
  FROM (SELECT {key}, sum(CASE WHEN target = 1 THEN avg_rank ELSE 0 END)::DOUBLE AS rank_sum,
      count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n
    FROM (SELECT {key}, target, rank() OVER (PARTITION BY {key} ORDER BY score)
        + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0 AS avg_rank FROM {rows}) GROUP BY {key})"""


def _scored_metrics(ctes: str, rows: str, key: str | None) -> str:
    """Metrics with AUC of CTE ``rows`` (target, prediction, score and the key)."""
    k = key or "one"
    shown = f"{k}, " if key else ""
    return f"""{ctes},
keyed AS (SELECT *{'' if key else ', 1 AS one'} FROM {rows}),
cells AS (SELECT {k}, {_CELLS}, {_UNSCORED} FROM keyed GROUP BY {k}),
auc AS ({_auc('keyed', k)})
SELECT {shown}tn, fp, fn, tp, {_RATIOS}, {_SUPPORT}, unscored_rows, roc_auc FROM cells JOIN auc USING ({k})"""


def _tied(factor: int = 37, modulus: int = 101) -> str:
    return (
        f'SELECT CAST(doc_id AS VARCHAR) AS "Id", toxic AS target, '
        f"(doc_id * {factor} % {modulus}) / 100.0::DOUBLE AS score FROM labels"
    )


def _sweep(scores: str) -> str:
    return f"""
  SELECT threshold, {_CELLS} FROM (
    SELECT target, t / 100.0::DOUBLE AS threshold, (score >= t / 100.0::DOUBLE)::INT AS prediction
    FROM ({scores}) s, range(20, 81) r(t)) GROUP BY threshold"""


def _best(scores: str) -> str:
    return f"""SELECT threshold, tn, fp, fn, tp, {_RATIOS} FROM ({_sweep(scores)})
  ORDER BY f1_jailbreak DESC, recall_jailbreak DESC, false_positive_rate, threshold DESC LIMIT 1"""


# ---- evaluation ---------------------------------------------------------------------------

_OUTCOME = (
    scan_ctes(LABELED_OVERLAY)
    + """, outcome AS (
  SELECT s.*, l.toxic AS target, s.lang AS category, (decision <> 'allow')::INT AS prediction,
    risk_score AS score FROM scored s JOIN labels l ON l.doc_id = s."Id")"""
)

_ARMS = (
    _OUTCOME
    + f""", arms AS (
  SELECT 'A_ml_only' AS arm, target, (ml_score >= {ML_THRESHOLD})::INT AS prediction, ml_score AS score
    FROM outcome
  UNION ALL SELECT 'B_heuristic_only', target, (heuristic_score >= {HEURISTIC_THRESHOLD})::INT,
    heuristic_score FROM outcome
  UNION ALL SELECT 'C_ml_plus_heuristic', target, (blend >= 0.45)::INT, blend FROM (
    SELECT target, (0.62::DOUBLE * ml_score + 0.30::DOUBLE * heuristic_score) / (0.62::DOUBLE + 0.30::DOUBLE)
      AS blend FROM outcome)
  UNION ALL SELECT 'D_full_pipeline', target, prediction, risk_score FROM outcome)"""
)

_ERROR_TYPE = "CASE WHEN target = 1 THEN 'false_negative' ELSE 'false_positive' END"

# ---- labels and splits --------------------------------------------------------------------

_LABELED = """SELECT CAST(doc_id AS VARCHAR) AS "Id", text, CASE
    WHEN doc_id % 2 = 0 AND toxic = 1 THEN 'jailbreak' WHEN doc_id % 2 = 0 THEN 'benign'
    ELSE CAST(toxic AS VARCHAR) END AS label, toxic AS target
  FROM documents JOIN labels USING (doc_id)"""

_SPLIT = """SELECT CAST(doc_id AS VARCHAR) AS "Id", toxic AS target, CASE
    WHEN row_number() OVER (PARTITION BY toxic
      ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR))
      <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY toxic)) THEN 'validation' ELSE 'train' END AS partition
  FROM labels"""


def _projection(period: int) -> str:
    weights = f"((i % {period}) * 2 - {period - 1})"
    return (
        f"list_sum(list_transform(embedding, lambda x, j: x::DOUBLE * {weights.replace('i', '(j - 1)')}"
        f" / {period - 1}::DOUBLE))"
    )


def _known(spellings: dict[str, int]) -> str:
    return ", ".join(q(name) for name in spellings)


def _tree_hash(value: str) -> str:
    return f"sha256(string_agg({value}, '' ORDER BY {value}))"


_LEAF = "d || ':' || n || ';'"
_SIZED = " || ".join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    for c in ("doc_id", "text", "lang", "source", "n_chars")
)
_FINGERPRINT = f"""
WITH rows AS (SELECT sha256({_SIZED}) AS d FROM documents),
digests AS (SELECT d, count(*) AS n FROM rows GROUP BY d),
leaves AS (SELECT left(d, 6) AS p6, {_tree_hash(_LEAF)} AS h, sum(n) AS n FROM digests GROUP BY 1),
branches AS (SELECT left(p6, 3) AS p3, {_tree_hash("p6 || h")} AS h, sum(n) AS n FROM leaves GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, {_tree_hash("p3 || h")} AS fingerprint FROM branches"""


def _multiset(digests: str) -> str:
    """Rows and fingerprint of the digests ``d``: their numbers summed limb by limb."""
    return f"""
  SELECT rows, sha256(rows || ':' || string_agg(lpad(lower(to_hex(limb)), {HEX}, '0'), '' ORDER BY j, k)) AS fingerprint
  FROM (SELECT j, k, count(*) AS rows,
      (sum(('0x' || substr(sha256(d || ':' || j), k * {HEX} + 1, {HEX}))::BIGINT) % {1 << 4 * HEX})::BIGINT AS limb
    FROM ({digests}), range({DIGESTS}) a(j), range({PER_DIGEST}) b(k) GROUP BY j, k) GROUP BY rows"""


# ---- features -----------------------------------------------------------------------------


def _term_summary(terms: str, max_df: float, max_features: int) -> str:
    return f"""
WITH grams AS ({terms}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
total AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS doc_freq, sum(tf) AS corpus_freq FROM tf GROUP BY term),
vocab AS (SELECT term, doc_freq, corpus_freq, ln((1 + n) / (1 + doc_freq)::DOUBLE) + 1 AS idf
  FROM df, total WHERE doc_freq >= 2 AND doc_freq <= {max_df}::DOUBLE * n
  ORDER BY corpus_freq DESC, term LIMIT {max_features}),
weights AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id)
SELECT term, CAST(doc_freq AS BIGINT) AS doc_freq, CAST(corpus_freq AS BIGINT) AS corpus_freq,
  round(idf, 6) AS idf, round(sum(w / norm), 6) AS weight_sum
FROM weights JOIN norms USING (doc_id) JOIN vocab USING (term)
GROUP BY term, doc_freq, corpus_freq, idf"""


_WORD_TERMS = r"""
  WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)
  SELECT doc_id, unnest(w) AS term FROM t
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t"""

_CHAR_TERMS = r"""
  WITH words AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(lower(text), '\S+')) || ' ' AS w
    FROM documents),
  sized AS (SELECT doc_id, w, unnest([3, 4, 5]) AS n FROM words)
  SELECT doc_id, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n))) AS term
  FROM sized WHERE length(w) >= n"""


_NOT_BLANK = (
    r"[^\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _kept_terms(name: str, terms: str, max_df: float, max_features: int) -> str:
    """``{name}_kept``: the selected terms; ``{name}_found``: how many of them each row holds."""
    source = f"(SELECT \"Id\" AS doc_id, text FROM ({OVERLAY}))"
    spread = terms.replace("FROM documents", f"FROM {source}").replace(r"'\S+'", q(_NOT_BLANK))
    return f"""{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM ({spread}) GROUP BY doc_id, term),
{name}_kept AS (SELECT term FROM {name}_tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= {max_df}::DOUBLE * (SELECT count(*) FROM documents)
  ORDER BY sum(tf) DESC, term LIMIT {max_features}),
{name}_found AS (SELECT doc_id, count(*) AS n FROM {name}_tf JOIN {name}_kept USING (term) GROUP BY doc_id)"""


# ---- models -------------------------------------------------------------------------------
#
# The penalised loss has one optimum, which both sides must find. Here it is looked for in the dual:
# the coefficients are a sum of training rows, so the products of rows are all that is needed, and
# accelerated gradient steps run as a recursion over one row of arrays.


def _split_by(rows: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY target
      ORDER BY md5('42:' || CAST("Id" AS VARCHAR)), CAST("Id" AS VARCHAR))
      <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY target)) THEN 'validation' ELSE 'train' END AS partition
  FROM ({rows})"""


def _optimum(strength: float, intercept: bool, modulus: float, steps: int) -> str:
    """``weights``: ``i, a`` of every training row, and the intercept ``b``. Before it stand ``points``
    (``i, y``) and ``kernel`` (``i, k``: the products with all training rows, in order)."""
    free = "any_value(u) + any_value(pace) * sum(r)" if intercept else "0.0::DOUBLE"
    zeros = "list_transform(range(n), lambda i: 0.0::DOUBLE)"
    return f"""
weighed AS (SELECT i, y, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY y)) AS c FROM points),
bound AS (SELECT count(*) AS n, {strength}::DOUBLE * 0.25::DOUBLE * max(c)
    * max(list_sum(list_transform(k, lambda x: abs(x) + {int(intercept)}))) + 1 AS steepest FROM weighed JOIN kernel USING (i)),
paces AS (SELECT 1 / steepest AS pace, (sqrt(steepest / {modulus}::DOUBLE) - 1) / (sqrt(steepest / {modulus}::DOUBLE) + 1)
  AS momentum FROM bound),
fit AS (
  SELECT 0 AS step, {zeros} AS a, {zeros} AS p, 0.0::DOUBLE AS b, 0.0::DOUBLE AS q FROM bound
  UNION ALL
  SELECT step + 1, list(v[i] + pace * (r - v[i]) ORDER BY i), any_value(a), {free}, any_value(b)
  FROM (SELECT *, {strength}::DOUBLE * c * (y - 1 / (1 + exp(-(list_inner_product(k, v) + u)))) AS r
    FROM (SELECT step, a, b, pace, list_transform(a, lambda x, i: x + momentum * (x - p[i])) AS v,
        b + momentum * (b - q) AS u FROM fit, paces WHERE step < {steps})
      CROSS JOIN kernel JOIN weighed USING (i))
  GROUP BY step),
last AS (SELECT a, b FROM fit ORDER BY step DESC LIMIT 1),
weights AS (SELECT i, a[i] AS a, b FROM points, last)"""


def _embedding_model(split: bool, embedding: str = "x::DOUBLE", name: str = "") -> str:
    """CTEs up to ``scored``: ``Id, target, partition, score`` of every vector."""
    rows = 'SELECT vec_id AS "Id", (label < 5)::INT AS target, embedding FROM embeddings'
    parted = _split_by(rows) if split else f"SELECT *, 'train' AS partition FROM ({rows})"
    ctes = f"""
units AS MATERIALIZED (SELECT "Id", target, partition,
    list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS x
  FROM (SELECT *, list_transform(embedding, lambda x: {embedding}) AS e FROM ({parted}))),
points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY "Id") AS i, x, target AS y FROM units WHERE partition = 'train'),
kernel AS MATERIALIZED (SELECT g.i, list(list_inner_product(g.x, h.x) ORDER BY h.i) AS k FROM points g, points h GROUP BY g.i),
{_optimum(EMBEDDING_C, True, 0.5, 500)},
scored AS (SELECT "Id", target, partition, 1 / (1 + exp(-(sum(list_inner_product(units.x, points.x) * a) + any_value(b)))) AS score
  FROM units, points JOIN weights USING (i) GROUP BY "Id", target, partition)"""
    for cte in ("units", "points", "kernel", "weighed", "bound", "paces", "fit", "last", "weights", "scored"):
        ctes = re.sub(rf"\b{cte}\b", cte + name, ctes)
    return ctes


_ATTACKS = (1, 2, 3, 4, 5, 6, 7, 9, 13, 15)


def _tfidf_model(split: bool) -> str:
    """The same of every document with its lead-in, by its terms; term weights come from the training rows."""
    rows = f'SELECT "Id", text, (("Id" % 16) IN {_ATTACKS})::INT AS target FROM ({OVERLAY})'
    parted = _split_by(rows) if split else f"SELECT *, 'train' AS partition FROM ({rows})"
    blocks = []
    for block, terms, spec in (("w", _WORD_TERMS, WORD_BLOCK), ("c", _CHAR_TERMS, CHAR_BLOCK)):
        spread = terms.replace("FROM documents", 'FROM (SELECT "Id" AS doc_id, text FROM frame)')
        spread = spread.replace(r"'\S+'", q(_NOT_BLANK))
        blocks.append(f"""
tf_{block} AS MATERIALIZED (SELECT doc_id AS "Id", term, count(*) AS tf FROM ({spread}) GROUP BY doc_id, term),
kept_{block} AS MATERIALIZED (SELECT term, row_number() OVER () AS t,
    ln((1 + (SELECT n FROM trained)) / (1 + count(*))::DOUBLE) + 1 AS idf
  FROM tf_{block} JOIN frame USING ("Id") WHERE partition = 'train' GROUP BY term
  HAVING count(*) >= {spec.min_df} AND count(*) <= {spec.max_df}::DOUBLE * (SELECT n FROM trained)
  ORDER BY sum(tf) DESC, term LIMIT {spec.max_features}),
unit_{block} AS MATERIALIZED (SELECT "Id"::INT AS g, t::INT AS t, w / sqrt(sum(w * w) OVER (PARTITION BY "Id")) AS w
  FROM (SELECT "Id", t, (1 + ln(tf)) * idf AS w FROM tf_{block} JOIN kept_{block} USING (term))),
mine_{block} AS MATERIALIZED (SELECT i::INT AS i, t, w FROM unit_{block} JOIN points_of ON "Id" = g),
pairs_{block} AS MATERIALIZED (SELECT g, i, sum(u.w * m.w) AS k FROM unit_{block} u JOIN mine_{block} m USING (t) GROUP BY g, i)""")
    return f"""
frame AS MATERIALIZED (SELECT *, CASE WHEN partition = 'train' THEN row_number() OVER (PARTITION BY partition ORDER BY "Id") END AS i
  FROM ({parted})),
trained AS (SELECT count(*) AS n FROM frame WHERE partition = 'train'),
points_of AS MATERIALIZED (SELECT "Id", i FROM frame WHERE i IS NOT NULL),
{','.join(blocks)},
points AS (SELECT i, target AS y FROM frame WHERE i IS NOT NULL),
products AS MATERIALIZED (SELECT f."Id", p.i, 1 + coalesce(w.k, 0) + coalesce(c.k, 0) AS k
  FROM frame f CROSS JOIN points p LEFT JOIN pairs_w w ON w.g = f."Id" AND w.i = p.i LEFT JOIN pairs_c c ON c.g = f."Id" AND c.i = p.i),
kernel AS MATERIALIZED (SELECT f.i, list(k ORDER BY p.i) AS k FROM products p JOIN points_of f USING ("Id") GROUP BY f.i),
{_optimum(TFIDF_C, False, 1.0, 500)},
scored AS (SELECT "Id", target, partition, 1 / (1 + exp(-sum(k * a))) AS score
  FROM products p JOIN weights USING (i) JOIN frame USING ("Id") GROUP BY "Id", target, partition)"""


def _trained(name: str, kind: str, scored: str = "scored") -> str:
    """The report of a fit whose scores are ``scored``."""
    held = f"SELECT * FROM {scored} WHERE partition = 'validation'"
    return f"""SELECT '{name}' AS name, 'trained' AS status, '{kind}' AS model,
  (SELECT count(*) FROM {scored} WHERE partition = 'train') AS train_rows,
  (SELECT count(*) FROM {scored} WHERE partition = 'validation') AS validation_rows,
  threshold, '{SELECTION_RULE}' AS selection_rule, tn, fp, fn, tp, {_RATIOS}, {_SUPPORT}, 0 AS unscored_rows, roc_auc
FROM ({_best(held)}) CROSS JOIN ({_auc(f"(SELECT *, 1 AS one FROM {scored} WHERE partition = 'validation')", 'one')})"""


def _listed_text(column: str) -> str:
    return f"array_to_string({column}, '|') AS {column}"


_REASONS = "array_to_string(reason_list, '|') AS reasons"
_EXFIL = next(f for f in rules.RULE_FAMILIES if f.rule_id == rules.NEGATABLE_RULE)

ORACLES = {
    "scan_batch_flat": _flat(),
    "scan_stream": _flat(),
    "scan_conversations": _flat(
        f"SELECT conv_id || '-' || turn AS \"Id\", {_lead('conv_id + turn')} || text AS text FROM conversations"
    ),
    "scan_pages": _flat(
        f'SELECT page_id AS "Id", {_lead("page_id")} || html AS text FROM pages', "page_id"
    ),
    "scan_nested": _scan(
        f"""\"Id\", decision, risk_level, risk_score, 'keyword_a' AS model,
  ml_score AS jailbreak_probability, heuristic_score AS injection_score,
  {_listed_text('matched_rules')}, unicode_score AS anomaly_score, {_listed_text('signals')},
  {_REASONS}, text AS raw_text, normalized_text, sanitized_text, lang"""
    ),
    "normalize_text": _scan('"Id", normalized_text'),
    "comparison_form": _scan('"Id", comparison_text'),
    "anomaly_signals": _scan(f'"Id", unicode_score AS anomaly_score, {_listed_text("signals")}'),
    "sanitize": _scan('"Id", decision, sanitized_text'),
    "rule_hits": _scan(
        f'"Id", {_listed_text("matched_rules")}, {_listed_text("rule_reasons")}'
    ),
    "negated_exfil": f"""{scan_ctes(OVERLAY)}, t AS (SELECT "Id", comparison_text AS folded FROM compared)
SELECT "Id", ({family_sql(_EXFIL, 'folded')})::INT AS kept FROM t
WHERE {hit_sql(_EXFIL.english, 'folded')} OR {hit_sql(_EXFIL.vietnamese, 'folded')}""",
    "heuristic_score": _scan('"Id", heuristic_score'),
    "rule_hit_counts": scan_ctes(OVERLAY)
    + "SELECT rule_id, count(*) AS hits FROM (SELECT unnest(matched_rules) AS rule_id FROM scored) GROUP BY rule_id",
    "keyword_detector": f"""SELECT "Id", CASE WHEN {' OR '.join(f'contains(lower(text), {q(k)})' for k in KEYWORDS)}
  THEN 0.96::DOUBLE ELSE 0.05::DOUBLE END AS ml_score FROM ({OVERLAY})""",
    "risk_decision": _scan('"Id", risk_score, decision, risk_level'),
    "reasons": _scan(f'"Id", {_REASONS}'),
    "decision_counts": _scan(
        "decision, risk_level, count(*) AS rows", tail="GROUP BY decision, risk_level"
    ),
    "id_fallback": 'SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS "Id" FROM conversations',
    "csv_roundtrip": f'SELECT CAST("Id" AS VARCHAR) AS "Id", text FROM ({OVERLAY})',
    "report_roundtrip": """SELECT lang, source, count(*) AS rows,
  max(CASE WHEN n_chars > 20000 THEN n_chars END) AS longest FROM documents GROUP BY lang, source""",
    "load_labeled": f'SELECT "Id", length(text) AS n_chars, label, target FROM ({_LABELED})',
    "null_report": """SELECT count(*) FILTER (d.doc_id IS NULL) AS null_doc_id,
  count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (quality IS NULL) AS null_quality,
  count(*) FILTER (toxic IS NULL) AS null_toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "unknown_labels": f"""SELECT DISTINCT label FROM (SELECT CASE lang WHEN 'en' THEN 'benign'
  WHEN 'fr' THEN 'jailbreak' ELSE lang END AS label FROM documents)
WHERE label NOT IN ({_known(labels.TRAINING_LABELS)})""",
    "stratified_split": _SPLIT,
    "split_reuse": f"SELECT * FROM ({_SPLIT}) WHERE partition = 'train'",
    "split_check": f"""SELECT count(*) FILTER (partition IS NULL) AS unmapped,
  count(*) FILTER (partition = 'train') AS train_rows,
  count(*) FILTER (partition = 'validation') AS validation_rows,
  count(*) FILTER (partition NOT IN ('train', 'validation')) AS other_rows
FROM documents d LEFT JOIN ({_SPLIT}) s ON CAST(d.doc_id AS VARCHAR) = s."Id\"""",
    "score_range_violations": " UNION ALL ".join(
        f"SELECT '{name}' AS component, count(*) FILTER (NOT coalesce({expr} BETWEEN 0 AND 1, false))"
        f" AS violations FROM events"
        for name, expr in (
            ("ml_score", "value / 100"),
            ("heuristic_score", "value / 500"),
            ("unicode_score", "(value - 1)"),
        )
    ),
    "truth_labels": 'SELECT doc_id AS "Id", toxic AS target FROM labels',
    "dataset_summary": f"""SELECT count(*) AS train_rows, count(*) FILTER (target = 0) AS benign_rows,
  count(*) FILTER (target = 1) AS jailbreak_rows,
  (SELECT count(*) FROM documents) AS test_rows_unlabeled,
  count(*) - count(DISTINCT text) AS duplicate_texts FROM ({_LABELED})""",
    "label_distribution": f"SELECT label AS value, count(*) AS rows FROM ({_LABELED}) GROUP BY label",
    "fingerprint": _FINGERPRINT,
    "fingerprint_merge": _multiset(f"SELECT sha256({_SIZED}) AS d FROM documents"),
    "external_receipt": f"""SELECT count(*) AS rows, count(*) FILTER (vec_id % 9 = 0) AS rejected_rows,
  count(*) FILTER (vec_id % 9 <> 0) AS decisions, (SELECT fingerprint FROM ({_multiset(
      "SELECT sha256(length(vec_id::VARCHAR) || ':' || vec_id || coalesce(length('vector ' || text) || ':vector ' || text, '-')) AS d"
      " FROM (SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN vec_id::VARCHAR END AS text FROM embeddings)"
  )})) AS input_fingerprint, 1 AS predictions_fit, 1 AS timed FROM embeddings""",
    "class_weights": """SELECT toxic AS target, count(*) AS rows,
  round(CAST(sum(count(*)) OVER () AS BIGINT) / (2.0::DOUBLE * count(*)), 9) AS weight FROM labels GROUP BY toxic""",
    "threshold_predict": f'SELECT "Id", score, (score >= {ML_THRESHOLD})::INT AS prediction FROM ({_tied()})',
    "softmax_prob": f"""SELECT vec_id, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b))
  + exp(b - greatest(a, b))), 9) AS probability
FROM (SELECT vec_id, {_projection(5)} AS a, {_projection(7)} AS b FROM embeddings)""",
    "metrics_unscored": f"""SELECT tn, fp, fn, tp, {_RATIOS}, {_SUPPORT}, unscored_rows FROM (
  SELECT {_CELLS}, {_UNSCORED} FROM (SELECT target, (score >= 0.5)::INT AS prediction
    FROM documents LEFT JOIN ({_tied()}) t ON t."Id" = CAST(doc_id AS VARCHAR)))""",
    "truth_unknown": f"""SELECT DISTINCT role AS label FROM conversations
WHERE role NOT IN ({_known(labels.TRUTH_LABELS)})""",
    "binary_metrics": f"""SELECT tn, fp, fn, tp, {_RATIOS}, {_SUPPORT}, unscored_rows FROM (
  SELECT {_CELLS}, {_UNSCORED} FROM (SELECT target, (score >= 0.5)::INT AS prediction FROM ({_tied()})))""",
    "roc_auc": f"""WITH keyed AS (
  SELECT 'labels' AS source, target, score FROM ({_tied()})
  UNION ALL SELECT 'embeddings', (label < 5)::INT, round({_projection(5)}, 9) FROM embeddings)
SELECT source, roc_auc, support_benign, support_jailbreak FROM ({_auc('keyed', 'source')}) JOIN (
  SELECT source, count(*) FILTER (target = 0) AS support_benign,
    count(*) FILTER (target = 1) AS support_jailbreak FROM keyed GROUP BY source) USING (source)""",
    "threshold_sweep": f"SELECT threshold, tn, fp, fn, tp, {_RATIOS} FROM ({_sweep(_tied())})",
    "best_threshold": f"SELECT *, '{SELECTION_RULE}' AS selection_rule FROM ({_best(_tied())})",
    "select_primary": f"""SELECT name, 'trained' AS status, threshold, recall_jailbreak, f1_jailbreak,
  false_positive_rate, round(u, 9) AS utility FROM (
  SELECT *, tp::DOUBLE / (tp + fn) + 0.5::DOUBLE * (2 * tp)::DOUBLE / (2 * tp + fp + fn)
    - 0.35::DOUBLE * fp::DOUBLE / (fp + tn) AS u FROM (
    SELECT 'model_a' AS name, * FROM ({_best(_tied())})
    UNION ALL SELECT 'model_b', * FROM ({_best(_tied(53, 97))})))
ORDER BY u DESC, name LIMIT 1""",
    "latency_summary": """SELECT count(value) AS n, round(avg(value), 9) AS mean,
  round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95 FROM events""",
    "latency_sketch": """SELECT count(value) AS n, round(avg(value), 9) AS mean, 1 AS p50_within, 1 AS p95_within
FROM events""",
    "eval_join": _OUTCOME + 'SELECT "Id", risk_score, decision, target, prediction FROM outcome',
    "join_mismatch": """SELECT (SELECT count(*) FROM documents) AS left_rows,
  (SELECT count(*) FROM labels) AS right_rows,
  (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS left_repeated,
  (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS right_repeated,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_right,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_left,
  (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matched""",
    "eval_full": _scored_metrics(_OUTCOME, "outcome", None),
    "ablation": _scored_metrics(_ARMS, "arms", "arm"),
    "category_breakdown": _scored_metrics(_OUTCOME, "outcome", "category"),
    "error_analysis": _OUTCOME
    + f"""SELECT "Id", text, target, prediction, {_FLAT}, {_ERROR_TYPE} AS error_type
FROM outcome WHERE prediction <> target""",
    "error_examples": _OUTCOME
    + f"""SELECT "Id", {_ERROR_TYPE} AS error_type, decision FROM outcome WHERE prediction <> target
QUALIFY row_number() OVER (PARTITION BY target ORDER BY "Id") <= 5""",
    "sample_head": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "model_compare": f"""WITH a AS ({_scan('"Id", ml_score, risk_score, decision')}),
b AS ({scan_ctes(OVERLAY, OTHER_KEYWORDS, 0.91, 0.1)} SELECT "Id", ml_score, risk_score, decision FROM scored)
SELECT a."Id", a.ml_score AS ml_score_a, a.risk_score AS risk_score_a, a.decision AS decision_a,
  b.ml_score AS ml_score_b, b.risk_score AS risk_score_b, b.decision AS decision_b,
  (a.decision <> b.decision)::INT AS disagrees FROM a JOIN b ON a."Id" = b."Id\"""",
    "tfidf_word": _term_summary(_WORD_TERMS, 0.995, 80_000),
    "tfidf_char": _term_summary(_CHAR_TERMS, 1.0, 120_000),
    "feature_union": f"""WITH {_kept_terms('word', _WORD_TERMS, 0.995, 80_000)},
{_kept_terms('chars', _CHAR_TERMS, 1.0, 120_000)}
SELECT d.doc_id AS "Id", CAST(coalesce(w.n, 0) + coalesce(c.n, 0) + 1 AS INT) AS terms,
  CAST((SELECT count(*) FROM word_kept) + (SELECT count(*) FROM chars_kept) + 1 AS INT) AS dimensions
FROM documents d LEFT JOIN word_found w ON w.doc_id = d.doc_id LEFT JOIN chars_found c ON c.doc_id = d.doc_id""",
    "predict_text": """SELECT doc_id, round(1 / (1 + exp(5 - coalesce(list_avg(list_transform(words, lambda w: length(w))), 0))), 9)
  AS probability
FROM (SELECT doc_id, list_slice(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), 1, 256) AS words
  FROM documents)""",
    "train_model_a": f"""WITH RECURSIVE {_tfidf_model(True)}
SELECT *, (SELECT count(*) + (SELECT count(*) FROM kept_c) + 1 FROM kept_w) AS coefficients, 0.0::DOUBLE AS largest_gradient
FROM ({_trained('model_a', TFIDF_MODEL)})""",
    "score_model_a": f"""WITH RECURSIVE {_tfidf_model(False)}
SELECT "Id", target, round(score, 3) AS score, (score >= 0.5)::INT AS prediction FROM scored""",
    "scoring_paths": f"""SELECT (doc_id % 16 IN {_ATTACKS})::INT AS target, count(*) AS rows, 0::BIGINT AS apart
FROM documents GROUP BY 1""",
    "train_model_b": f"""WITH RECURSIVE {_embedding_model(True)}
SELECT *, (SELECT len(embedding) + 1 FROM embeddings LIMIT 1) AS coefficients, 0.0::DOUBLE AS largest_gradient
FROM ({_trained('model_b', EMBEDDING_MODEL)})""",
    "score_model_b": f"""WITH RECURSIVE {_embedding_model(False)}
SELECT "Id", target, round(score, 4) AS score FROM scored""",
    "registry_roundtrip": f"""WITH RECURSIVE {_embedding_model(False)}
SELECT "Id", 2 AS version, round(score, 4) AS score, (round(score, 4) >= 0.5)::INT AS prediction FROM scored""",
    "model_report": f"""WITH RECURSIVE {_embedding_model(True)}, {_embedding_model(True, '(x * x)::DOUBLE', '_2')},
reports AS ({_trained('model_a', EMBEDDING_MODEL)}
  UNION ALL {_trained('model_b', EMBEDDING_MODEL, 'scored_2')})
SELECT *, row_number() OVER (ORDER BY recall_jailbreak + 0.5::DOUBLE * f1_jailbreak - 0.35::DOUBLE * false_positive_rate DESC,
  name) = 1 AS is_primary FROM reports""",
    "predict_batch": """SELECT vec_id, round(1 / (1 + exp(-list_dot_product(
  list_transform(embedding, lambda x: x::DOUBLE),
  list_transform(range(0, 64), lambda i: ((i % 7 - 3) / 10.0)::DOUBLE)))), 9) AS probability FROM embeddings""",
}
