"""The registered queries of this package, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm import (
    bpe,
    filter_audit,
    fingerprints,
    hard_negatives,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    quality,
    token_counts,
    toxicity,
    vector_dedup,
    warc,
)
from textrisk.llm.common import read_table
from textrisk.llm.training import fold

CONTEXT_TOKENS = 2048
ACCEPTED = 0.3  # scores from which on a label is predicted
LABELLED_GOOD, LABELLED_POOR = 2.0, 0.5  # weights in the mix; documents without a label weigh 1


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and its near-duplicate component."""
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    found = bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives."""
    found = warc.round_trip(read_table(spark, sf_dir, "pages"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", quality.quality_score(docs, labels, fold("doc_id", 5) != 0).alias("score"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", _predicted())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur across sites."""
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.remove_boilerplate(docs).select("doc_id", "text")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vector_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", toxicity.toxicity_score(docs, labels, fold("doc_id", 4) != 2).alias("score"))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", _predicted())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.edited_neighbours(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds a context of 2,048 tokens."""
    counted = token_counts.count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens, one row per piece."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, source by source, in all their orders."""
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document in a mix of 150 % of all words, drawn by labelled quality."""
    labels = read_table(spark, sf_dir, "labels")
    weight = F.when(F.col("quality") == 1, LABELLED_GOOD).when(F.col("quality") == 0, LABELLED_POOR)
    weights = labels.select("doc_id", weight.alias("weight")).where("weight IS NOT NULL")
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), weights)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _predicted() -> Column:
    return F.when(F.col("score") >= ACCEPTED, 1).otherwise(0).alias("predicted")


QUERIES = {
    query.__name__: query
    for query in (
        op1_jaccard_join,
        op2_bpe,
        op3_warc,
        op4_quality,
        op5_line_dedup,
        op6_vector_dedup,
        op7_toxicity,
        op8_fingerprints,
        op9_token_counts,
        op10_packing,
        op11_filter_audit,
        op12_hard_negatives,
        op13_mixing,
    )
}

# Set against the same tables in SQL. The models and the tokenizers have no SQL counterpart.
ORACLES = {
    "op3_warc": f"""
        WITH hashed AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first FROM hashed
            WHERE payload_bytes >= {warc.SMALLEST_REVISITED} GROUP BY ALL
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM hashed LEFT JOIN firsts USING (payload_digest)
    """,
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS nth
            FROM documents
        ), spread AS (
            SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY trim(line)
            HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES} AND count(DISTINCT text) >= {line_dedup.MIN_SITES}
        ), kept AS (
            SELECT doc_id, string_agg(l.line, chr(10) ORDER BY nth) AS text
            FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line WHERE s.line IS NULL GROUP BY doc_id
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
    "op6_vector_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        ), usable AS (
            SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM vectors
            WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95::DOUBLE
        ), reached AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), smallest AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
        )
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, component_id,
               e.vec_id = component_id AS kept
        FROM embeddings e JOIN smallest USING (vec_id)
    """,
    "op11_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), firsts AS (
            SELECT text, min(doc_id) AS first FROM texts GROUP BY text
        ), marked AS (
            SELECT part,
                   CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                           THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails,
                   coalesce(quality = 1, false)::INT AS good, coalesce(toxic = 1, false)::INT AS toxic
            FROM texts JOIN firsts USING (text) LEFT JOIN labels USING (doc_id)
        ), cells AS (
            SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
        ), orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
        ), steps AS (
            SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
                   '[' || left(filter_order, step - 1) || '-]' AS earlier
            FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders)
        ), counted AS (
            SELECT part, filter_order, step, n, good, toxic, length(fails) AS width,
                   contains(fails, letter) AS failed, regexp_matches(fails, earlier) AS gone
            FROM cells, steps
        )
        SELECT part, filter_order, step,
               coalesce(sum(n) FILTER (WHERE NOT failed AND NOT gone), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (WHERE failed AND gone), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (WHERE failed AND width = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS good_lost,
               coalesce(sum(toxic) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * 120 // greatest(width, 1)) FILTER (WHERE failed), 0)::BIGINT AS shapley
        FROM counted GROUP BY part, filter_order, step
    """,
    "op12_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS units
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_inner_product(a.units, b.units)::BIGINT AS score
            FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.units) = len(b.units)
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
    """,
    "op13_mixing": f"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS part
            FROM sized GROUP BY source
        ), stops AS (
            SELECT sum(source_size) OVER () AS total, sum(part) OVER () AS parts,
                   coalesce(sum(source_size) OVER before, 0) AS stopped, coalesce(sum(part) OVER before, 0) AS gone
            FROM sources WINDOW before AS (ORDER BY source_size / part, source
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (
            SELECT max((1.5::DOUBLE * total::DOUBLE - 2 * stopped::DOUBLE) / (parts - gone)::DOUBLE) AS level FROM stops
        ), budgets AS (
            SELECT source, source_size, CASE WHEN 2 * source_size < level * part THEN 2 * source_size::DOUBLE
                                             ELSE level * part END AS target
            FROM sources, level
        ), weights AS (
            SELECT doc_id, max(CASE quality WHEN 1 THEN {LABELLED_GOOD}::DOUBLE ELSE {LABELLED_POOR}::DOUBLE END) AS weight
            FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
        ), keyed AS (
            SELECT d.*, b.source_size, b.target,
                   CASE WHEN b.source_size > 0 THEN floor(b.target / b.source_size)::BIGINT ELSE 0 END AS epochs,
                   -ln((('0x' || substr(md5('{mixing.SEED}:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 52)::DOUBLE)
                       / coalesce(w.weight, 1) AS key
            FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN weights w USING (doc_id)
        ), summed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM keyed
        )
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 0.5)::BIGINT - before)))::BIGINT
                   AS taken
        FROM summed
    """,
    "op1_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM words WHERE len(ws) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared >= 75 * (x.n + y.n - shared)
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN reached r ON r.a = d.doc_id
        GROUP BY d.doc_id
    """,
}
