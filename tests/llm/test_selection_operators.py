"""Filter audit, hard negatives and mixing: against brute force and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textrisk.llm import filter_audit, hard_negatives, mixing
from textrisk.llm.queries import ORACLES, QUERIES

LABELS = "doc_id bigint, quality int, toxic int"


# ---- filter audit -------------------------------------------------------------------------


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def audit_by_hand(docs, labels):
    texts = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = ({i for i, *row in labels if i is not None and row[n] == 1} for n in (0, 1))
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    rows = [
        (s, failing(t) + ("E" if i is not None and least[t] < i else ""), i in good, i in toxic) for i, t, s in texts
    ]
    out = {}
    for part in {s for s, *_ in rows}:
        mine = [row for row in rows if row[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for _, fails, *_ in mine:
                shapley.update([letter for letter in order if letter in fails][:1])
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = [r for r in mine if not set(order[: step - 1]) & set(r[1])]
                gone = [r for r in before if letter in r[1]]
                out[part, "".join(order), step] = (
                    len(before) - len(gone),
                    len(gone),
                    sum(letter in r[1] for r in mine) - len(gone),
                    sum(r[1] == letter for r in mine),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                    shapley[letter],
                )
    return out


def audited(found):
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    rows = [tuple(r) for r in found.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def odd_documents():
    rng = random.Random(5)
    many = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(n)) for n in (40, 60, 90)]
    many += [" ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), "Ab # c", "x" * 3_000_000]
    texts = [None, "", " ", " ", "ÀÉ Z", *many, *(many[3] + f" tail {i}" for i in range(20))]
    docs = [(i, t, rng.choice(["s", "t", "", None])) for i, t in enumerate(texts * 3)]
    return docs + [(None, many[3], "s"), (None, many[3], "s"), (7, texts[7], "s"), (7, "other", None)]


def test_audit_of_odd_documents(spark):
    docs = odd_documents()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 1)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr(
        "*", "'x' AS id", "'x' AS part", "1 AS mask", "'x' AS quality"
    )
    found = filter_audit.audit_filters(table.repartition(3), spark.createDataFrame(labels, LABELS))
    assert audited(found) == audit_by_hand(docs, labels)


def test_audit_of_texts_that_share_long_starts_and_of_hot_copies(spark, monkeypatch):
    """Small blocks, many ranges bounded by long prefixes, and a heavy text dealt by salt."""
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 1 << 13)
    rng = random.Random(8)
    start = "the same licence lines " * 40
    docs = [(i, start + f"{rng.randrange(200)} end", f"s{i % 2}") for i in range(900)]
    docs += [(900 + i, "hot " * 100, "s0") for i in range(500)]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(4)
    bounds = filter_audit.split_prefixes(table, "text", len(docs), 40)
    assert bounds == sorted(set(bounds)) and len(bounds) > 10 and max(map(len, bounds)) > len(start)
    found = filter_audit.audit_filters(table, spark.createDataFrame([], LABELS))
    assert audited(found) == audit_by_hand(docs, [])


def test_audit_of_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert filter_audit.audit_filters(docs, spark.createDataFrame([], LABELS)).count() == 0


@given(st.text(max_size=300) | st.text("aB \t#é　", max_size=300))
@settings(max_examples=300, deadline=None)
def test_mask_of_one_text(text):
    text = text.encode("utf-8", "replace").decode()
    letters = "".join(x for i, x in enumerate("ABCD") if filter_audit.text_mask(text.encode()) >> i & 1)
    assert letters == failing(text)


def test_pieces_break_no_word(monkeypatch):
    monkeypatch.setattr(filter_audit, "_PIECE", 5)
    data = b"one three  seventeen\n a b c d e f verylongword"
    assert [w for piece in filter_audit._pieces(data) for w in piece.split()] == data.split()


@given(st.lists(st.tuples(st.text("ab", max_size=6), st.integers(0, 9) | st.none()), max_size=40))
@settings(max_examples=200, deadline=None)
def test_trie_holds_the_smallest_ids(pairs):
    trie, least = filter_audit.RadixTrie(), {}
    for text, key in pairs:
        trie.insert(text.encode(), key)
        known = least.get(text)
        least[text] = key if known is None else known if key is None else min(known, key)
    assert {text.decode(): key for text, key in trie.terminals()} == least


# ---- hard negatives -----------------------------------------------------------------------

ITEMS = "vec_id bigint, embedding array<float>, label int"


def negatives_by_hand(items, anchor, positives=5, negatives=10, scale=256):
    rows = sorted(
        {
            (i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v))
            for i, v, label in items
            if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
        }
    )
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in rows if b != a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda pair: pair[:2])
        for p, positive, _ in [pair for pair in scored if pair[2][1] == a[1]][:positives]:
            inside = [x for x in scored if x[2][1] != a[1] and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(a[0], positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(found):
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors_with_groups(rows, seed=2, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(rows):
        vector = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.0, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in vector], int(rng.integers(4))))
    return out


def test_negatives_equal_brute_force(spark, monkeypatch):
    """Many ties by copies; one chunk per anchor, and small blocks."""
    items = vectors_with_groups(400)
    table = spark.createDataFrame(items, ITEMS).repartition(5)
    expected = negatives_by_hand(items, lambda i: i % 20 == 0)
    assert len(expected) > 200
    assert mined(hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 20 == 0)) == expected
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", 900)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    assert mined(hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 20 == 0)) == expected


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    items = vectors_with_groups(60, seed=4, dims=3)
    items += [(100, None, 1), (120, [], 0), (121, [], 0), (122, [], 1), (None, [1.0, 2.0, 3.0], 1), (140, [1.0, 2.0, 3.0], None)]
    items += [(160, [nan, 1.0, 1.0], 1), (161, [inf, 1.0, 1.0], 1), (180, [0.0, 0.0, 0.0], 1), (-20, [2.0, 0.5, 1.0], 2)]
    items += [(200, [1.0, 2.0], 0), (201, [2.0, 1.0], 0), (202, [1.0, 1.0], 1), (40, items[40][1], items[40][2]), (203, [1.0, None], 1)]
    table = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS id", "'x' AS score", "'x' AS anchor")
    found = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 20 == 0)
    assert mined(found) == negatives_by_hand(items, lambda i: i % 20 == 0)
    empty = spark.createDataFrame([], ITEMS)
    assert mined(hard_negatives.mine_hard_negatives(empty, F.col("vec_id") % 20 == 0)) == []
    assert mined(hard_negatives.mine_hard_negatives(table, F.lit(False))) == []


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    items = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [2.0, 2.0], 0), (2, [1.0, 1.0], 1), (2, [1.5, 1.5], 1)]
    found = mined(hard_negatives.mine_hard_negatives(spark.createDataFrame(items, ITEMS), F.col("vec_id") == 0))
    assert Counter(r[:2] for r in found) == {(0, 1): 4}
    assert {r[5] for r in found} == {65536, 98304}


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for size in (10, 1 << 27, 1 << 40, (1 << 62) + 5):
        a, b = (rng.integers(-size, size, (4, 3)) for _ in range(2))
        exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        clipped = [[max(-(2**63) + 1, min(2**63 - 1, x)) for x in row] for row in exact]
        assert hard_negatives.inner_products(a, b).tolist() == clipped


@given(st.lists(st.tuples(*[st.integers(-(2**63) + 1, 2**63 - 1)] * 5), min_size=1, max_size=20), st.integers(0, 1))
@settings(max_examples=100, deadline=None)
def test_keys_sort_like_their_fields(rows, kind):
    keys = hard_negatives.pack_keys(*(np.array(c, np.int64) for c in list(zip(*rows))[:3]), kind, *(np.array(c, np.int64) for c in list(zip(*rows))[3:]))
    assert list(hard_negatives.unpack_keys(keys)) == [(a, m, s, kind, i, r) for a, m, s, i, r in rows]
    by_key = [row for _, row in sorted(zip(keys.to_pylist(), rows), key=lambda pair: pair[0])]
    assert by_key == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))


def test_windows_lie_below_their_positive():
    with pytest.raises(ValueError):
        hard_negatives.Window(30, 100)
    low, high = hard_negatives.Window().of(-10)
    assert low > high
    assert hard_negatives.Window().of(0) == (0, 0)


# ---- mixing -------------------------------------------------------------------------------


def test_targets_are_reshared(spark):
    rows = [(False, "a", 10), (False, "b", 1000), (False, "c", 0), (False, "d", 500), (True, "", 3)]
    table = spark.createDataFrame(rows, "no_source boolean, source string, source_size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(table, (3, 1, 2), 1.5, 2).collect()}
    # d weighs 3 and stops at 1000, a and the null source at 20 and 6; b takes what is left.
    assert found == {"a": 20.0, "b": 1513 * 1.5 - 1026, "c": 0.0, "d": 1000.0, "": 6.0}


def mixed(spark, rows, weights=None, **options):
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "*", "'x' AS id", "'x' AS size", "'x' AS range", "'x' AS key", "'x' AS weight"
    )
    return mixing.mix_sources(table.repartition(3), weights, **options)


def check_mix(found, rows):
    by_source = defaultdict(list)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    total = sum(len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows)
    assert sum(r["size"] for r in found) == total and len(found) == len(rows)
    assert math.isclose(sum(g[0]["target"] for g in by_source.values()), 1.5 * total)
    for group in by_source.values():
        size, target = sum(r["size"] for r in group), group[0]["target"]
        assert all((r["source_size"], r["target"]) == (size, target) for r in group)
        assert abs(sum(r["taken"] for r in group) - target) <= 0.5 and target <= 2 * size
        epochs = [r["taken"] // r["size"] for r in group if r["size"]]
        partial = sum(r["taken"] % r["size"] > 0 for r in group if r["size"])
        assert not epochs or (max(epochs) - min(epochs) <= 1 and partial <= 1)


def test_mix_of_odd_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["hot"] * 5 + ["a", "é", "z", "", None])) for i in range(800)]
    rows += [(None, "a b", "a"), (None, "c d e", "a"), (3, "again and again", "a"), (3, "again and again", "a"), (4, None, "none")]
    rows += [(5, "w " * 200_000, "long"), (6, "  \x85", "é")]
    weights = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 0.0), (3, None), (None, 9.0), (5, -1.0)], "doc_id bigint, weight double")
    found = mixed(spark, rows, weights).collect()
    check_mix(found, rows)
    again = mixed(spark, rows[::-1], weights).collect()
    assert Counter(found) == Counter(again)


def test_hot_source_is_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    found = mixed(spark, rows).collect()
    check_mix(found, rows)
    assert Counter(found) == Counter(mixed(spark, rows).collect())


def test_weights_move_documents_forward(spark):
    rows = [(i, "one two three four", s) for i in range(4000) for s in ("a", "b")]
    weights = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 4.0, 1.0) AS weight")
    found = mixed(spark, rows, weights, cycle=(1, 3), share=0.5).where("source = 'a'").collect()
    taken = Counter(r["doc_id"] % 2 for r in found if r["taken"])
    # A quarter is drawn, without replacement, from as many rows of weight 4 as of weight 1.
    assert sum(taken.values()) == 1000 and 3.0 < taken[0] / taken[1] < 4.5


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(empty).collect() == []
    blank = mixed(spark, [(1, " ", "s"), (2, None, None)]).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in blank} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


# ---- queries ------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives", "op13_mixing"])
def test_query_equals_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf_dir) / table}.parquet'")
    expected = con.sql(ORACLES[name])
    columns = sorted(expected.columns)
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    wanted = sorted(expected.select(*columns).fetchall(), key=str)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert got == wanted and got
