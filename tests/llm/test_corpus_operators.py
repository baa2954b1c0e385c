"""Joins, archives, line and vector dedup, classifiers and the pipeline."""

import gzip
import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from test_text_operators import check_packing
from textrisk.llm import jaccard_join, line_dedup, quality, toxicity, vector_dedup, warc
from textrisk.llm.components import connected_components
from textrisk.llm.queries import ORACLES, QUERIES
from textrisk.llm.training import fold, training_rows

WORDS = [f"w{i}" for i in range(400)]


def component_of(nodes, links):
    """Smallest reachable node, by brute force."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(near):
        todo = [n] if n not in out else []
        while todo:
            m = todo.pop()
            if m not in out:
                out[m] = n
                todo.extend(near[m])
    return out


# ---- components ---------------------------------------------------------------------------


@pytest.mark.parametrize("links", [
    [], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(100 - i, 99 - i) for i in range(60)],
    [(i, i // 2) for i in range(1, 64)], [(3, 1), (3, 1), (1, 3), (9, 7), (7, 8), (2, 8)],
])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in component_of(nodes, [x for x in links if x[0] != x[1]]).items()}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == component_of(nodes, [x for x in links if x[0] != x[1]])


# ---- n-gram Jaccard join ------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_by_brute_force(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    keys = [k for k in texts if sets[k]]
    links = [
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    component = component_of(texts, links)
    return {k: (len(sets[k]), component[k]) for k in texts}


def near_copies(rng, n, words, changes):
    base = [rng.choice(WORDS) for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = rng.choice(WORDS)
        out.append(" ".join(copy))
    return out


def test_jaccard_components_equal_brute_force(documents):
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts = [None, "", "  \t", "a", "A", "a b c d", "A B C\nD", "a b c d e", "a b c d e f", "É É É É É", "é é é é é"]
    for words in (6, 20, 41, 90, 200, 700):
        for changes in (1, words // 40 + 1, words // 20 + 1, words // 12 + 2):
            texts += near_copies(rng, 7, words, changes)
    texts += [" ".join(rng.choice(WORDS) for _ in range(40)) + " " + passage for _ in range(40)]
    texts += near_copies(rng, 300, 80, 6) + ["the very same text of some words " * 5] * 30
    keys = list(range(0, 3 * len(texts), 3))
    rng.shuffle(keys)
    table = dict(zip(keys, texts, strict=True))
    got = jaccard_join.jaccard_components(documents(list(table.items()), extra=True).repartition(3)).collect()
    expected = jaccard_by_brute_force(table)
    assert len(got) == len(table)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_a_group_that_shares_a_passage_but_is_not_alike(documents):
    """Mixed groups: members that do not link with the smallest one may link with each other."""
    rng = random.Random(8)
    passage = [rng.choice(WORDS) for _ in range(300)]
    table, key = {}, 0
    for _ in range(30):
        tail = [rng.choice(WORDS) for _ in range(130)]
        for _ in range(2):
            key += 1
            table[key] = " ".join(passage + tail + [rng.choice(WORDS)])
    got = jaccard_join.jaccard_components(documents(list(table.items()))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_by_brute_force(table)


def test_agreeing_parts_are_expected_at_the_threshold():
    for band in range(1, 15):
        parts = jaccard_join.parts_of_band(band, 75, 100)
        size = 2 ** (band + 1) - 1
        for differ in (2 * size // 7, size // 3):
            common = size - differ / 2 if differ == 2 * size // 7 else size
            assert parts * math.exp(-differ / parts) * -math.expm1(-common / parts) > min(15, 0.6 * size)


def test_bands_reach_every_possible_partner():
    for size in range(1, 400):
        for other in range(size, size * 4 // 3 + 1):
            assert jaccard_join.bands_of(size, 75, 100)[-1] in jaccard_join.bands_of(other, 75, 100)


def test_jaccard_keeps_repeated_and_null_ids(documents):
    got = jaccard_join.jaccard_components(documents([(4, "x y"), (4, "x y"), (2, "x y"), (None, "q"), (None, None)]))
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got.where("doc_id > 0").collect())
    assert rows == [(2, 1, 2), (4, 1, 2), (4, 1, 2)]
    assert got.where("doc_id IS NULL AND component_id IS NULL").count() == 2
    assert jaccard_join.jaccard_components(documents([])).count() == 0


# ---- archives -----------------------------------------------------------------------------


PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    long = "<p>é</p>" * 200_000
    rows = [
        (5, "http://a/é b", "x" * 100), (3, "http://a/\r\nInjected: 1", "x" * 100), (9, None, "x" * 100), (1, "u", "y" * 99),
        (2, "u", "y" * 99), (7, "u", None), (8, "u", ""), (11, "u", long), (10, "u", long), (12, "u", "a\r\n\r\nb" * 30),
        (None, "u", "z" * 300), (20, "u", "r" * 200), (20, "u", "r" * 200),
    ]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'k' AS payload_digest", "1 AS first").repartition(2)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert (by_id[3]["record_type"], by_id[5]["refers_to"], by_id[9]["refers_to"]) == ("response", 3, 3)
    assert by_id[1]["record_type"] == by_id[2]["record_type"] == by_id[7]["record_type"] == "response"
    assert by_id[11]["refers_to"] == 10 and by_id[11]["payload_bytes"] == len(long.encode())
    assert bytes(by_id[10]["payload"]).decode() == long and by_id[11]["payload"] is None
    assert bytes(by_id[12]["payload"]).decode() == "a\r\n\r\nb" * 30
    assert [r["record_type"] for r in got if r["page_id"] == 20] == ["response"] * 2
    assert "\n" not in by_id[3]["url"] and by_id[9]["url"] is None and by_id[None]["payload_bytes"] == 300
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def read_all(data):
    return [warc.read_record(pieces) for pieces in warc.members(io.BytesIO(data))]


@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(0, 9))
@settings(max_examples=40, deadline=None)
def test_every_member_is_one_record(payloads, level):
    import hashlib

    made = [warc.record(str(i), "u", p, hashlib.sha256(p).hexdigest(), None, "d") for i, p in enumerate(payloads)]
    data = b"".join(warc.member(m, level) for m in made)
    assert gzip.decompress(data) == b"".join(made) if made else data == b""
    assert [r["payload"] for r in read_all(data)] == payloads


def test_broken_archives_are_refused():
    import hashlib

    payload = b"hello " * 50
    whole = warc.record("1", "u", payload, hashlib.sha256(payload).hexdigest(), None, "d")
    for data in (
        warc.member(whole)[:-12], warc.member(whole[:-1]), warc.member(whole + b"x"), warc.member(b"no record"),
        warc.member(whole.replace(b"hello", b"hallo", 1)), warc.member(whole.replace(b"Length: ", b"Length: 1", 1)),
        b"plain bytes",
    ):
        with pytest.raises(warc.BrokenArchive):
            read_all(data)


# ---- lines --------------------------------------------------------------------------------


def lines_by_brute_force(rows, least):
    sites, texts = {}, {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(site or "")
                texts.setdefault(line.strip(" "), set()).add(text)
    bad = {line for line in sites if len(sites[line]) >= least and len(texts[line]) >= least}
    return [
        (k, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or x.strip(" ") not in bad))
        for k, t, _ in rows
    ]


@pytest.mark.parametrize("broadcast_lines", [1000, 0])
def test_lines_equal_brute_force(documents, broadcast_lines):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", " line 3 "]
    rows = [(i, "\n".join(rng.choice(pool[: 3 + i % 13]) for _ in range(rng.randrange(6))), f"s{rng.randrange(9)}") for i in range(60)]
    rows += [(100 + i, "copied everywhere\nas a whole", f"s{i}") for i in range(9)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "line 1", None), (203, "only\n\nonce", "s2"), (203, "only\n\nonce", "s2")]
    rows += [(300 + i, f"own {i}\n" + "very long " * 3000, f"t{i}") for i in range(6)]
    docs = documents(rows, extra=True).repartition(3)
    found = line_dedup.remove_boilerplate(docs, broadcast_lines=broadcast_lines)
    assert found.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    assert got == sorted(lines_by_brute_force(rows, line_dedup.MIN_SITES), key=str)


@pytest.mark.parametrize("broadcast_lines", [0, 1000])
def test_lines_leave_columns_of_any_name_alone(documents, broadcast_lines):
    rows = [(i, f"shared line\nown {i}", f"s{i}") for i in range(6)] + [(9, None, "s1")]
    docs = documents(rows).selectExpr(
        "*", "'q' AS __llm_stays", "'r' AS __llm_text", "'s' AS __LLM_DROP", "'t' AS __llm_text_"
    )
    found = line_dedup.remove_boilerplate(docs, broadcast_lines=broadcast_lines)
    assert found.columns == docs.columns
    rest = [c for c in docs.columns if c != "text"]
    assert sorted(found.select(rest).collect()) == sorted(docs.select(rest).collect())
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {i: f"own {i}" for i in range(6)} | {9: None}


def test_lines_of_an_empty_table(documents):
    assert line_dedup.remove_boilerplate(documents([])).count() == 0


# ---- vectors ------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.normal(size=(150, 64))
    rows = [(int(i), v) for i, v in enumerate(base)]
    key = 1000
    for spread in (0.05, 0.2, 0.28, 0.31):
        for v in base[:40]:
            noise = rng.normal(size=64)
            key += 1
            rows.append((key, v + spread * noise * np.linalg.norm(v) / np.linalg.norm(noise)))
    rows += [(key + 1 + i, base[7] * (1 if i % 2 else 1.0)) for i in range(12)]
    rows += [(5000 + i, base[9] + 0.01 * rng.normal(size=64)) for i in range(120)]
    table = [(k, [float(x) for x in v]) for k, v in rows]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] + [1.0] * 63), (9005, [None] + [1.0] * 63),
           (9006, [float("inf")] + [1.0] * 63), (9007, [1.0] * 3)]
    schema = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame(table + odd, schema).selectExpr("*", "1 AS label", "2 AS id", "3 AS links").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    x = np.array([v for _, v in table], np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    keys = [k for k, _ in table]
    component = component_of(keys, [(keys[i], keys[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    found = sum(got[k][0] for k in keys)
    assert found >= 0.99 * linked.sum() and all(got[k][0] <= n for k, n in zip(keys, linked.sum(axis=1), strict=True))
    assert found == linked.sum() and all(got[k][1] == component[k] and got[k][2] == (component[k] == k) for k in keys)
    assert all(got[k] == (0, k, True) for k, _ in odd)
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0


def test_vectors_that_share_an_id_have_their_own_links(spark):
    a, b, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0, 0.01]), (4, [0.01, 1.0, 0.0]), (5, far), (5, None)]
    found = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [
        (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 0, 5), (5, 0, 5),
    ]


def test_vectors_of_every_length_and_size_link(spark):
    near = ([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.01])
    rows = [(10 * k + i, [x * scale for x in v]) for k, scale in enumerate((1.0, 1e200, 1e-200, 1e-310)) for i, v in enumerate(near)]
    rows += [(100, [1.0, 0.0] * 3), (101, [1.0, 0.01] * 3), (102, [1.0]), (103, [-1.0])]
    found = vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert all(got[10 * k + i] == (7, 0) for k in range(4) for i in (0, 1))
    assert got[100] == got[101] == (1, 100) and got[102] == (0, 102) and got[103] == (0, 103)


def test_vectors_over_several_slabs(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SLAB_ROWS", 40)
    test_vectors_equal_brute_force(spark)


# ---- classifiers --------------------------------------------------------------------------


def labelled(documents, spark, texts, labels, column):
    docs = documents([(i, t) for i, t in enumerate(texts)], extra=True)
    return docs, spark.createDataFrame([(i, y) for i, y in enumerate(labels)], f"doc_id bigint, {column} int")


def scores(docs, column):
    return {r["doc_id"]: r["s"] for r in docs.select("doc_id", column.alias("s")).collect()}


def test_toxicity_finds_misspelt_words(documents, spark):
    rng = random.Random(1)
    insults = ["blockhead", "numbskull", "dunderhead"]
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        if toxic := i % 2:
            words[rng.randrange(len(words))] = rng.choice(insults)
        texts.append(" ".join(words))
        labels.append(toxic)
    tests = ["w1 w2 blokhead w3", "w1 w2 numbskulls w3", "w1 w2 w9 w3", "", None, "DUNDERHEAD " * 30_000]
    docs, table = labelled(documents, spark, texts + tests, labels, "toxic")
    got = scores(docs, toxicity.toxicity_score(docs, table, fold("doc_id", 4) != 2))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == labels[i] for i in held) >= 0.95 * len(held)
    assert [got[400 + i] >= 0.3 for i in range(6)] == [True, True, False, False, False, True]
    assert got[403] == got[404] and all(0 <= s <= 1 for s in got.values())


def test_quality_learns_from_allowed_rows_only(documents, spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        if good := int(i % 3 > 0):
            texts.append(" ".join(words))
        else:
            texts.append(" | ".join(words) if i % 2 else " ".join([words[0]] * len(words)))
        labels.append(good)
    allowed = fold("doc_id", 5) != 0
    docs, table = labelled(documents, spark, [*texts, "", None, "### " * 40_000], labels, "quality")
    one = scores(docs, quality.quality_score(docs, table, allowed))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((one[i] >= 0.3) == labels[i] for i in held) >= 0.95 * len(held)
    assert one[300] == one[301] and all(0 <= s <= 1 for s in one.values())
    flipped = [1 - y if i in set(held) else y for i, y in enumerate(labels)]
    _, other = labelled(documents, spark, texts, flipped, "quality")
    two = scores(docs, quality.quality_score(docs, other, allowed))
    assert all(math.isclose(one[i], two[i], abs_tol=1e-6) for i in one)


@pytest.mark.parametrize("make", [toxicity.toxicity_score, quality.quality_score])
def test_labels_of_one_kind_or_none(documents, spark, make):
    column = "toxic" if make is toxicity.toxicity_score else "quality"
    for labels, expected in (([1] * 8, 0.9), ([], 0.5), ([None, None], 0.5)):
        docs, table = labelled(documents, spark, ["some text"] * 8, labels, column)
        found = scores(docs, make(docs, table, fold("doc_id", 4) != 99))
        assert all(math.isclose(s, expected, abs_tol=1e-6) for s in found.values())
    empty = documents([])
    assert empty.select(make(empty, table, fold("doc_id", 4) != 99)).count() == 0


def test_quality_does_not_depend_on_the_layout(documents, spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(150)]
    labels = [int(len(t) % 3 > 0) for t in texts]
    docs, table = labelled(documents, spark, [*texts, texts[0], None, ""], labels, "quality")
    allowed = fold("doc_id", 5) != 0
    found = [
        scores(d, quality.quality_score(d, t, allowed))
        for d, t in (
            (docs.coalesce(1), table.coalesce(1)),
            (docs.repartition(7, F.xxhash64("text")), table.repartition(5)),
            (docs.orderBy(F.desc("doc_id")), table.orderBy(F.desc("doc_id"))),
        )
    ]
    assert found[0] == found[1] == found[2]
    assert len(set(found[0].values())) > 100


def test_quality_features_equal_naive_ones(documents):
    texts = ["the cat sat on the mat .", "THE the cat", "", None, "a", "cat cat cat 12", "x|y " * 40]
    found = quality.word_vectors(documents(list(enumerate(texts))).repartition(3))
    places, signs = quality.index_vectors()
    own = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for bucket in range(quality.BUCKETS):
        for place, sign in zip(places[bucket], signs[bucket]):
            own[bucket, place] += sign
    around = np.zeros_like(own)
    tokens = [quality.token_buckets([t or ""])[0].tolist() for t in texts]
    for line in tokens:
        for i, here in enumerate(line):
            for j, there in enumerate(line):
                if 0 < abs(i - j) <= quality.CONTEXT:
                    around[here] += own[there]
    table = around / np.maximum(np.sqrt((around**2).sum(axis=1, keepdims=True)), 1e-6) + own
    assert np.allclose(found, table, atol=1e-5)
    for line, got in zip(tokens, quality.document_features([t or "" for t in texts], found)):
        size = len(line)
        naive = [0.0] * (quality.DIMENSIONS + 3)
        if size:
            naive[:-3] = sum(table[b] for b in line) / size
            naive[-3:] = math.log1p(size) / 10, max(map(line.count, line)) / size, len(set(line)) / size
        assert np.allclose(got, naive, atol=1e-5)


def test_sums_travel_exactly():
    sums = np.zeros(quality.CHUNK * quality.DIMENSIONS)
    for largest, size in ((2**24 + 1, 4), (-(2**31) + 1, 4), (2**31, 8), (2**52 + 1, 8)):
        sums[:3] = largest, -1, 7
        sent = quality.packed(sums)
        assert len(sent) == size * len(sums) and (quality.unpacked(sent) == sums).all()


def test_training_rows_are_bounded_by_ids(documents, spark):
    docs = documents([(i % 4, f"text {i}") for i in range(400)] + [(9, None)])
    labels = spark.createDataFrame(
        [(i % 4, i % 2) for i in range(40)] + [(9, 1), (None, 1), (3, None)], "doc_id bigint, y int"
    )
    rows, sizes = training_rows(docs, labels, "y", F.lit(True), 2, "doc_id", "text")
    assert sizes == {0: 20, 1: 21}
    assert rows.count() == 4 and rows.where("label = 0").count() == 2
    rows, _ = training_rows(docs, labels, "y", F.lit(True), 9, "doc_id", "text")
    assert sorted(map(tuple, rows.collect())) == [("", 1), ("text 0", 0), ("text 1", 1), ("text 10", 0), ("text 103", 1)]


def test_toxicity_scores_equal_naive_ones():
    random_numbers = np.random.Generator(np.random.PCG64(3))
    model = toxicity.ToxicityModel(0.3)
    model.margins = random_numbers.normal(0, 2, toxicity.BUCKETS).astype(np.float32)
    model.bias, model.curve = -0.7, np.array([1.3, 0.8, 0.2])
    texts = ["The cat, the CAT; sat", "", " -- ", "a", "ab abc abcd abcde", "word " * 50]

    def probability(x):
        return 1 / (1 + math.exp(-x))

    for text, got in zip(texts, model.scores(texts)):
        margins = []
        for word in re.findall(r"\w+", text.lower()):
            marked = f"<{word}>"
            grams = [marked] + [
                marked[i : i + n]
                for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1)
                if n < len(marked)
                for i in range(len(marked) - n + 1)
            ]
            buckets = [zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams]
            margins.append(sum(float(model.margins[b]) for b in buckets) / len(buckets) + model.bias)
        worst = max(margins, default=model.bias)
        share = sum(map(probability, margins)) / len(margins) if margins else probability(model.bias)
        naive = probability(1.3 * min(worst, toxicity.CERTAIN) + 0.8 * math.log(share) + 0.2)
        assert math.isclose(got, naive, rel_tol=1e-9), text


def test_text_buckets_do_not_depend_on_the_batch():
    texts = ["the cat ### sat", "", "THE the the 12", "x" * 3000]
    together, sizes = quality.token_buckets(texts)
    alone = [quality.token_buckets([t]) for t in texts]
    assert sizes.tolist() == [int(s[0]) for _, s in alone]
    assert together.tolist() == [b for t, _ in alone for b in t.tolist()]


# ---- registered queries -------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, expected = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    places = [expected.columns.index(c) for c in order]
    assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(
        tuple(r[p] for p in places) for r in expected.fetchall()
    )


def test_classifier_queries_on_held_out_rows(spark, sf_dir):
    """On the next larger tables: the smallest have too few labelled rows to learn from."""
    import duckdb

    folder = sf_dir.replace("sf0.001", "sf0.01")
    connection = duckdb.connect()
    (n,) = connection.execute(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchone()
    for name, column in (("op4_quality", "quality"), ("op7_toxicity", "toxic")):
        label = dict(connection.execute(f"SELECT doc_id, {column} FROM '{folder}/labels.parquet'").fetchall())
        rows = QUERIES[name](spark, folder).collect()
        assert len(rows) == n
        held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
        assert held and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.8 * len(held)


# ---- the pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, duck, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        if name != "packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
        after = spark.createDataFrame(after.collect(), after.schema)
        kept[name] = after
        before = after
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert ids["toxicity"] > ids["quality"] >= ids["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    assert ids["line_dedup"] == ids["quality"] == set(texts)
    expected = jaccard_by_brute_force(texts)
    assert ids["near_duplicates"] == {k for k, (_, component) in expected.items() if component == k}
    final = {r["doc_id"]: r["text"] for r in kept["near_duplicates"].collect()}
    check_packing(kept["packing"].collect(), final)
    assert corpus_pipeline.run(spark, sf_dir).columns == kept["packing"].columns


def test_pipeline_of_odd_documents(documents, spark, sf_dir):
    docs = documents([(1, None), (2, ""), (None, "a b"), (3, "same words here now please"), (4, "same words here now please")])
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((df := stage(spark, docs, sf_dir)).collect(), df.schema)
    assert {r["doc_id"] for r in docs.collect()} <= {1, 2, 3, None}


def test_stages_without_a_model_keep_odd_documents(documents, spark, sf_dir):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "same words here now please"), (4, "same words here now please")]
    docs, stages = documents(rows), dict(corpus_pipeline.STAGES)
    for name, ids in (("line_dedup", [1, 2, 3, 4, None]), ("near_duplicates", [1, 2, 3, None]), ("packing", [1, 2, 3, 4, None])):
        found = stages[name](spark, docs, sf_dir).select("doc_id").distinct().collect()
        assert sorted((r["doc_id"] for r in found), key=lambda i: i or 99) == ids, name
