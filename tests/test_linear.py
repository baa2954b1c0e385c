"""Columnar counting, the sparse solver, its certificate, and relational scores."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_models import DOCS, labeled, python_chars, python_words

from textrisk.operators import counting, features, linear
from textrisk.operators.certificate import optimality, sigmoid
from textrisk.operators.features import CHAR_BLOCK, WORD_BLOCK, fit_blocks, term_statistics, vocabulary
from textrisk.operators.models import EmbeddingDetector, TfidfDetector, feature_union
from textrisk.operators.split import with_class_weight

TEXTS = st.lists(st.text(max_size=40) | st.text("ab é\x00\x1c \n😀_1", max_size=40), max_size=6)


def per_text(counts, texts):
    out = [Counter() for _ in texts]
    for text, term, times in zip(counts.text, counts.term, counts.times):
        out[text][counts.terms[term]] += int(times)
    return out


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_counts_equal_plain_loops(texts):
    for count, plain in ((counting.count_words, python_words), (counting.count_chars, python_chars)):
        counts = count(texts)
        assert per_text(counts, texts) == [Counter(plain(text)) for text in texts]
        assert len(set(counts.terms)) == len(counts.terms) and (np.diff(counts.text) >= 0).all()
        total, rows = counts.per_term()
        assert total.sum() == sum(len(plain(t)) for t in texts)
        assert rows.sum() == sum(len(set(plain(t))) for t in texts)


def test_shared_hashes_do_not_merge_terms(monkeypatch):
    monkeypatch.setattr(counting, "_MIX", np.uint64(0))  # terms of equal first three letters collide
    texts = ["abcde abcdf abcd abc", "abcdg"]
    assert per_text(counting.count_chars(texts), texts) == [Counter(python_chars(t)) for t in texts]


def test_pieces_keep_order_and_nulls(monkeypatch):
    monkeypatch.setattr(counting, "PIECE_CHARS", 5)
    found = list(counting.pieces(pa.array(["abc", None, "defghijk", "", "x"])))
    assert found == [["abc", "", "defghijk"], ["", "x"]]


def test_both_vocabularies_come_from_one_pass(spark, texts):
    df = texts(*DOCS, None, "").repartition(3)
    both = {(r["block"], r["term"]): (r["corpus_freq"], r["doc_freq"]) for r in term_statistics(df, (WORD_BLOCK, CHAR_BLOCK)).collect()}
    for block, plain in enumerate((python_words, python_chars)):
        counted = [Counter(plain(d)) for d in DOCS]
        for term in set().union(*counted):
            assert both.pop((block, term)) == (sum(c[term] for c in counted), sum(term in c for c in counted))
    assert not both
    words, chars = fit_blocks(df, (WORD_BLOCK, CHAR_BLOCK))
    assert [len(b.weights.idf) for b in (words, chars)] == [vocabulary(df, s).count() for s in (WORD_BLOCK, CHAR_BLOCK)]
    plan = term_statistics(df, (WORD_BLOCK, CHAR_BLOCK))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


def fitted_blocks(spark, n=120):
    df = with_class_weight(labeled(spark, n).repartition(5), "target")
    blocks = fit_blocks(df, (WORD_BLOCK, CHAR_BLOCK))
    parts = [(b.spec.count, b.weights) for b in blocks]
    size = sum(len(b.weights.idf) for b in blocks) + 1
    return df, blocks, parts, size


def test_loss_and_gradient_equal_dense_arithmetic(spark):
    df, blocks, parts, size = fitted_blocks(spark)
    stored = linear.text_blocks(df, parts, "text", "target", "weight")
    at = np.random.default_rng(1).normal(size=size)
    rows = df.collect()
    x = np.zeros((len(rows), size))
    offsets, index, value = counting.sparse_rows([r["text"] for r in rows], parts, constant=True)
    x[np.repeat(np.arange(len(rows)), np.diff(offsets)), index] = value
    y, c = (np.array([r[name] for r in rows], float) for name in ("target", "weight"))
    margin = x @ at
    want = c @ (np.log1p(np.exp(-np.abs(margin))) + np.maximum(margin, 0) - y * margin)
    for fan in (32, 2):  # the second adds the sums of tasks in several steps
        loss, gradient = linear.evaluate(stored, at, 5, fan)
        assert np.isclose(loss, want)
        assert np.allclose(gradient, x.T @ (c * (1 / (1 + np.exp(-margin)) - y)))


def test_fit_reaches_the_optimum_of_a_penalised_constant(spark):
    df = labeled(spark, 150)
    detector = TfidfDetector.fit(df, tolerance=1e-9)
    found = optimality(detector.gradient(df)).first()
    assert found["coefficients"] == len(detector.coefficients)
    assert found["largest_gradient"] < 1e-6 and found["distance_bound"] == found["gradient_length"]
    assert abs(detector.coefficients[-1]) > 1e-3
    # The certificate sees a coefficient that is off.
    moved = detector.coefficients.copy()
    moved[-1] = 0.0
    worse = optimality(TfidfDetector(detector.blocks, moved).gradient(df)).first()
    assert worse["largest_gradient"] > 100 * found["largest_gradient"]
    assert worse["distance_bound"] >= abs(detector.coefficients[-1]) * 0.999


def test_embedding_certificate(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4) + (i % 3 == 0)], int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "Id int, embedding array<float>, target int")
    found = optimality(EmbeddingDetector.fit(df, tolerance=1e-10).gradient(df), intercept=True).first()
    assert found["coefficients"] == 5 and found["largest_gradient"] < 1e-4 and found["distance_bound"] is None


def test_unknown_targets_fail_the_fit(spark):
    df = labeled(spark, 30).withColumn("target", F.when(F.col("Id") == "3", 2).otherwise(F.col("target")))
    with pytest.raises(Exception, match="targets must be 0 or 1"):
        TfidfDetector.fit(df)


def test_relational_scores_equal_the_vectors(spark):
    df = labeled(spark, 90)
    detector = TfidfDetector.fit(df)
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "zzz unseen"), ("d", "the summer garden and a rule")], "Id string, text string")
    both = detector.score(odd, "text", "s").join(detector.relational_score(odd, "text", "r"), "Id").collect()
    assert len(both) == 4 and all(abs(r["s"] - r["r"]) < 1e-12 for r in both)
    bare = 1 / (1 + np.exp(-detector.coefficients[-1]))
    assert all(np.isclose(r["s"], bare) for r in both if r["Id"] in "ab")
    vectors = feature_union(odd, detector.blocks).select(F.unwrap_udt("features")["size"].alias("n")).distinct().collect()
    assert [r["n"] for r in vectors] == [len(detector.coefficients)]


def test_sigmoid_does_not_overflow(spark):
    rows = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    assert [r[0] for r in rows.select(sigmoid(F.col("x"))).collect()] == [0.0, 0.5, 1.0]


def test_vectors_are_made_piece_by_piece(spark, texts, monkeypatch):
    block = fit_blocks(texts(*DOCS), (WORD_BLOCK,))[0]
    monkeypatch.setattr(counting, "PIECE_CHARS", 5)
    made = list(features._vectors([block], True).func(iter([pa.array([*DOCS, None, ""])])))
    assert len(made) > 1 and sum(len(part) for part in made) == len(DOCS) + 2


def test_relational_scores_shuffle_no_terms(spark):
    df = labeled(spark, 30)
    plan = TfidfDetector.fit(df).relational_score(df, "text", "r")._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1].split(", 4)")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all(keys.split("#")[0] == "_row" and "," not in keys for keys in dealt)


def test_the_solver_needs_few_passes(monkeypatch):
    # Curvatures from 1 to 10,000: steps that look further back come to the optimum sooner.
    curve, pull = np.logspace(0, 4, 60), np.random.default_rng(5).normal(size=60)
    now, steps, passes = np.zeros(60), [], 0
    gradient = -pull
    while np.linalg.norm(gradient) > 1e-9 and passes < 400:
        along = linear._direction(gradient, steps)
        step = -(gradient @ along) / (along @ (curve * along)) * along
        now, passes = now + step, passes + 1
        steps = [*steps, (step, curve * step)][-linear._MEMORY :]
        gradient = curve * now - pull
    assert np.allclose(now, pull / curve) and linear._MEMORY >= 30


@given(TEXTS, st.lists(st.booleans(), min_size=8, max_size=8))
@settings(max_examples=200, deadline=None)
def test_wanted_slots_drop_no_term_of_theirs(texts, chosen):
    every = counting.count_words(texts)
    hashes = counting.word_hashes(texts)
    table = counting.slots_holding(hashes[np.resize(chosen, len(hashes))])
    some = counting.count_words(texts, table)
    whole, part = per_text(every, texts), per_text(some, texts)
    kept = set(some.terms)
    assert [Counter({t: n for t, n in counts.items() if t in kept}) for counts in whole] == part
    known = counting.Weights.of(every.terms[::2], np.ones(len(every.terms[::2])))
    assert set(every.terms[::2]) <= set(known.counts(counting.count_words, texts).terms) <= set(every.terms)
    assert len(hashes) == every.times.sum()


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(counting, "_BASE", np.uint64(0))  # words of equal first letters collide
    texts = ["ab ac abc ab", "ad ab", "É_1 éa"]
    assert per_text(counting.count_words(texts), texts) == [Counter(python_words(t)) for t in texts]


def test_slot_counts_add_up_in_every_width():
    whole, parts = counting.SlotCounts(), counting.SlotCounts()
    hashes = np.array([5, 5, 1 << 63, 7 << 20, 2**64 - 1], np.uint64)
    for _ in range(3):
        part = counting.SlotCounts()
        part.add(hashes)
        part.table[0, 9] = 1 << 17
        part.table[1, 9] = 1 << 33
        whole.table += part.table
        for row in part.rows():
            parts.add_row(*row)
    assert np.array_equal(whole.table, parts.table) and parts.table[0, 5] == 6
    assert len({len(counts) for _, counts in parts.rows()}) == 3


def test_the_vocabulary_is_found_without_shuffling_rare_terms(spark, monkeypatch):
    # 40 frequent words and their pairs among 4,000 that occur twice and 2,000 that one text repeats.
    texts = [" ".join([*(f"often{j}" for j in range(i % 41)), f"rare{i % 4000}"]) for i in range(8000)]
    texts += [" ".join([f"alone{i}"] * 60) for i in range(2000)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "Id int, text string").repartition(3)
    counted = Counter(t for text in texts for t in python_words(text))
    held = Counter(t for text in texts for t in set(python_words(text)))
    made = []
    monkeypatch.setattr(features, "materialized", lambda d, name: made.append(d.cache()) or made[-1])
    # At a limit of 70 terms the repeated ones fill the slots that are looked at first and second.
    for limit, passes in ((30, 1), (70, 3), (100_000, 1)):
        made.clear()
        spec = features.TermSpec("word", features.word_terms, counting.count_words, 2, 0.5, limit)
        eligible = [t for t in counted if 2 <= held[t] <= 0.5 * (len(texts) + 2)]
        want = sorted(eligible, key=lambda t: (-counted[t], t))[:limit]
        got = {r["term"]: (r["corpus_freq"], r["doc_freq"]) for r in vocabulary(df, spec).collect()}
        assert got == {t: (counted[t], held[t]) for t in want}
        assert len(made) == passes
        if limit == 30:
            whole = term_statistics(df, [spec]).where("doc_freq >= 2").count()
            assert made[0].count() < whole / 10
        for table in made:
            table.unpersist()


def test_blocks_take_few_bytes_and_give_exact_sums():
    rng = np.random.default_rng(7)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(60)]
    texts += ["", "often " * 700 + "seldom", "none of these", "word1 word1 word2999"]
    terms = sorted({term for text in texts[:62] for term in python_words(text)})
    grams = sorted({term for text in texts[:62] for term in python_chars(text)})
    parts = [
        (counting.count_words, counting.Weights.of(terms, 1 + np.arange(len(terms)) % 9 / 7)),
        (counting.count_chars, counting.Weights.of(grams, 1 + np.arange(len(grams)) % 5 / 3)),
    ]
    offsets, index, value = counting.sparse_rows(texts, parts, constant=True)
    size = len(terms) + len(grams) + 1
    at, target, weight = rng.normal(size=size), rng.integers(0, 2, len(texts)), rng.uniform(1, 2, len(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    margin = np.bincount(owner, value * at[index], len(texts))
    error = weight * (1 / (1 + np.exp(-margin)) - target)
    columns = *linear._packed_rows(texts, parts, True), target.astype(float), weight
    block = dict(zip(linear._NAMES, map(bytes, columns)))
    # An index and a value would be twelve bytes an entry.
    assert sum(map(len, block.values())) < 4 * len(index)
    gradient = np.ones(size)
    loss = linear._loss_and_gradient(at, block, gradient)
    assert np.isclose(loss, weight @ (np.logaddexp(0, margin) - target * margin), rtol=1e-12)
    assert np.allclose(gradient - 1, np.bincount(index, value * error[owner], size), rtol=1e-11, atol=1e-12)


@given(st.lists(st.integers(-(2**40), 2**40) | st.integers(-3, 260)))
def test_packed_numbers_come_back(numbers):
    assert counting.unpacked(*counting.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_large_rows_are_written_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    rows = spark.range(0, 60, numPartitions=1).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 8192).cast("binary").alias("b"))
    stored = linear.materialized(rows, "large-rows", {**linear._STORED, "compression": "none"})
    (path,) = (f for f in stored.inputFiles() if f.endswith(".parquet"))
    groups = pq.ParquetFile(path.removeprefix("file://")).metadata
    # 30 MB of 0.5 MB rows: a writer that waits for 100 rows holds all of them.
    assert groups.num_rows == 60 and groups.num_row_groups >= 3


def test_workers_get_small_batches_inside_only(spark):
    from textrisk.session import small_batches

    def largest():
        sizes = spark.range(0, 40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(
            lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long"
        )
        return max(r["n"] for r in sizes.collect())

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given in (before, "60m"):
            spark.conf.set(name, given)
            with pytest.raises(ValueError), small_batches(spark):
                assert largest() < 16 << 20
                raise ValueError
            assert spark.conf.get(name) == given
            assert largest() > 32 << 20
    finally:
        spark.conf.set(name, before)


def test_a_tally_adds_up_pieces():
    tally = counting.Tally()
    texts = ["ab cd ab", "cd ef", "gh"]
    for text in texts:
        tally.add(counting.count_words([text, text]))
    terms, total, held = tally.taken()
    assert dict(zip(terms, zip(total.tolist(), held.tolist())))["cd"] == (4, 4)
    assert dict(zip(terms, total.tolist())) == Counter(t for text in texts * 2 for t in python_words(text))
    assert [len(part) for part in tally.taken()] == [0, 0, 0]


def test_the_certificate_counts_texts_once(spark):
    df = labeled(spark, 60)
    detector = TfidfDetector.fit(df)
    both = feature_union(detector.score(df, "text", "alone"), detector.blocks, score=("score", detector.coefficients))
    assert all(abs(r["alone"] - r["score"]) < 1e-12 for r in both.select("alone", "score").collect())
    one = feature_union(df, detector.blocks, score=("score", detector.coefficients)).select("score", "features")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert one.select("features").collect() == feature_union(df, detector.blocks).select("features").collect()
