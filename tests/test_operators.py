import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textrisk.functions import labels, risk
from textrisk.operators import checks, joins, metrics, profile
from textrisk.operators import split as splits
from textrisk.operators.fingerprint import fingerprint_value
from textrisk.operators.ordering import exact_percentiles, with_row_index
from textrisk.plans.profile_dataset import profile_dataset
from textrisk.sources.tables import (
    load_labeled,
    missing_files,
    read_document,
    read_report,
    write_document,
    write_report,
)


def outcome(spark, tn, fp, fn, tp):
    cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = spark.createDataFrame(cells, "target int, prediction int, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).select("target", "prediction")


@pytest.mark.parametrize(
    "cells, expected, utility",
    [
        ((421, 59, 28, 292), (0.89125, 0.83191, 0.9125, 0.87034, 0.12292, 0.0875), 1.3047),
        ((437, 43, 44, 276), (0.89125, 0.86520, 0.8625, 0.86385, 0.08958, 0.1375), 1.2631),
    ],
)
def test_published_confusion_matrices(spark, cells, expected, utility):
    out = metrics.binary_metrics(outcome(spark, *cells))
    row = out.withColumn("cm", metrics.confusion_matrix()).first()
    assert [round(row[c], 5) for c in metrics.RATIOS] == list(expected)
    assert row["cm"] == [list(cells[:2]), list(cells[2:])]
    value = risk.security_utility(
        F.col("recall_jailbreak"), F.col("f1_jailbreak"), F.col("false_positive_rate")
    )
    assert round(out.select(value).first()[0], 4) == utility


def pair_auc(rows):
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    tied = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    # Nearly all scores in a narrow range, and one score on a third of the rows.
    skewed = [(rng.randint(0, 1), rng.random() ** 9) for _ in range(200)] + [(0, 0.5)] * 100
    single = [(1, 0.2), (1, 0.9)]
    rows = [(g, t, s) for g, part in (("a", tied), ("b", skewed), ("c", single)) for t, s in part]
    df = spark.createDataFrame(rows, "g string, target int, score double")
    df = df.withColumn("prediction", risk.over_threshold(F.col("score"), 0.5))
    out = {r["g"]: r for r in metrics.binary_metrics(df, score="score", by=["g"]).collect()}
    assert math.isclose(out["a"]["roc_auc"], pair_auc(tied))
    assert math.isclose(out["b"]["roc_auc"], pair_auc(skewed))
    assert out["c"]["roc_auc"] is None and out["c"]["false_positive_rate"] == 0.0
    whole = metrics.binary_metrics(df, score="score").first()
    assert math.isclose(whole["roc_auc"], pair_auc(tied + skewed + single))


def test_empty_denominators_give_zero(spark):
    rows = outcome(spark, 3, 1, 1, 1).filter("target = 0 and prediction = 0")
    row = metrics.binary_metrics(rows).first()
    assert row["precision_jailbreak"] == row["f1_jailbreak"] == row["false_negative_rate"] == 0.0
    assert row["accuracy"] == 1.0 and row["support_jailbreak"] == 0


def test_sweep_against_each_threshold(spark):
    rng = random.Random(5)
    scores = [i / 100 for i in range(101)] + [rng.random() for _ in range(200)] + [0.29, 0.57, 0.58]
    rows = [(rng.randint(0, 1), s) for s in scores]
    df = spark.createDataFrame(rows, "target int, score double")
    out = {round(r["threshold"], 2): r for r in metrics.threshold_sweep(df).collect()}
    assert len(out) == 61
    for hundredth in range(20, 81):
        t = hundredth / 100
        row = out[t]
        assert row["tp"] == sum(s >= t and y == 1 for y, s in rows), t
        assert row["fp"] == sum(s >= t and y == 0 for y, s in rows), t
        assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == len(rows)


def test_unscored_rows_are_counted_and_reach_no_threshold(spark):
    rows = [(1, 1, 0.9), (0, 0, 0.1), (1, None, None), (None, 1, 0.8), (0, 0, float("nan")), (2, 1, 0.5)]
    df = spark.createDataFrame(rows, "target int, prediction int, score double")
    row = metrics.binary_metrics(df, score="score").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["unscored_rows"]) == (2, 0, 0, 1, 3)
    assert row["support_benign"] + row["support_jailbreak"] + row["unscored_rows"] == len(rows)
    odd = df.where("target in (0, 1)").select("target", "score")
    swept = metrics.threshold_sweep(odd).collect()
    assert all(r["fp"] == 0 and r["tp"] <= 1 and r["tn"] == 2 for r in swept)


def test_equal_thresholds_prefer_the_higher(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "target int, score double")
    best = metrics.best_threshold(metrics.threshold_sweep(df)).first()
    assert best["threshold"] == 0.8 and best["f1_jailbreak"] == 1.0
    assert metrics.choose_threshold(df) == 0.8


def test_model_selection(spark):
    schema = (
        "name string, status string, recall_jailbreak double, f1_jailbreak double,"
        " false_positive_rate double"
    )

    def chosen(*rows):
        return metrics.select_primary(spark.createDataFrame(rows, schema)).first()["name"]

    a = ("model_a", "trained", 0.9, 0.8, 0.1)
    assert chosen(a, ("model_b", "trained", 0.95, 0.8, 0.1)) == "model_b"
    assert chosen(a, ("model_b", "not_attempted", 0.95, 0.8, 0.1)) == "model_a"
    assert chosen(a, ("model_b", "trained", 0.9, 0.8, 0.1)) == "model_a"


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(size=130_000), np.full(65_000, 1.5), [1e6, -3.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(6)
    row = exact_percentiles(df, "v", (0.5, 0.95, 0.0, 1.0, 0.123)).first()
    for q, name in ((50, "p50"), (95, "p95"), (0, "p0"), (100, "p100"), (12.3, "p12_3")):
        assert math.isclose(row[name], float(np.percentile(values, q))), name
    assert row["n"] == len(values) and math.isclose(row["mean"], float(values.mean()))
    small = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert math.isclose(exact_percentiles(small, "v", (0.95,)).first()["p95"], 9.2)
    rough = exact_percentiles(df, "v", (0.5,), approximate=True).first()
    assert rough["n"] == len(values)


def test_row_index_is_global_and_survives_ties(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    rows = with_row_index(df, ("k",)).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(1000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_split_shares_are_exact_and_stable(spark, tmp_path):
    df = spark.range(1003).select(
        F.col("id").cast("string").alias("Id"),
        F.lit("t").alias("text"),
        (F.col("id") % 3 == 0).cast("int").alias("target"),
    )
    first = splits.with_partition(df)
    counts = {
        (r["target"], r["partition"]): r["count"]
        for r in first.groupBy("target", "partition").count().collect()
    }
    n1, n0 = 335, 668
    assert counts[(1, "validation")] == round(0.2 * n1)
    assert counts[(0, "validation")] == round(0.2 * n0)
    again = splits.with_partition(df.repartition(7))
    assert first.exceptAll(again).isEmpty()
    other = splits.with_partition(df, seed=43)
    assert not first.exceptAll(other).isEmpty()
    path = str(tmp_path / "split")
    made = [p.count() for p in splits.make_or_load_split(df, path)]
    loaded = [p.count() for p in splits.make_or_load_split(df, path)]
    assert made == loaded == [1003 - 67 - 134, 67 + 134]
    with pytest.raises(ValueError):
        splits.make_or_load_split(df.withColumn("Id", F.concat(F.lit("x"), "Id")), path)


def test_split_finds_its_cuts_apart_from_marking(spark):
    rng = random.Random(5)
    ids = [f"r{rng.randrange(400)}" for _ in range(900)] + [None, None, ""]
    rows = [(i, int((i or "0").endswith(("1", "2", "3")))) for i in ids]
    df = spark.createDataFrame(rows, "Id string, target int").repartition(5)
    for share in (0.0, 0.001, 0.2, 0.5, 1.0):
        cuts = splits.cutoffs(df, validation_size=share, seed=9)
        marked = [tuple(r) for r in splits.mark_partition(df, cuts, seed=9).collect()]
        for value in (0, 1):
            of_id = Counter(i or "" for i, target in rows if target == value)
            order = sorted(of_id, key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
            left, chosen = round(share * sum(of_id.values())), set()
            for i in order:
                if of_id[i] > left:
                    break
                left -= of_id[i]
                chosen.add(i)
            got = {(i or "", p) for i, target, p in marked if target == value}
            assert got == {(i, "validation" if i in chosen else "train") for i in of_id}, share
    later = splits.mark_partition(spark.createDataFrame([("r7", 1)], "Id string, target int"), cuts, seed=9)
    assert later.first()["partition"] == "validation"
    assert splits.cutoffs(df.limit(0)) == {}
    assert splits.with_partition(df.limit(0)).isEmpty()


def test_split_is_a_narrow_plan_over_one_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).selectExpr("cast(id as string) Id", "id % 2 target", "'t' text").write.parquet(path)
    plan = splits.with_partition(spark.read.parquet(path))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("FileScan") == 1
    assert "Exchange" not in physical and "Join" not in physical


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "target int")
    weights = {r["target"]: r["weight"] for r in splits.class_weights(df).collect()}
    assert weights == {0: 4 / 6, 1: 2.0}
    assert splits.with_class_weight(df).agg(F.sum("weight")).first()[0] == pytest.approx(4.0)


def test_checks(spark):
    good = spark.createDataFrame([("1", "a", "benign"), ("2", "b", "1")], "Id string, text string, label string")
    assert [r["target"] for r in load_labeled(good).orderBy("Id").collect()] == [0, 1]
    with pytest.raises(ValueError, match="schema"):
        load_labeled(good.select("text", "Id", "label"))
    bad = good.unionAll(spark.createDataFrame([("3", "c", "odd"), ("4", "d", "evil")], good.schema))
    with pytest.raises(ValueError, match="2 labels.*evil.*odd"):
        load_labeled(bad)
    with pytest.raises(ValueError, match="null"):
        load_labeled(good.unionAll(spark.createDataFrame([("3", None, "0")], good.schema)))
    scores = spark.createDataFrame([(0.5, 1.2), (float("nan"), 0.0), (None, 1.0)], "a double, b double")
    found = {r["component"]: r["violations"] for r in checks.score_range_violations(scores, ["a", "b"]).collect()}
    assert found == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        checks.require_scores_in_range(scores, ["a"])
    with pytest.raises(ValueError):
        checks.require_rows(good.limit(0))
    with pytest.raises(RuntimeError):
        checks.require_frozen({"status": "open"}, ["x"])
    with pytest.raises(ValueError):
        checks.require_frozen({"status": "frozen", "model": {"artifact_type": "y"}}, ["x"])


def test_truth_column_is_found(spark):
    df = spark.createDataFrame([("1", "attack"), ("2", "safe"), ("3", "?")], "Id string, ground_truth string")
    known = labels.with_truth(df.where("Id <> '3'")).orderBy("Id").collect()
    assert [r["_target"] for r in known] == [1, 0]
    with pytest.raises(Exception, match="outside the domain: \\?"):
        labels.with_truth(df).collect()
    nothing = spark.createDataFrame([("1", None)], "Id string, label string")
    with pytest.raises(Exception, match="outside the domain: null"):
        labels.with_truth(nothing).collect()
    with pytest.raises(ValueError):
        labels.with_truth(df.select("Id"))


def test_one_to_one_joins(spark):
    left = spark.createDataFrame([("1", 1), ("2", 2)], "Id string, a int")
    right = spark.createDataFrame([("1", 5), ("2", 6)], "Id string, b int")
    assert joins.join_one_to_one(left, right).count() == 2
    with pytest.raises(ValueError):
        joins.join_one_to_one(left, right.unionAll(right.limit(1)))
    with pytest.raises(ValueError):
        joins.join_one_to_one(left, right.filter("Id = '1'"))
    assert joins.join_one_to_one(left, right.filter("Id = '1'"), how="left").count() == 2
    extra = right.filter("Id = '2'").unionAll(spark.createDataFrame([("9", 0)], right.schema))
    sides = {r["key"]: r["only_in"] for r in joins.unmatched_keys(left, extra).collect()}
    assert sides == {"1": "left", "9": "right"}


def test_fingerprint_sees_rows_but_not_their_order(spark):
    df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id") % 9).alias("text"))
    base = fingerprint_value(df)
    assert fingerprint_value(df.orderBy(F.desc("id")).repartition(7)) == base
    assert fingerprint_value(df.filter("id <> 3")) != base
    assert fingerprint_value(df.unionAll(df.filter("id = 3"))) != base
    changed = df.withColumn("text", F.when(F.col("id") == 3, "t").otherwise(F.col("text")))
    assert fingerprint_value(changed) != base
    shifted = spark.createDataFrame([("ab", "c")], "a string, b string")
    assert fingerprint_value(shifted) != fingerprint_value(
        spark.createDataFrame([("a", "bc")], "a string, b string")
    )


def test_profile(spark, texts):
    df = texts("a", "b", "a", "a")
    assert tuple(profile.duplicate_texts(df).first()) == (4, 2)


def test_reports_and_folders(spark, tmp_path):
    path = str(tmp_path / "doc")
    write_document(spark, {"chữ": [1, {"a": None}]}, path)
    assert read_document(spark, path) == {"chữ": [1, {"a": None}]}
    table = str(tmp_path / "report")
    rows = [(1, "x"), (2, None), (3, "z")]
    write_report(spark.createDataFrame(rows, "a int, b string"), table)
    assert sorted(map(tuple, read_report(spark, table).collect())) == rows
    (tmp_path / "data" / "inner").mkdir(parents=True)
    (tmp_path / "data" / "inner" / "train.csv").write_text("Id,text,label\n")
    (tmp_path / "data" / "test.csv").write_text("Id,text\n")
    found = [r["name"] for r in missing_files(spark, str(tmp_path / "data")).collect()]
    assert found == ["sample_submission.csv"]


def test_dataset_profile(spark, tmp_path):
    folder = tmp_path / "set"
    (folder / "in").mkdir(parents=True)
    (folder / "in" / "train.csv").write_text('Id,text,label\n1,"a\nb",benign\n2,x,1\n3,x,0\n')
    (folder / "test.csv").write_text("Id,text\n7,q\n")
    with pytest.raises(FileNotFoundError, match="sample_submission"):
        profile_dataset(spark, str(folder))
    (folder / "sample_submission.csv").write_text("Id,TARGET\n7,0\n")
    found = profile_dataset(spark, str(folder))
    assert found.summary.first().asDict() == {
        "train_rows": 3, "benign_rows": 2, "jailbreak_rows": 1,
        "test_rows_unlabeled": 1, "duplicate_texts": 1,
    }
    assert {r["value"]: r["rows"] for r in found.targets.collect()} == {"0": 2, "1": 1}
    (folder / "sample_submission.csv").write_text("Id,other\n7,0\n")
    with pytest.raises(Exception, match="header"):
        profile_dataset(spark, str(folder))


def test_split_refuses_other_classes(spark):
    df = spark.createDataFrame([("1", 0), ("2", 2)], "Id string, target int")
    with pytest.raises(Exception, match="0 or 1"):
        splits.with_partition(df).collect()
