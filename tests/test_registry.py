"""Versions of models, and the join that checks itself."""

import pytest
from pyspark.sql import functions as F
from test_models import embedded

from textrisk.operators.joins import join_mismatch, join_one_to_one
from textrisk.operators.models import EmbeddingDetector
from textrisk.plans import registry


def test_a_failed_publication_leaves_the_version_before_it(spark, tmp_path):
    path = str(tmp_path / "models")
    detector = EmbeddingDetector.fit(embedded(spark, 60))
    assert registry.publish_detector(spark, path, detector, {"by": "test"}) == 1

    class Broken:
        artifact_type = detector.artifact_type

        def save(self, folder):
            detector.classifier.write().save(f"{folder}/classifier")
            raise OSError("out of disk")

    with pytest.raises(OSError):
        registry.publish_detector(spark, path, Broken())

    class Half(Broken):  # written without an error, but not whole
        def save(self, folder):
            detector.classifier.write().save(f"{folder}/classifier")

    with pytest.raises(Exception):
        registry.publish_detector(spark, path, Half())
    number, folder, note = registry.published(spark, path)
    assert number == 1 and note == {"artifact_type": detector.artifact_type, "by": "test"}
    assert registry.current_detector(spark, path).threshold == detector.threshold
    # A record that was written aside but never renamed is not seen.
    (tmp_path / "models" / "records" / ".aside").write_text('{"folder": "versions/none"')
    assert registry.published(spark, path)[0] == 1


def test_versions_count_up_and_stay(spark, tmp_path):
    path = str(tmp_path / "notes")
    with pytest.raises(LookupError):
        registry.published(spark, path)
    for text in ("first", "second", "third"):
        registry.publish(spark, path, lambda folder, text=text: spark.range(1).selectExpr(f"'{text}' AS t").write.parquet(folder), {"t": text})
    assert [r["version"] for r in registry.versions(spark, path).orderBy("version").collect()] == [1, 2, 3]
    assert spark.read.parquet(registry.published(spark, path, 2)[1]).first()["t"] == "second"
    assert registry.published(spark, path)[2] == {"t": "third"}
    with pytest.raises(LookupError):
        registry.published(spark, path, 9)


def tables(spark, left, right):
    return spark.createDataFrame(left, "Id string, a int"), spark.createDataFrame(right, "b string, Id bigint")


def test_checked_join_pairs_rows(spark):
    left, right = tables(spark, [("1", 5), ("2", None), ("3", 7)], [("x", 3), (None, 1), ("z", 2)])
    out = join_one_to_one(left, right)
    assert out.columns == ["Id", "a", "b"]
    assert sorted(map(tuple, out.collect())) == [("1", 5, None), ("2", None, "z"), ("3", 7, "x")]
    some = join_one_to_one(left, right.where("Id > 1"), how="left")
    assert sorted(map(tuple, some.collect())) == [("1", 5, None), ("2", None, "z"), ("3", 7, "x")]
    assert join_one_to_one(left.limit(0), right.limit(0)).count() == 0


@pytest.mark.parametrize("left, right, fault", [
    ([("1", 1), ("1", 2)], [("x", 1)], "'left_repeated': 1"), ([("1", 1)], [("x", 1), ("y", 1)], "'right_repeated': 1"),
    ([("1", 1), ("2", 1)], [("x", 1)], "'only_left': 1"), ([("1", 1)], [("x", 1), ("x", 4)], "'only_right': 1"),
    ([("1", 1), (None, 1)], [("x", 1), ("y", None)], "'only_right': 1, 'only_left': 1"),
])
def test_checked_join_raises_what_does_not_fit(spark, left, right, fault):
    left, right = tables(spark, left, right)
    with pytest.raises(ValueError, match=fault):
        join_one_to_one(left, right)


def test_checked_left_join_allows_unmatched_keys_only(spark):
    left, right = tables(spark, [("1", 1), ("2", 1)], [("x", 1), ("y", 8)])
    assert join_one_to_one(left, right, how="left").where("b IS NULL").count() == 1
    with pytest.raises(ValueError, match="right_repeated"):
        join_one_to_one(left, right.unionAll(right), how="left")


def test_checked_join_agrees_with_the_report(spark):
    left, right = tables(spark, [(str(i), i) for i in range(30)], [(str(i), i) for i in range(5, 40)])
    with pytest.raises(ValueError, match="'only_right': 10, 'only_left': 5"):
        join_one_to_one(left, right)
    found = join_mismatch(left, right).first()
    assert (found["only_right"], found["only_left"], found["matched"]) == (10, 5, 25)
