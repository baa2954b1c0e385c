"""Registered queries against their SQL counterparts, at the smallest scale."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from workload.oracles import ORACLES
from workload.queries import QUERIES

# Covered by their own tests, or long-running.
_SLOW = {"tfidf_char", "feature_union", "train_model_a", "score_model_a", "model_report"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(tidy, key=lambda row: tuple((v is None, "" if v is None else v) for v in row))


@pytest.mark.parametrize("name", sorted(set(ORACLES) - _SLOW))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    got = canonical([tuple(r) for r in result.collect()], result.columns)
    assert got == canonical(expected.fetchall(), expected.columns)
    assert got


def test_overlay_exercises_every_rule_signal_and_decision(spark, sf_dir):
    assert QUERIES["rule_hit_counts"](spark, sf_dir).count() == 8
    assert QUERIES["decision_counts"](spark, sf_dir).count() == 3
    for name in ("scan_batch_flat", "scan_conversations", "scan_pages"):
        decided = {r["decision"] for r in QUERIES[name](spark, sf_dir).select("decision").collect()}
        assert decided == {"allow", "warn_sanitize", "block"}, name
    signals = "|".join(
        r["signals"] for r in QUERIES["anomaly_signals"](spark, sf_dir).distinct().collect()
    )
    for name in ("zero_width", "control", "unusual_whitespace", "mixed_latin"):
        assert name in signals
    kept = {r["kept"] for r in QUERIES["negated_exfil"](spark, sf_dir).collect()}
    assert kept == {0, 1}


def test_entry_module(spark):
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("__spark_entry__", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).columns[0] == "Id"


def test_plans_stay_narrow(spark, sf_dir):
    """One Arrow step, pruned columns, and no shuffle."""
    plan = QUERIES["scan_batch_flat"](spark, sf_dir)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1
    assert "Exchange" not in physical
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in physical
