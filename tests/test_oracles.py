"""Every registered query with an SQL form, all rows compared on the smallest data."""

import pytest
from compare import compare
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

ORACLES = oracle_sql()
MAY_BE_EMPTY = {"period_parity", "code_group_events", "code_group_entities"}
SLOW_MODELS = {"model_roundtrip", "model_score_rows", "importance_check"}


@pytest.mark.parametrize("name", sorted(ORACLES.keys() - SLOW_MODELS))
def test_same_rows_as_sql(spark, name):
    # thresholds leave nothing at the smallest scale for these two
    folder = "/root/testdata/sf0.01" if name in ("med_features", "sink_csv") else SMALL
    out = compare(spark, folder, name, queries()[name], ORACLES[name])
    assert out["ok"], out
    assert out["rows"] > 0 or name in MAY_BE_EMPTY


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= queries().keys()


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["entity_id", "feature", "value_mean", "value_max", "value_min"]
    assert result.count() > 0


def test_hashing_tfidf_rows(spark):
    out = compare(spark, SMALL, "hashing_tfidf", queries()["hashing_tfidf"], None)
    assert out["ok"]


@pytest.mark.parametrize("name", ["lab_features", "svmlight_lines", "cohort_auc", "last_note"])
def test_same_rows_without_broadcast(spark, name):
    """The way taken when no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = queries()[name](spark, SMALL)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        out = compare(spark, SMALL, name, queries()[name], ORACLES[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out["ok"], out
    assert "SortMergeJoin" in plan
