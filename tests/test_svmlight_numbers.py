"""Spelling of values in svmlight lines."""

from pyspark.sql import functions as F

from tidemark.operators import features


def test_values_are_spelled_as_six_decimals(spark):
    """Numbers of any size, and what is none, read as the general format would write the rounded value."""
    values = [0.1234565, -0.0, 1e-7, -1e-7, 123456789.1234567, 1e15, 1e300, float("nan"), float("inf"), None, -5.5, 999999999999999.0, 2 / 3]
    long = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "entity_id long, feature string, value double")
    codes = spark.createDataFrame([("a", 0)], "feature string, idx long")
    labels = spark.createDataFrame([(i, 1) for i in range(len(values))], "entity_id long, label int")
    wanted = {r.entity_id: f"1 0:{r.s} " for r in long.select("entity_id", F.format_string("%.6f", F.round("value", 6)).alias("s")).collect()}
    assert dict(features.svmlight_lines(long, codes, labels).collect()) == wanted
