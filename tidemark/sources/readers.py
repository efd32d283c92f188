"""Scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..skew import spread_join

CORRUPT = "_corrupt"


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False, header: bool = True
) -> DataFrame:
    """Delimited text, gzip or plain, local or object store; quotes are doubled inside fields.

    A gzip file is one task however large it is, so convert it once: ``read_csv(...)`` then
    ``writers.write_parquet``. Without a schema the types are inferred, which costs a second pass.
    With one, header names must be the schema's, in its order: a reordered extract is an error, not a
    wrong result. A line that does not fit has null where a field is unreadable; a string column
    :data:`CORRUPT` in the schema then holds the line, so that it can be counted.
    """
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("enforceSchema", not header).option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    """The schema with a last column for lines that do not fit it."""
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the scan below is pruned to them."""
    return df.select(*columns)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def for_entities(df: DataFrame, ids: DataFrame, key: str = "SUBJECT_ID", spread_by: list[str] | None = None) -> DataFrame:
    """Rows whose entity is in ``ids`` (one row per entity)."""
    return spread_join(df, ids.select(key), key, "left_semi", spread_by=spread_by)


def read_svmlight(spark: SparkSession, path: str, zero_based: bool = True, entity_prefix: bool = False) -> DataFrame:
    """svmlight text as ``(entity_id?, label, indices, values)``, one row per line."""
    cells = F.filter(F.split("value", " "), lambda cell: cell != "")
    lead = 2 if entity_prefix else 1
    pairs = F.transform(F.slice("cells", lead + 1, F.greatest(F.size("cells") - lead, F.lit(0))), lambda c: F.split(c, ":"))
    shift = 0 if zero_based else 1
    columns = [F.col("cells")[0].cast("bigint").alias("entity_id")] if entity_prefix else []
    return (
        spark.read.text(path)
        .select(cells.alias("cells"))
        .select(
            *columns,
            F.col("cells")[lead - 1].cast("double").alias("label"),
            F.transform(pairs, lambda p: p[0].cast("int") - shift).alias("indices"),
            F.transform(pairs, lambda p: p[1].cast("double")).alias("values"),
        )
    )


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """One-based svmlight text as ``(label, features)`` with sparse vectors of the declared width."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)
