"""Sinks. Paths are folders in a store every executor can reach."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMBEDDING


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes, so ``readers.read_csv`` gives the rows back."""
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **keep_blanks).csv(path)


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet; ``files`` spreads rows first, for input that arrives as one gzip task."""
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def write_feature_families(families: dict[str, DataFrame], base: str) -> None:
    """One folder per feature family below ``base``, readable as one partitioned table."""
    for family, df in families.items():
        df.write.mode("overwrite").parquet(f"{base}/family={family}")


def freeze_ids(ids: DataFrame, path: str) -> DataFrame:
    """Write a cohort's ids once and return the frozen copy."""
    ids.write.mode("overwrite").parquet(path)
    return ids.sparkSession.read.schema(ids.schema).parquet(path)


def write_svmlight(lines: DataFrame, path: str) -> None:
    """Text lines made by ``operators.features.svmlight_lines``."""
    lines.select("line").write.mode("overwrite").text(path)


def append_embeddings(vectors: DataFrame, path: str) -> None:
    """Add ``(entity_id, vec)`` rows for the entities the store does not hold yet.

    The ids already stored are read before the append and compared by anti join, so a
    repeated call adds nothing and no vector is computed twice when ``vectors`` is lazy.
    """
    spark = vectors.sparkSession
    missing = missing_entities(vectors, embeddings_or_empty(spark, path))
    missing.write.mode("append").parquet(path)


def missing_entities(df: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``df`` whose entity has no row in ``store``."""
    return df.join(store.select("entity_id"), "entity_id", "left_anti")


def embeddings_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The embedding store, or an empty frame when it has not been started."""
    try:
        stored = spark.read.schema(EMBEDDING).parquet(path)
        stored.schema
        return stored.select(F.col("entity_id"), F.col("vec"))
    except AnalysisException:
        return spark.createDataFrame([], EMBEDDING)
