"""Entity-clustered storage: tables bucketed and sorted by entity, so that work per entity needs no shuffle of raw rows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("largest_entity", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _catalog_name() -> str:
    return f"tidemark_{uuid.uuid4().hex}"


def write_clustered(df: DataFrame, path: str, key: str, buckets: int, hot_share: float = 4.0) -> tuple[int, int, int]:
    """Write ``df`` with all rows of an entity in one of ``buckets`` sorted files; the bucket count, largest entity and row count.

    The rows are read and shuffled once, here, and not again by what reads them per entity; they are counted where they
    were written. A bucket is read by one task, so an entity of more rows than ``hot_share`` average buckets would be one
    slow task for ever: such a table is written again without buckets (0 is returned), and adaptive execution splits that
    entity when it is read. Null keys are rows like others, but are not counted as an entity: no join meets them.
    """
    spark = df.sparkSession
    name = _catalog_name()
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    sizes = spark.table(name).filter(F.col(key).isNotNull()).groupBy(key).count()
    largest, rows = sizes.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    # only the entry goes: the files of a table with a path of its own stay
    spark.sql(f"DROP TABLE {name}")
    if largest > hot_share * max(rows / buckets, 1) and largest > 10_000:
        df.write.mode("overwrite").parquet(path)
        return 0, largest, rows
    return buckets, largest, rows


def open_clustered(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table that :func:`write_clustered` wrote, with its buckets known to the planner (plain if it has none).

    A join or grouping on the entity and more columns may then use the buckets too, which the session is told here.
    """
    if not buckets:
        return spark.read.schema(schema).parquet(path)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = _catalog_name()
    spark.sql(
        f"CREATE TABLE {name} ({_columns(schema)}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    return spark.table(name)


def write_clustered_tables(tables: Mapping[str, DataFrame], base: str, key: str, buckets: int, names: Sequence[str] | None = None) -> DataFrame:
    """Write the tables below ``base``, those in ``names`` (all) clustered, and a ``layout`` table that says how; the layout."""
    spark, rows = None, []
    for table, df in tables.items():
        spark = df.sparkSession
        if names is None or table in names:
            rows.append((table, key, *write_clustered(df, f"{base}/{table}", key, buckets)))
        else:
            df.write.mode("overwrite").parquet(f"{base}/{table}")
            rows.append((table, key, 0, None, None))
    layout = spark.createDataFrame(rows, LAYOUT).coalesce(1)
    layout.write.mode("overwrite").parquet(f"{base}/layout")
    return spark.read.schema(LAYOUT).parquet(f"{base}/layout")


def read_layout(spark: SparkSession, base: str) -> dict[str, tuple[str, int]]:
    """Key and bucket count of every table, one row each; empty when ``base`` was written without a layout."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/layout")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return {r.table: (r.key, r.buckets) for r in spark.read.schema(LAYOUT).parquet(f"{base}/layout").collect()}
