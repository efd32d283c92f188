"""Running totals and ranks over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import stage

_SLICE = "_slice"


def running_totals(df: DataFrame, order: list[str], sums: list[str], group: list[str] | None = None) -> DataFrame:
    """Add ``<col>_before``: the sum of ``col`` over all rows of the group that sort earlier.

    ``order`` + ``group`` must identify a row, so equal keys cannot overload a slice. The rows are
    range-partitioned and written once; the slice number is then data, not a property of a
    running stage. Sums inside a slice and sums of whole slices are two small windows.
    """
    group = group or []
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        df.repartitionByRange(slices, *order, *group).withColumn(_SLICE, F.spark_partition_id()),
        "ranged",
    )
    inside = Window.partitionBy(_SLICE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_local") for c in sums]
    )
    # one row per slice and group: at most `slices` rows in each window below
    whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(_SLICE, *group)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            *[F.col(c).alias(f"_at_{c}") for c in (_SLICE, *group)],
            *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        )
    )
    # null-safe, so that a group named null keeps its rows
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (_SLICE, *group)]
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_{c}_local") + F.col(f"_{c}_offset")).alias(f"{c}_before") for c in sums]
    )


def dense_ids(names: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """Number the distinct values of ``name`` 0, 1, 2, ... in sorted order."""
    counted = names.select(name).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(counted, [name], ["_one"]).select(name, F.col("_one_before").alias(id_col))
