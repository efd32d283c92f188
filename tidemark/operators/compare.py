"""Whether two results are the same rows, and where they are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the two hold a different number of times, with ``n_left`` and ``n_right``.

    Repeated rows count and nulls equal nulls, as in EXCEPT ALL both ways. Both sides are united and grouped once, so a
    task sends one row per distinct row. Columns are those of ``left``, matched by name.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError("the frames have different columns")
    sides = [df.select(*[F.col(f"`{c}`") for c in columns], F.lit(x).cast("bigint").alias("_l"), F.lit(1 - x).cast("bigint").alias("_r"))
             for df, x in ((left, 1), (right, 0))]
    grouped = sides[0].unionByName(sides[1]).groupBy(*[F.col(f"`{c}`") for c in columns])
    counted = grouped.agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return counted.filter(F.col("n_left") != F.col("n_right"))


def _as_text(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # minus zero equals zero
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(F.struct(value.alias("v")))
    return value.cast("string")


def frame_parity(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """``column, only_left, only_right``: how many rows of each side have no partner on the other, by column.

    A column's line compares the key and that column alone, so a column that differs stands out among those that agree;
    ``*`` compares whole rows, and the line of a key column the key alone. Rows are matched as multisets: a repeated row needs as
    many partners, and null equals null. Whole rows are grouped first, and only those that the sides hold a different number of
    times go on: their columns' values go through one more grouping. Frames without rows give zeros.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError("the frames have different columns")
    others = [f for f in left.schema.fields if f.name not in key]
    keys = [_as_text(f) for f in left.schema.fields if f.name in key]
    cells = [F.struct(F.lit(k).alias("column"), F.lit(None).cast("string").alias("value")) for k in key[:1]]
    cells += [F.struct(F.lit(f.name).alias("column"), _as_text(f).alias("value")) for f in others]
    cells.append(F.struct(F.lit("*").alias("column"), F.lit(None).cast("string").alias("value")))
    parts = []
    for df, sign in ((left, 1), (right, -1)):
        # the same columns under the same types, so that both spell a value alike
        same = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in left.schema.fields])
        parts.append(same.withColumn("_n", F.lit(sign).cast("bigint")))
    # maps cannot be grouped by; their text can
    nested = (T.ArrayType, T.StructType, T.MapType)
    row = [_as_text(f) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in left.schema.fields]
    sums = parts[0].unionByName(parts[1]).groupBy(*[c.alias(f"_{i}") for i, c in enumerate(row)]).agg(F.sum("_n").alias("n"))
    # a row that both sides hold as often adds nothing to any column
    differing = sums.filter(F.col("n") != 0).select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(left.schema.fields)], "n")
    sides = [F.greatest("n", F.lit(0)).alias("l"), F.greatest(-F.col("n"), F.lit(0)).alias("r")]
    spelled = differing.select(F.array(*keys).alias("_key"), F.inline(F.array(*cells)), *sides)
    # whole rows are settled: their line is a sum
    whole = F.col("column") == "*"
    under = F.when(~whole, F.col("_key")).alias("key")
    surplus = spelled.groupBy(under, "column", "value").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both = F.when(whole, 0).otherwise(F.least("l", "r"))
    found = surplus.groupBy("column").agg(F.sum(F.col("l") - both).alias("only_left"), F.sum(F.col("r") - both).alias("only_right"))
    spark = left.sparkSession
    listed = spark.createDataFrame([(c,) for c in [*key[:1], *[f.name for f in others], "*"]], "column string")
    return listed.join(found, "column", "left").select("column", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("only_left", "only_right")])
