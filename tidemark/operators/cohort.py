"""Choosing entities: samples, splits, code groups, labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY, FEATURE, RESPIRATORY_GROUPS
from ..skew import spread_join


#: listed codes of one length that are sent to every task
LISTED = 100_000


def in_train(entity: str | Column = ENTITY, fraction: float = 0.8, seed: int = 1) -> Column:
    """Whether an entity is in the training part.

    The split is a function of the id and the seed alone, so it needs no join and does not
    move when the partitioning does.
    """
    bound = format(int(fraction * 2**32), "08x")
    column = F.col(entity) if isinstance(entity, str) else entity
    digest = F.md5(F.concat(column.cast("string"), F.lit(f":{seed}")))
    return F.substring(digest, 1, 8) < F.lit(bound)


def train_test_split(ids: DataFrame, fraction: float = 0.8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and test ids."""
    chosen = in_train(ENTITY, fraction, seed)
    return ids.filter(chosen), ids.filter(~chosen)


def entity_sample(ids: DataFrame, n: int, seed: int = 1, small: int = 10_000, digits: int = 3) -> DataFrame:
    """Exactly ``n`` entities, or all when there are fewer; repeatable for a seed.

    Those whose hash comes first. No sort: a histogram of the hashes' first digits (4,096 counts for three digits) finds the
    prefix in which the ``n``-th lies; all of the prefixes before it are in, and a prefix of more than ``small`` rows is counted again
    by its next digits. Only the last, small one is ranked. Equal ids have equal hashes and count as often as they occur.
    """
    digest = F.md5(F.concat(F.col(ENTITY).cast("string"), F.lit(f":{seed}")))
    hashed = ids.select(ENTITY, F.coalesce(digest, F.lit("")).alias("_order"))
    prefix, rest, inside = "", n, None
    while True:
        length = len(prefix) + digits
        open_ = hashed.filter(F.col("_order").startswith(prefix)) if prefix else hashed
        counts = sorted(open_.groupBy(F.substring("_order", 1, length).alias("p")).count().collect())
        before = 0
        for found, count in counts:
            if before + count > rest:
                break
            before += count
        else:
            # no more than asked for, which only a first count can find
            return ids.select(ENTITY)
        cut = F.col("_order") < F.lit(found)
        inside = hashed.filter(cut)
        rest -= before
        if count <= small or length >= 32:
            break
        prefix = found
    edge = hashed.filter(F.substring("_order", 1, length) == F.lit(found))
    return inside.unionByName(edge.orderBy("_order", ENTITY).limit(rest)).select(ENTITY)


def members(df: DataFrame, ids: DataFrame, spread_by: list[str] | None = None) -> DataFrame:
    """Rows whose entity is in ``ids``."""
    return spread_join(df, ids.select(ENTITY), ENTITY, "left_semi", spread_by=spread_by)


def non_members(df: DataFrame, ids: DataFrame, spread_by: list[str] | None = None) -> DataFrame:
    """Rows whose entity is not in ``ids``."""
    return spread_join(df, ids.select(ENTITY), ENTITY, "left_anti", spread_by=spread_by)


def code_group_events(events: DataFrame, groups: Mapping[str, Iterable[int | str]] = RESPIRATORY_GROUPS) -> DataFrame:
    """Events whose code starts with a listed code, with the group's name; the longest listed code decides.

    The code is the part of the feature after its last underscore. Listed codes may be of any length: there is one equi
    join per length that occurs, from the longest down, so no row is copied. The list is a parameter; up to
    :data:`LISTED` codes of a length are broadcast. A code listed in two groups gives a row for each.
    """
    spark = events.sparkSession
    by_length: dict[int, set[tuple[str, str]]] = {}
    for group, codes in groups.items():
        for code in codes:
            by_length.setdefault(len(str(code)), set()).add((str(code), group))
    if 0 in by_length:
        raise ValueError("an empty code would match every event")
    found = events.withColumn("_code", F.substring_index(FEATURE, "_", -1)).withColumn("code_group", F.lit(None).cast("string"))
    for length in sorted(by_length, reverse=True):
        table = spark.createDataFrame(sorted(by_length[length]), "_prefix string, _group string")
        table = F.broadcast(table) if len(by_length[length]) <= LISTED else table
        # a row that has its group is not looked up again
        prefix = F.when(F.col("code_group").isNull(), F.substring("_code", 1, length))
        found = found.join(table, prefix == F.col("_prefix"), "left")
        found = found.withColumn("code_group", F.coalesce("code_group", "_group")).drop("_prefix", "_group")
    return found.filter(F.col("code_group").isNotNull()).drop("_code")


def code_group_entities(events: DataFrame, groups: Mapping[str, Iterable[int | str]] = RESPIRATORY_GROUPS) -> DataFrame:
    """Entities with at least one event of the groups."""
    return code_group_events(events, groups).select(ENTITY).distinct()


def labels(entities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``label`` 1 for entities with the outcome, else 0, beside the other columns that come with the entities."""
    marked = outcomes.select(ENTITY).distinct().withColumn("_hit", F.lit(1))
    others = [c for c in entities.columns if c not in (ENTITY, "label")]
    return entities.join(marked, ENTITY, "left").select(ENTITY, F.coalesce("_hit", F.lit(0)).alias("label"), *others)


def labels_from_column(patients: DataFrame, column: str = "DOD_SSN") -> DataFrame:
    """``label`` 1 where a date column is filled."""
    return patients.select(
        F.col("SUBJECT_ID").cast("bigint").alias(ENTITY), F.col(column).isNotNull().cast("int").alias("label")
    )
