"""Per-entity observation windows and the filters that use them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATE, ENTITY
from ..functions.dates import day
from ..skew import spread_join
from .normalize import union_all


def last_event_date(*event_tables: DataFrame) -> DataFrame:
    """Latest event day per entity over all tables."""
    dates = union_all(*[_last_days(t) for t in event_tables])
    return dates.groupBy(ENTITY).agg(F.max(DATE).alias("last_event"))


def _last_days(events: DataFrame) -> DataFrame:
    """The last day per entity of one table.

    Each table is grouped before the union: Spark deals a union of joins on the same key so that one task makes that part of every
    join, and holds the sorts of all of them.
    """
    return events.groupBy(ENTITY).agg(F.max(DATE).alias(DATE))


def train_period(
    event_tables: Sequence[DataFrame],
    outcomes: DataFrame,
    observation_days: int,
    prediction_days: int,
    anchor: str = "index",
    keep_without_events: bool = True,
) -> DataFrame:
    """Window ``(entity_id, earliest, last)``.

    ``last`` lies ``prediction_days`` before the outcome, or on the last event when there is
    none. ``earliest`` is ``observation_days`` before ``last`` (``anchor="index"``) or before
    the last event (``anchor="last_event"``). Each table's last days and the outcomes are united and grouped,
    which replaces the outer join: what is shuffled is pre-aggregated before.
    """
    if anchor not in ("index", "last_event"):
        raise ValueError(f"unknown anchor {anchor}")
    no_date = F.lit(None).cast("date")
    events = [t.select(ENTITY, F.col(DATE).alias("event"), no_date.alias("outcome")) for t in map(_last_days, event_tables)]
    ends = outcomes.select(ENTITY, no_date.alias("event"), F.col("outcome_date").alias("outcome"))
    seen = union_all(*events, ends).groupBy(ENTITY).agg(F.max("event").alias("event"), F.max("outcome").alias("outcome"))
    if not keep_without_events:
        seen = seen.filter(F.col("event").isNotNull())
    last = F.coalesce(F.date_sub("outcome", prediction_days), F.col("event"))
    start = last if anchor == "index" else F.col("event")
    return seen.select(ENTITY, F.date_sub(start, observation_days).alias("earliest"), last.alias("last"))


def index_date(features: DataFrame, patients: DataFrame, prediction_days: int) -> DataFrame:
    """Last feature day, replaced by a day before the outcome where one is recorded.

    Only entities known to ``patients`` stay; features with any null are ignored.
    """
    last = features.na.drop("any").groupBy(ENTITY).agg(F.max(DATE).alias("last_event"))
    known = patients.select(F.col("SUBJECT_ID").cast("bigint").alias(ENTITY), day(patients, "DOD").alias("dod"))
    return last.join(known, ENTITY).select(
        ENTITY, F.coalesce(F.date_sub("dod", prediction_days), F.col("last_event")).alias("index_date")
    )


def period_from_index(index: DataFrame, observation_days: int) -> DataFrame:
    """Window that ends on the index date."""
    return index.select(
        ENTITY, F.date_sub("index_date", observation_days).alias("earliest"), F.col("index_date").alias("last")
    )


def window_filter(
    events: DataFrame, period: DataFrame, bounds: str = "half_open", spread_by: list[str] | None = None
) -> DataFrame:
    """Rows dated inside their entity's window.

    ``half_open`` is ``earliest <= date < last``; ``closed`` includes both ends, ``open`` neither.
    Entities without a window are dropped. Both sides are joined by entity alone, so a grouping by entity and feature above
    needs no further shuffle, and adaptive execution splits an entity whose measured rows are too many,
    whatever their dates. ``spread_by`` salts the join instead, for entities known to be that large.
    """
    at, earliest, last = F.col(DATE), F.col("earliest"), F.col("last")
    inside = {
        "half_open": (at >= earliest) & (at < last),
        "closed": (at >= earliest) & (at <= last),
        "open": (at > earliest) & (at < last),
    }[bounds]
    if spread_by:
        joined = spread_join(events, period, ENTITY, spread_by=spread_by, where=inside)
    else:
        joined = events.join(period, ENTITY).filter(inside)
    return joined.select(*events.columns)


def period_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entities whose windows differ between two results, with both versions."""
    both = left.select(ENTITY, F.col("earliest").alias("earliest_a"), F.col("last").alias("last_a")).join(
        right.select(ENTITY, F.col("earliest").alias("earliest_b"), F.col("last").alias("last_b")), ENTITY, "full_outer"
    )
    same = F.col("earliest_a").eqNullSafe(F.col("earliest_b")) & F.col("last_a").eqNullSafe(F.col("last_b"))
    return both.filter(~same)
