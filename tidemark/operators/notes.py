"""Notes: choosing them, counting keywords, cutting sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE, ENTITY
from ..functions import text as tx
from ..session import stage
from ..skew import spread_join
from .period import window_filter


def _latest(rows: DataFrame, text: Column, name: str, ids: DataFrame | None) -> DataFrame:
    """Latest row per entity, the greatest ``text`` on a tie.

    The latest day is a maximum of short values per entity. Only the notes of that day are then looked at:
    ``text`` is computed for them, and ties, a few notes of one entity and day, are broken among them.
    """
    last = rows.groupBy(F.col(ENTITY).alias("_entity")).agg(F.max(DATE).alias("_day"))
    if ids is not None:
        last = last.join(ids.select(F.col(ENTITY).alias("_entity")), "_entity", "left_semi")
    same = (F.col(ENTITY) == F.col("_entity")) & F.col(DATE).eqNullSafe(F.col("_day"))
    chosen = rows.join(last, same).select(ENTITY, DATE, text.alias(name))
    return chosen.groupBy(ENTITY, DATE).agg(F.max(name).alias(name))


def last_note(notes: DataFrame, period: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The latest note in each entity's window, cleaned; only notes inside a window are cleaned."""
    rows = window_filter(notes.select(ENTITY, DATE, "text"), period)
    return _latest(rows, tx.clean_text(F.col("text")), "clean_text", ids)


def last_note_for_tokenizer(notes: DataFrame, period: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The latest raw note in each entity's window, made ready for a tokenizer."""
    rows = window_filter(notes.select(ENTITY, DATE, "text"), period)
    chosen = _latest(rows, F.col("text"), "text", ids)
    return chosen.select(ENTITY, DATE, tx.tokenizer_text(F.col("text")).alias("to_tok"))


def by_category(notes: DataFrame, category: str, entities: DataFrame | None = None) -> DataFrame:
    """Notes of one category, of all or of given entities."""
    chosen = notes.filter(F.col("category") == category)
    if entities is None:
        return chosen
    return spread_join(chosen, entities.select(ENTITY), ENTITY, "left_semi", spread_by=[DATE])


def one_per_day(notes: DataFrame, category: str) -> DataFrame:
    """One note of the category per entity and day: the first by row id."""
    chosen = notes.filter(F.col("category") == category).select(ENTITY, DATE, "row_id", "text")
    first = chosen.groupBy(F.col(ENTITY).alias("_entity"), F.col(DATE).alias("_day")).agg(F.min("row_id").alias("_row"))
    same = (
        F.col(ENTITY).eqNullSafe(F.col("_entity"))
        & F.col(DATE).eqNullSafe(F.col("_day"))
        & F.col("row_id").eqNullSafe(F.col("_row"))
    )
    return chosen.join(first, same).select(ENTITY, DATE, "row_id", "text")


def keyword_counts(notes: DataFrame, words: Sequence[str]) -> DataFrame:
    """Notes with and without each keyword; one pass for all keywords."""
    flags = F.array(*[F.struct(F.lit(w).alias("keyword"), tx.has_keyword(F.col("text"), w).alias("present")) for w in words])
    return (
        notes.filter(F.col("text").isNotNull())
        .select(F.inline(flags))
        .groupBy("keyword", "present")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_labels(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """Notes of known entities with the entity's label.

    Labels of entities without notes are dropped and the others written first, so that the planner knows how few they are; if
    they are many, adaptive execution splits an entity with many notes.
    """
    noted = labels.join(notes.select(ENTITY).distinct(), ENTITY, "left_semi")
    return notes.join(stage(noted, "noted_labels"), ENTITY)
