"""Mixing sources to target weights by hash-random order and exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import running_totals
from ..session import stage


def word_count(text: Column) -> Column:
    """Words are runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sources: DataFrame, weights: Sequence[int], share: float, most_epochs: float, size: str = "source_size"
) -> DataFrame:
    """Add ``source_rank`` and ``target`` to one row per source.

    Sources are ordered by code point, null last, and get the weights in turn. Together they get
    ``share`` times all sizes by weight; a source stops at ``most_epochs`` times its own size and what
    it cannot take is shared again by weight. With the sources in order of the level at which they
    stop, the common level is found in one pass: the first source that the level left for it does
    not fill ends the search. The table holds one row per source.
    """
    ranked = sources.select(
        "*", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("source_rank")
    )
    turn = F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1
    weighed = ranked.select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")).alias("_weight"),
        (F.col(size) * F.lit(float(most_epochs))).alias("_cap"),
    ).withColumn("_stop", F.col("_cap") / F.col("_weight"))
    everything = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy("_stop", "source_rank")
    levels = weighed.select(
        "*",
        F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_used"),
        F.sum("_weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
        (F.sum(size).over(everything) * F.lit(float(share))).alias("_budget"),
    ).withColumn("_level", (F.col("_budget") - F.col("_used")) / F.col("_left"))
    is_open = F.when(F.col("_stop") >= F.col("_level"), F.struct("_stop", "source_rank"))
    open_level = F.min_by("_level", is_open)
    return levels.select(
        *ranked.columns,
        F.coalesce(F.least(F.col("_cap"), F.col("_weight") * open_level.over(everything)), F.col("_cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document.

    ``size`` counts words. A document's place in its source is a hash of seed and id, so it is random
    but every run and every retried task agrees. Sizes before it in that order are distributed prefix
    sums: rows are range-sorted by (source, key), so a source that holds a third of all rows spreads
    over a third of the slices, and only one sum per slice and source is combined. The source gives
    whole epochs first; the last one is cut at the exact budget, inside a document if it must be.

    A null text has no words and takes none. A null source is a source of its own, the last one. Rows
    that repeat an id are rows of their own; ties in the key go by id and size. Empty table: empty result.
    """
    sized = stage(
        docs.select(
            F.col(id_column).cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col(text_column)).alias("size"),
        ),
        "sizes",
    )
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_epochs
    )
    keyed = sized.select(
        "*",
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"),
    )
    placed = running_totals(keyed, ["_none", "_source", "_key", "_id", "size"], ["size"], group=[])
    first = sources.select(
        F.col("source").alias("_at"),
        "source_size",
        "target",
        # sources lie one behind the other in the global order, so what precedes a source is one sum
        F.coalesce(
            F.sum("source_size").over(
                Window.partitionBy(F.lit(0)).orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    joined = placed.join(first, F.col("source").eqNullSafe(F.col("_at")))
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    before = F.col("size_before") - F.col("_offset")
    rest = F.least(F.greatest(budget - epochs * F.col("source_size") - before, F.lit(0)), F.col("size"))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The mix as rows: every document as often as the mix takes it, with the columns it came with.

    A document that the budget cuts is given whole, so a source exceeds its target by less than
    one document. Documents the mix takes nothing of, those without words among them, are left out.
    Rows that repeat an id come as often as the one of them that the mix takes most often; a null id is an id.
    """
    taken = mix(docs, id_column=id_column, **options).filter(F.col("taken") > 0)
    copies = taken.groupBy(F.col("doc_id").alias("_mix_id")).agg(
        F.max(F.ceil(F.col("taken") / F.col("size")).cast("int")).alias("_mix_copies")
    )
    joined = docs.join(copies, docs[id_column].eqNullSafe(copies["_mix_id"]))
    turns = F.explode(F.array_repeat(F.lit(0), copies["_mix_copies"])).alias("_mix_turn")
    # every column of the input, then the turn, which goes again
    return joined.select(*[docs[c] for c in docs.columns], turns).select(*[F.col(f"`{c}`") for c in docs.columns])
