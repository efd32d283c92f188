"""Summaries used to look at a cohort before modelling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY, FEATURE
from ..ordering import dense_ids
from ..session import stage
from .cohort import labels


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), *columns)


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids against rows."""
    return df.agg(F.count_distinct(column).alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


def category_presence(notes: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Per entity and listed category: 1 if any note of it has an admission id, else 0."""
    counted = notes.groupBy(ENTITY).pivot("category", list(categories)).agg(F.count("admission_id"))
    return counted.select(ENTITY, *[(F.coalesce(F.col(f"`{c}`"), F.lit(0)) > 0).cast("int").alias(c) for c in categories])


def category_prevalence(presence: DataFrame) -> DataFrame:
    """Share of entities having each category, largest first."""
    flags = [c for c in presence.columns if c != ENTITY]
    wide = presence.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in flags])
    return wide.unpivot([], [F.col(f"`{c}`") for c in flags], "category", "share").orderBy(F.desc("share"), "category")


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's r, null where a side does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def presence_correlation(presence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Correlation of every pair of flags and of the outcome, as ``(a, b, r)``; one pass for all pairs."""
    flags = [c for c in presence.columns if c != ENTITY] + ["DECEASED"]
    labelled = labels(presence.select(ENTITY), outcomes).withColumnRenamed("label", "DECEASED")
    table = presence.join(labelled, ENTITY)
    pairs = list(combinations_with_replacement(flags, 2))
    as_number = {c: F.col(f"`{c}`").cast("double") for c in flags}
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _correlation(as_number[a], as_number[b]).alias("r"))
        for a, b in pairs
    ]
    return table.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def co_occurrences(presence: DataFrame, codes: DataFrame, block: int = 256, held: int = 32) -> DataFrame:
    """``i, j, n`` for ``i <= j``: how many entities have both features, for pairs that some entity has.

    A blocked Gram matrix of the sparse rows ``entity_id, feature``: features are numbered (``codes``: ``feature, idx``) and
    cut into blocks, an entity's features of a block are one short list, and a task adds up dense blocks of the matrix, at most
    ``held`` at a time, of which the nonzero cells are shuffled. No pair of one entity's features is ever a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, left, right in zip(*(batch[c].to_pylist() for c in ("a", "b", "left", "right"))):
                if (a, b) not in blocks and len(blocks) >= held:
                    yield cells(blocks)
                    blocks = {}
                counts = blocks.setdefault((a, b), np.zeros((block, block), np.int64))
                counts[np.ix_(np.asarray(left) - a * block, np.asarray(right) - b * block)] += 1
        yield cells(blocks)

    def cells(blocks: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        found = defaultdict(list)
        for (a, b), counts in blocks.items():
            i, j = np.nonzero(np.triu(counts) if a == b else counts)
            found["i"].append(i + a * block)
            found["j"].append(j + b * block)
            found["n"].append(counts[i, j])
        return pa.record_batch([pa.array(np.concatenate(found[c]) if found else [], pa.int64()) for c in "ijn"], list("ijn"))

    numbered = presence.select(ENTITY, FEATURE).distinct().join(codes, FEATURE).select(ENTITY, F.col("idx").cast("bigint").alias("idx"))
    lists = numbered.groupBy(ENTITY, F.expr(f"idx div {block}").alias("a")).agg(F.collect_list("idx").alias("own"))
    # an entity has one list per block; those of different blocks meet in pairs
    packed = lists.groupBy(ENTITY).agg(F.sort_array(F.collect_list(F.struct("a", "own"))).alias("lists"))
    first = packed.select("lists", F.posexplode("lists").alias("at", "one"))
    pairs = first.select("one", F.explode(F.expr("slice(lists, at + 1, size(lists) - at)")).alias("other"))
    flat = pairs.select(
        F.col("one.a").alias("a"), F.col("other.a").alias("b"), F.col("one.own").alias("left"), F.col("other.own").alias("right")
    )
    return flat.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def flag_correlation(presence: DataFrame, entities: DataFrame) -> DataFrame:
    """``a, b, n, r``: Pearson's r of every two features that some entity has both of, over all of ``entities``.

    ``presence`` holds ``entity_id, feature`` rows, repeats counting once; an entity without any has zeros throughout. Means and
    variances follow from the diagonal counts, so the matrix is never filled. r is null where a feature does not vary.
    """
    known = presence.join(entities.select(ENTITY).distinct(), ENTITY, "left_semi")
    codes = stage(dense_ids(known, FEATURE, "idx"), "feature_ids")
    gram = stage(co_occurrences(known, codes), "gram")
    n_all = entities.select(ENTITY).distinct().agg(F.count(F.lit(1))).scalar().cast("double")
    own = gram.filter("i = j")
    sides = [
        own.join(codes, F.col("i") == F.col("idx")).select(F.col("i").alias(at), F.col(FEATURE).alias(name), F.col("n").alias(f"n_{name}"))
        for at, name in (("i", "a"), ("j", "b"))
    ]
    spread = F.sqrt(F.col("n_a") * (n_all - F.col("n_a"))) * F.sqrt(F.col("n_b") * (n_all - F.col("n_b")))
    r = (n_all * F.col("n") - F.col("n_a").cast("double") * F.col("n_b")) / F.nullif(spread, F.lit(0.0))
    return gram.join(sides[0], "i").join(sides[1], "j").select("a", "b", "n", r.alias("r"))
