"""Long event rows to per-entity features: pruning, aggregation, scaling, pivots, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import ENTITY, FEATURE, VALUE
from ..ordering import dense_ids
from ..session import fresh_path, stage
from ..skew import spread_join
from .period import window_filter

_AGGREGATES = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
}


def _pairs(events: DataFrame, functions: Sequence[str]) -> DataFrame:
    """One row per entity and feature; events are pre-aggregated before this, the only shuffle of raw rows."""
    return (
        events.filter(F.col(FEATURE).isNotNull())
        .groupBy(ENTITY, FEATURE)
        .agg(*[_AGGREGATES[f](VALUE).alias(f) for f in functions], F.count(VALUE).alias("_known"))
    )


def _with_train_flag(pairs: DataFrame, train: DataFrame | Column | None) -> DataFrame:
    """Add ``_train``: a predicate on the entity id is evaluated in place, a table is joined."""
    if train is None:
        return pairs.withColumn("_train", F.lit(True))
    if isinstance(train, Column):
        return pairs.withColumn("_train", train)
    flagged = train.select(ENTITY).withColumn("_hit", F.lit(True))
    joined = spread_join(pairs, flagged, ENTITY, "left", spread_by=[FEATURE])
    return joined.withColumn("_train", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _support(pairs: DataFrame, train: DataFrame | Column | None, functions: Sequence[str] = ()) -> DataFrame:
    """Per feature: entities having it, training entities having it, known training rows.

    For each of ``functions`` also its maximum over the pairs, and whether a training entity has a value.
    """
    highest = [F.max(F.col(f).cast("double")).alias(f"_max_{f}") for f in functions]
    taught = [F.bool_or(F.col("_train") & F.col(f).isNotNull()).alias(f"_taught_{f}") for f in functions]
    return (
        _with_train_flag(pairs, train)
        .groupBy(FEATURE)
        .agg(
            F.count(F.lit(1)).alias("n_entities"),
            F.count_if("_train").alias("n_train_entities"),
            F.sum(F.when(F.col("_train"), F.col("_known")).otherwise(0)).alias("n_train_rows"),
            *highest,
            *taught,
        )
    )


def _keep(support: DataFrame, low_thresh: int | None, count_by: str) -> DataFrame:
    kept = support.filter(F.col("n_train_entities") > 0)
    if low_thresh is not None:
        column = {"entities": "n_entities", "train_rows": "n_train_rows"}[count_by]
        kept = kept.filter(F.col(column) > low_thresh)
    return kept.drop("n_entities", "n_train_entities", "n_train_rows")


def popular_features(events: DataFrame, low_thresh: int, train: DataFrame | Column | None = None) -> DataFrame:
    """Features seen in training and held by more than ``low_thresh`` entities."""
    return (
        _support(_pairs(events, []), train)
        .filter((F.col("n_train_entities") > 0) & (F.col("n_entities") > low_thresh))
        .select(FEATURE, "n_entities")
    )


def popular_features_by_train_rows(events: DataFrame, low_thresh: int, train: DataFrame | Column) -> DataFrame:
    """Features with more than ``low_thresh`` known values among training entities."""
    return (
        _support(_pairs(events, []), train).filter(F.col("n_train_rows") > low_thresh).select(FEATURE, "n_train_rows")
    )


def train_features_only(events: DataFrame, train: DataFrame | Column) -> DataFrame:
    """Event rows whose feature occurs among training entities; the rows are written once and read twice."""
    events = stage(events, "events")
    seen = _support(_pairs(events, []), train).filter(F.col("n_train_entities") > 0).select(FEATURE)
    # written, so the planner knows how short the list is; adaptive execution splits a hot feature if it is not
    return events.join(stage(seen, "seen_features"), FEATURE, "left_semi")


def build_features(
    events: DataFrame,
    functions: Sequence[str],
    train: DataFrame | Column | None = None,
    low_thresh: int | None = None,
    count_by: str = "entities",
) -> DataFrame:
    """Aggregate each feature per entity, keeping features seen in training and common enough.

    ``functions`` name the aggregates (mean, max, min, sum, count), one column each. The raw rows are read
    and grouped once, into entity-feature pairs that are written; popularity and pruning then work on those. The list
    of kept features is written too, so the planner knows its size before it chooses the join.
    """
    pairs = _pairs(events, functions)
    if train is None and low_thresh is None:
        return pairs.drop("_known")
    pairs = stage(pairs, "pairs")
    kept = stage(_keep(_support(pairs, train), low_thresh, count_by), "kept_features")
    return pairs.join(kept, FEATURE, "left_semi").select(ENTITY, FEATURE, *functions)


def build_presence(
    events: DataFrame, train: DataFrame | Column | None = None, low_thresh: int | None = None
) -> DataFrame:
    """Entity-feature pairs whose values sum to more than zero."""
    summed = build_features(events, ["sum"], train, low_thresh)
    return summed.filter(F.col("sum") > 0).select(ENTITY, FEATURE, F.lit(1.0).alias(VALUE))


def to_long(built: DataFrame, functions: Sequence[str], suffix: str = "index") -> DataFrame:
    """One row per aggregate: feature name plus ``_0``, ``_1``, ... or plus the aggregate's name.

    One pass over ``built``; nothing is scanned again per function.
    """
    return _stacked(built, functions, [F.col(f).cast("double") for f in functions], [ENTITY], VALUE, suffix)


def _stacked(
    built: DataFrame, functions: Sequence[str], values: Sequence[Column], others: list[str], name: str, suffix: str = "index"
) -> DataFrame:
    """One row per function with its value in column ``name``, beside the columns ``others``."""
    wide = built.select(*others, FEATURE, *[v.alias(f) for f, v in zip(functions, values)])
    stacked = wide.unpivot([*others, FEATURE], list(functions), "_function", name)
    if suffix == "index":
        tag = F.array_position(F.array(*[F.lit(f) for f in functions]), F.col("_function")) - 1
    else:
        tag = F.col("_function")
    return stacked.select(*others, F.concat(FEATURE, F.lit("_"), tag.cast("string")).alias(FEATURE), name)


def process_family(
    events: DataFrame, period: DataFrame, functions: Sequence[str], low_thresh: int, train: DataFrame | Column
) -> DataFrame:
    """Closed window, rarity by training rows, then all aggregates as long rows."""
    inside = window_filter(events, period, bounds="closed")
    return to_long(build_features(inside, functions, train, low_thresh, count_by="train_rows"), functions)


def scaled_family(
    events: DataFrame, period: DataFrame, functions: Sequence[str], low_thresh: int, train: DataFrame | Column
) -> tuple[DataFrame, DataFrame]:
    """``max_scale`` of ``process_family``, and the names ``feature`` for which a training entity has a row in it.

    An aggregate of a feature is one long feature, so maxima and names are found where popularity is counted, over
    the written pairs; the long rows are made once and not shuffled by feature.
    """
    pairs = stage(_pairs(window_filter(events, period, bounds="closed"), functions), "pairs")
    kept = stage(_keep(_support(pairs, train, functions), low_thresh, "train_rows"), "kept_features")
    # no result where the maximum is 0 or unknown
    ratios = [F.col(f).cast("double") / F.nullif(F.col(f"_max_{f}"), F.lit(0.0)) for f in functions]
    scaled = _stacked(pairs.join(kept, FEATURE), functions, ratios, [ENTITY], VALUE).filter(F.col(VALUE).isNotNull())
    taught = [F.col(f"_taught_{f}") & (F.col(f"_max_{f}") != 0) for f in functions]
    return scaled, _stacked(kept, functions, taught, [], "_taught").filter("_taught").select(FEATURE)


def max_scale(long: DataFrame) -> DataFrame:
    """Divide each value by its feature's maximum; rows without a defined result go."""
    highest = long.groupBy(FEATURE).agg(F.max(VALUE).alias("_max")).filter(F.col("_max") != 0)
    scaled = long.join(stage(highest, "maxima"), FEATURE)
    return scaled.select(ENTITY, FEATURE, (F.col(VALUE) / F.col("_max")).alias(VALUE)).filter(F.col(VALUE).isNotNull())


def pruning_report(events: DataFrame, low_thresh: int, train: DataFrame | Column) -> DataFrame:
    """How many features exist, occur in training, and are common enough."""
    support = _support(_pairs(events, []), train)
    seen = F.col("n_train_entities") > 0
    return support.agg(
        F.count(F.lit(1)).alias("features_total"),
        F.count_if(seen).alias("features_in_train"),
        F.count_if(seen & (F.col("n_entities") > low_thresh)).alias("features_kept"),
    )


def _listed(long: DataFrame, features: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The rows, and the columns to make of their features.

    Without a list it is read from the rows: one job, names only, as many as the result has columns. With one,
    a feature outside it stops the job; it would be lost otherwise.
    """
    if features is None:
        names = long.select(FEATURE).filter(F.col(FEATURE).isNotNull()).distinct()
        return long, sorted(r[FEATURE] for r in names.collect())
    unknown = F.raise_error(F.concat(F.lit("feature is not in the list: "), F.col(FEATURE)))
    checked = F.when(F.col(FEATURE).isNull() | F.col(FEATURE).isin(list(features)), F.col(FEATURE)).otherwise(unknown)
    return long.withColumn(FEATURE, checked), list(features)


def pivot_features(
    built: DataFrame, features: Sequence[str] | None, functions: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """One column ``<feature>_<aggregate>`` per feature and aggregate; see ``_listed`` for the list."""
    built, names = _listed(built, features)
    cells = [F.first(F.col(f).cast("double"), ignorenulls=True).alias(f) for f in functions]
    wide = built.groupBy(ENTITY).pivot(FEATURE, names).agg(*cells)
    if len(functions) == 1:
        wide = wide.select(ENTITY, *[F.col(f"`{f}`").alias(f"{f}_{functions[0]}") for f in names])
    return wide if fill is None else wide.na.fill(fill)


def feature_matrix(families: Sequence[DataFrame], features: Sequence[str] | None, fill: float = 0.0) -> DataFrame:
    """Several long families as one wide matrix over every entity of any family.

    Joining blocks on the entity and filling with 0 gives the same as pivoting their union once.
    """
    union = families[0].select(ENTITY, FEATURE, VALUE)
    for family in families[1:]:
        union = union.unionByName(family.select(ENTITY, FEATURE, VALUE))
    union, names = _listed(union, features)
    wide = union.groupBy(ENTITY).pivot(FEATURE, names).agg(F.first(VALUE, ignorenulls=True))
    return wide.na.fill(fill)


def join_left_features(baseline: DataFrame, extra: DataFrame, fill: float = 0.0) -> DataFrame:
    """Extra wide columns for the baseline's entities only, missing ones filled."""
    added = [c for c in extra.columns if c != ENTITY]
    return baseline.join(extra, ENTITY, "left").na.fill(fill, subset=added)


def restrict_to_entities(extra: DataFrame, baseline: DataFrame) -> DataFrame:
    """Long extra features of the entities that have at least one baseline feature."""
    known = baseline.select(ENTITY).distinct()
    return extra.join(known, ENTITY, "left_semi")


def codemap(long: DataFrame) -> DataFrame:
    """``(feature, idx)``: dense ids from 0 in name order."""
    return dense_ids(long.filter(F.col(FEATURE).isNotNull()), FEATURE, "idx")


def indexed(long: DataFrame, codes: DataFrame) -> DataFrame:
    """Long rows with the feature's id; features outside the map are dropped."""
    return long.join(codes, FEATURE).select(ENTITY, F.col("idx").cast("int"), VALUE)


def index_value_lists(cells: DataFrame) -> DataFrame:
    """Per entity its ids and values in id order; a list is at most as long as the matrix is wide."""
    packed = cells.groupBy(ENTITY).agg(F.sort_array(F.collect_list(F.struct("idx", VALUE))).alias("cells"))
    return packed.select(ENTITY, F.col("cells.idx").alias("indices"), F.col(f"cells.{VALUE}").alias("values"))


def svmlight_lines(
    long: DataFrame, codes: DataFrame, labels: DataFrame, entity_prefix: bool = False, index_base: int = 0
) -> DataFrame:
    """``(entity_id, line)`` with ``label idx:value ...``, values to six decimals.

    Cells are spelled before they are gathered, as a column; a decimal has the digits of the rounded value and is spelled faster.
    """
    rounded = F.round(VALUE, 6)
    digits = F.when(F.abs(rounded) < 1e15, rounded.cast("decimal(22, 6)").cast("string")).otherwise(F.format_string("%.6f", rounded))
    cell = F.concat((F.col("idx") + index_base).cast("string"), F.lit(":"), digits)
    rows = index_value_lists(indexed(long, codes).withColumn(VALUE, cell)).join(labels, ENTITY)
    lead = F.concat_ws(" ", F.col(ENTITY), F.col("label")) if entity_prefix else F.col("label").cast("string")
    return rows.select(ENTITY, F.concat_ws(" ", lead, "values", F.lit("")).alias("line"))


_STORED_VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def sparse_vectors(long: DataFrame, codes: DataFrame, width: int) -> DataFrame:
    """``(entity_id, features)`` as sparse vectors of ``width``; the step in front of a model.

    Lists are written in the form in which Parquet holds vectors, and read back as such.
    """
    lists = index_value_lists(indexed(long, codes))
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"), "indices", "values"
    )
    path = fresh_path(long.sparkSession, "vectors")
    lists.select(ENTITY, stored.alias("features")).write.parquet(path)
    schema = StructType([lists.schema[ENTITY], StructField("features", VectorUDT())])
    return long.sparkSession.read.schema(schema).parquet(path)


def vector_cells(rows: DataFrame) -> DataFrame:
    """The stored cells of sparse ``features`` as rows ``idx, value``, beside the other columns; zeros are not made."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    others = [f for f in rows.schema.fields if f.name != "features"]
    stored = StructType([*others, StructField("features", StructType.fromDDL(f"v {_STORED_VECTOR}")["v"].dataType)])
    cells = F.inline(F.arrays_zip("features.indices", "features.values")).alias("idx", VALUE)
    return spark.read.schema(stored).parquet(path).select(*[f.name for f in others], cells)


def wide_columns(vectors: DataFrame, width: int, prefix: str, column: str = "vec") -> DataFrame:
    """Array elements as columns ``<prefix>0`` ...."""
    return vectors.select(ENTITY, *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(width)])
