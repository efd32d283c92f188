"""Exact ROC-AUC, overall and per cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import running_totals


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    Rows are first reduced to one per distinct score; positives are then compared with the
    running count of negatives below them. Null where a group has one class only.
    """
    group = list(group)
    known = scores.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = known.groupBy(*group, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg")
    )
    ranked = running_totals(steps, [score], ["neg"], group)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0).cast("bigint"))
    return ranked.groupBy(*group).agg(
        (won / pairs).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )


def model_scores(scores: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide score columns as ``(..., model, score)`` rows."""
    return scores.unpivot(list(keep), list(models), "model", "score")


def cohort_auc(scores: DataFrame, models: Sequence[str], cohort: str, label: str = "label") -> DataFrame:
    """AUC of every model in every cohort."""
    return roc_auc(model_scores(scores, models, [label, cohort]), label=label, group=["model", cohort])
