"""Models on the written features and their comparison between cohorts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY, FEATURE, VALUE
from ..operators import cohort, evaluate, features, model, tfidf, vectors
from ..session import stage
from .records import Study


def baseline_long(diag: DataFrame, labs: DataFrame, meds: DataFrame) -> DataFrame:
    """Structured features as long rows named ``<feature>_<aggregate>``."""
    presence = diag.select(ENTITY, F.concat(FEATURE, F.lit("_present")).alias(FEATURE), VALUE)
    return presence.unionByName(features.to_long(labs, ["mean", "max", "min"], suffix="name")).unionByName(
        features.to_long(meds, ["mean", "count"], suffix="name")
    )


def tfidf_long(last_note: DataFrame, terms: int, stop_words=()) -> DataFrame:
    return tfidf.tfidf(last_note, terms, stop_words=stop_words)


def embedding_long(last_note_tokenized: DataFrame, store: str, make_encoder) -> DataFrame:
    """Embedding features; texts already in the store are not encoded again."""
    return vectors.as_long(vectors.update_embedding_store(last_note_tokenized, store, make_encoder))


@dataclass
class Fitted:
    model: object
    scores: DataFrame
    matrix: model.Matrix


def train_kind(
    study: Study, kind: str, baseline: DataFrame, extra: DataFrame | None = None, classifier: Estimator | None = None
) -> Fitted:
    """Assemble one model kind, fit it on the training entities, score the rest."""
    matrix = model.training_matrix(model.training_long(kind, baseline, extra), study.outcomes)
    fitted, scores = model.fit_and_score(matrix.rows, classifier or model.random_forest(), study.train)
    return Fitted(fitted, stage(scores, f"scores_{kind}"), matrix)


def retrain(study: Study, fitted: Fitted, max_features: int | None, classifier: Estimator | None = None) -> Fitted:
    """Fit again on the most important features, or on those at or above the mean importance."""
    refit, scores, _ = model.select_and_retrain(
        fitted.matrix.rows, fitted.model, fitted.matrix.width, classifier or model.random_forest(), study.train, max_features
    )
    return Fitted(refit, stage(scores, "scores_selected"), fitted.matrix)


def study_models(
    study: Study,
    built: dict[str, DataFrame],
    encoders: Mapping[str, Callable[[], vectors.Encoder]],
    store: str,
    forest: Estimator | None = None,
    logistic: Estimator | None = None,
) -> dict[str, Fitted]:
    """Every model of the study by name: structured features alone, with TF-IDF, with each encoder's vectors; the same by
    logistic regression; and the structured forest again on selected features."""
    base = stage(baseline_long(built["diag_built"], built["labs_built"], built["meds_built"]), "baseline")
    extras = {"Baseline": None, "TF_IDF": stage(tfidf_long(built["last_note"], study.params.tfidf_terms), "tfidf")}
    for name, make in encoders.items():
        extras[f"Embeddings_{name}"] = embedding_long(built["last_note_tokenized"], f"{store}/{name}", make)
    fitted = {}
    for name, extra in extras.items():
        kind = name.split("_")[0] if name.startswith("Embeddings") else name
        fitted[name] = train_kind(study, kind, base, extra, forest)
        _, scores = model.fit_and_score(fitted[name].matrix.rows, logistic or model.logistic_regression(), study.train)
        fitted[f"{name}_logistic"] = Fitted(None, stage(scores, f"scores_{name}_logistic"), fitted[name].matrix)
    fitted["Baseline_top"] = retrain(study, fitted["Baseline"], study.params.select_features, forest)
    fitted["Baseline_mean"] = retrain(study, fitted["Baseline"], None, forest)
    return fitted


def respiratory_entities(study: Study) -> DataFrame:
    """Entities with a respiratory diagnosis strictly inside their window."""
    coded = study.diagnoses.filter(F.col(FEATURE).isNotNull())
    return cohort.code_group_entities(study.inside(coded, "open"))


def compare(fitted: dict[str, Fitted], members: DataFrame, name: str = "respiratory") -> DataFrame:
    """AUC of each model inside and outside a cohort."""
    wide = None
    for kind, result in fitted.items():
        scores = result.scores.withColumnRenamed("score", kind)
        wide = scores if wide is None else wide.join(scores.drop("label"), ENTITY)
    flagged = cohort.labels(wide.select(ENTITY), members).withColumnRenamed("label", name)
    return evaluate.cohort_auc(wide.join(flagged, ENTITY), list(fitted), name)
