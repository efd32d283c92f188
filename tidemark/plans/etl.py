"""The main feature job: raw extracts in, written feature tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..config import ENTITY
from ..operators import cohort, features, notes
from ..session import stage
from ..sources import writers
from .records import Study

OUTPUTS = (
    "deceased_to_date",
    "train_ids",
    "test_ids",
    "diag_built",
    "labs_built",
    "meds_built",
    "last_note",
    "last_note_tokenized",
)


def build(study: Study) -> dict[str, DataFrame]:
    """Every output as a frame.

    The windows are written once and shared: each family is then one scan, one join and one
    grouping, and the small window table is broadcast when its real size allows.
    """
    p = study.params
    ids = study.records.patients.select(study.records.patients["SUBJECT_ID"].cast("bigint").alias(ENTITY))
    train_ids, test_ids = cohort.train_test_split(ids, p.train_fraction, p.seed)
    study.period = stage(study.period, "period")
    return {
        "deceased_to_date": study.outcomes,
        "train_ids": train_ids,
        "test_ids": test_ids,
        "diag_built": features.build_presence(study.inside(study.diagnoses), study.train, p.diag_min),
        "labs_built": features.build_features(study.inside(study.labs), ["mean", "max", "min"], study.train, p.lab_min),
        "meds_built": features.build_features(study.inside(study.meds), ["mean", "count"], study.train, p.med_min),
        "last_note": notes.last_note(study.notes, study.period, ids),
        "last_note_tokenized": notes.last_note_for_tokenizer(study.notes, study.period, ids),
    }


def run(study: Study, base: str, write: Callable[[DataFrame, str], None] = writers.write_parquet) -> dict[str, str]:
    """Build and write everything below ``base``; returns the path of each output."""
    paths = {}
    for name, df in build(study).items():
        paths[name] = f"{base}/{name}"
        write(df, paths[name])
    return paths
