"""The raw extracts and the event tables made from them."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame

from ..config import StudyParams
from ..operators import cohort, normalize, period
from ..sources.readers import for_entities


@dataclass(frozen=True)
class Records:
    """Raw tables under their usual column names; only the ones a plan uses are read.

    Procedures come from the prescriptions unless ``procedure_orders`` is given.
    """

    patients: DataFrame
    admissions: DataFrame
    diagnoses: DataFrame
    labevents: DataFrame
    prescriptions: DataFrame
    notes: DataFrame | None = None
    microbiology: DataFrame | None = None
    procedure_orders: DataFrame | None = None


def restricted(records: Records, ids: DataFrame) -> Records:
    """The same tables with only the rows of the given entities (column ``entity_id``)."""
    wanted = ids.select(ids["entity_id"].alias("SUBJECT_ID"))
    spread = {"labevents": "CHARTTIME", "prescriptions": "STARTDATE", "notes": "CHARTDATE", "microbiology": "CHARTTIME"}
    kept = {}
    for field in fields(records):
        table = getattr(records, field.name)
        if table is not None:
            by = [spread[field.name]] if field.name in spread else None
            table = for_entities(table, wanted, spread_by=by)
        kept[field.name] = table
    return Records(**kept)


class Study:
    """Lazily built tables that several plans share. Nothing runs until a result is asked for."""

    def __init__(self, records: Records, params: StudyParams = StudyParams()):
        self.records, self.params = records, params

    @property
    def train(self) -> Column:
        return cohort.in_train(fraction=self.params.train_fraction, seed=self.params.seed)

    @cached_property
    def outcomes(self) -> DataFrame:
        return normalize.outcome_dates(self.records.patients)

    @cached_property
    def diagnoses(self) -> DataFrame:
        return normalize.diagnoses(self.records.diagnoses, self.records.admissions)

    @cached_property
    def labs(self) -> DataFrame:
        return normalize.labs(self.records.labevents)

    @cached_property
    def meds(self) -> DataFrame:
        return normalize.meds(self.records.prescriptions)

    @cached_property
    def notes(self) -> DataFrame:
        return normalize.notes(self.records.notes)

    @cached_property
    def period(self) -> DataFrame:
        return self.period_as()

    def period_as(self, **options) -> DataFrame:
        # windows need the days of diagnoses only, so their codes do not move for them
        days = normalize.diagnosis_days(self.records.diagnoses, self.records.admissions)
        return period.train_period(
            [days, self.labs, self.meds],
            self.outcomes,
            self.params.observation_days,
            self.params.prediction_days,
            **options,
        )

    def inside(self, events: DataFrame, bounds: str = "half_open") -> DataFrame:
        return period.window_filter(events, self.period, bounds)
