"""Raw tables to long feature rows ``(entity_id, date, feature, value)``.

Rows without a code have a null ``feature``. They still date an entity's history, so
they are kept unless ``drop_null_keys`` removes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DATE, ENTITY, FEATURE, VALUE
from ..functions.dates import day, hours_between
from ..functions.numbers import NUMBER, mean_dose
from ..functions.text import clean_text


def _event(date: Column, feature: Column, value: Column) -> list[Column]:
    return [
        F.col("SUBJECT_ID").cast("bigint").alias(ENTITY),
        date.alias(DATE),
        feature.alias(FEATURE),
        value.cast("double").alias(VALUE),
    ]


def _named(prefix: str, code: Column) -> Column:
    return F.concat(F.lit(prefix), code.cast("string"))


def drop_null_keys(df: DataFrame, columns: Sequence[str] = (FEATURE,)) -> DataFrame:
    """Rows with every key column present."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def fill_null(df: DataFrame, value: float | str, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def numeric_only(df: DataFrame, column: str) -> DataFrame:
    """Keep rows whose text spells a number, and make it one."""
    # the pattern alone filters, so the cast runs once and on numbers only
    return df.filter(F.trim(F.col(column)).rlike(NUMBER)).withColumn(column, F.trim(F.col(column)).cast("double"))


def outcome_dates(patients: DataFrame) -> DataFrame:
    """Entities with the outcome, and its day."""
    return patients.filter(F.col("EXPIRE_FLAG") == 1).select(
        F.col("SUBJECT_ID").cast("bigint").alias(ENTITY), day(patients, "DOD").alias("outcome_date")
    )


def diagnoses(diagnoses: DataFrame, admissions: DataFrame, prefix: str = "ICD9_") -> DataFrame:
    """One row per coded diagnosis, dated by its admission."""
    dated = diagnoses.select("SUBJECT_ID", "HADM_ID", "ICD9_CODE").join(
        admissions.select("SUBJECT_ID", "HADM_ID", "ADMITTIME"), ["SUBJECT_ID", "HADM_ID"]
    )
    return dated.select(_event(day(dated, "ADMITTIME"), _named(prefix, F.col("ICD9_CODE")), F.lit(1.0)))


def diagnosis_days(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """``(entity_id, date)`` of the coded diagnoses, once per admission: what dates a history, without the codes."""
    coded = diagnoses.select("SUBJECT_ID", "HADM_ID").distinct()
    dated = coded.join(admissions.select("SUBJECT_ID", "HADM_ID", "ADMITTIME"), ["SUBJECT_ID", "HADM_ID"])
    return dated.select(F.col("SUBJECT_ID").cast("bigint").alias(ENTITY), day(dated, "ADMITTIME").alias(DATE))


def join_admission_date(diagnoses: DataFrame, admissions: DataFrame) -> DataFrame:
    """Diagnoses with the admission date, matched on the admission alone."""
    return diagnoses.join(admissions.select("HADM_ID", "ADMITTIME"), "HADM_ID")


def rolled_up_diagnoses(diagnoses: DataFrame, admissions: DataFrame, prefix: str = "DIAG_") -> DataFrame:
    """Main-digit codes, each once per entity and day: four characters for E codes, else three."""
    code = F.col("ICD9_CODE")
    main = F.when(code.startswith("E"), F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))
    dated = join_admission_date(drop_null_keys(diagnoses, ["ICD9_CODE"]).select("SUBJECT_ID", "HADM_ID", "ICD9_CODE"), admissions)
    return dated.select(_event(day(dated, "ADMITTIME"), _named(prefix, main), F.lit(1.0))).distinct()


def labs(labevents: DataFrame, prefix: str = "LAB_") -> DataFrame:
    """One row per lab result with the numeric value, which may be null."""
    return labevents.select(_event(day(labevents, "CHARTTIME"), _named(prefix, F.col("ITEMID")), F.col("VALUENUM")))


def labs_from_text(labevents: DataFrame, prefix: str = "LAB_") -> DataFrame:
    """Lab results whose text value is a number."""
    complete = drop_any_null(labevents.select("SUBJECT_ID", "ITEMID", "CHARTTIME", "VALUE"))
    return numeric_only(complete, "VALUE").select(
        _event(day(complete, "CHARTTIME"), _named(prefix, F.col("ITEMID")), F.col("VALUE"))
    )


def meds(prescriptions: DataFrame, prefix: str = "MED_") -> DataFrame:
    """Ended prescriptions with the mean dose, dated by the end."""
    ended = drop_null_keys(prescriptions, ["ENDDATE"])
    return ended.select(_event(day(ended, "ENDDATE"), _named(prefix, F.col("GSN")), mean_dose(F.col("DOSE_VAL_RX"))))


def procedures(prescriptions: DataFrame, prefix: str = "PROC_") -> DataFrame:
    """Started orders whose dose is a plain number, dated by the start."""
    coded = numeric_only(drop_null_keys(prescriptions, ["GSN"]), "DOSE_VAL_RX")
    return coded.select(_event(day(coded, "STARTDATE"), _named(prefix, F.col("GSN")), F.col("DOSE_VAL_RX")))


def microbiology(events: DataFrame, prefix: str = "MB_") -> DataFrame:
    """The last non-pending sensitivity per entity and antibiotic, one feature per result letter."""
    tested = drop_any_null(events.select("ROW_ID", "SUBJECT_ID", "AB_ITEMID", "INTERPRETATION", "CHARTTIME"))
    tested = tested.filter(F.col("INTERPRETATION") != "P")
    last = tested.groupBy("SUBJECT_ID", "AB_ITEMID").agg(
        F.max_by(F.struct("INTERPRETATION", day(tested, "CHARTTIME").alias("day")), "ROW_ID").alias("last")
    )
    feature = F.concat(_named(prefix, F.col("AB_ITEMID").cast("bigint")), F.lit("_"), F.col("last.INTERPRETATION"))
    return last.select(_event(F.col("last.day"), feature, F.lit(1.0)))


def admissions(admissions: DataFrame, prefix: str = "ADM_") -> DataFrame:
    """Hours of stay, one feature per admission type."""
    return admissions.select(
        _event(
            day(admissions, "ADMITTIME"),
            _named(prefix, F.substring("ADMISSION_TYPE", 1, 4)),
            hours_between("DISCHTIME", "ADMITTIME"),
        )
    )


def notes(notes: DataFrame) -> DataFrame:
    """Notes with their day and cleaned text; unused columns are pruned by the optimiser."""
    return notes.select(
        F.col("SUBJECT_ID").cast("bigint").alias(ENTITY),
        F.col("ROW_ID").alias("row_id"),
        F.col("HADM_ID").alias("admission_id"),
        day(notes, "CHARTDATE").alias(DATE),
        F.col("CATEGORY").alias("category"),
        F.col("TEXT").alias("text"),
        clean_text(F.col("TEXT")).alias("clean_text"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of several long tables."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
