"""Schemas of the raw extracts and of the library's own tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from ``NAME TYPE, ...``; unlike Spark's own form it needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Names, order and types of the extracts' columns.
PATIENTS = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, GENDER STRING, DOB STRING, DOD STRING, DOD_HOSP STRING, "
                   "DOD_SSN STRING, EXPIRE_FLAG INT")
ADMISSIONS = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, ADMITTIME STRING, DISCHTIME STRING, "
                     "DEATHTIME STRING, ADMISSION_TYPE STRING, ADMISSION_LOCATION STRING, DISCHARGE_LOCATION STRING, "
                     "INSURANCE STRING, LANGUAGE STRING, RELIGION STRING, MARITAL_STATUS STRING, ETHNICITY STRING, "
                     "EDREGTIME STRING, EDOUTTIME STRING, DIAGNOSIS STRING, HOSPITAL_EXPIRE_FLAG INT, "
                     "HAS_CHARTEVENTS_DATA INT")
DIAGNOSES = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, SEQ_NUM INT, ICD9_CODE STRING")
LABEVENTS = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, ITEMID BIGINT, CHARTTIME STRING, VALUE STRING, "
                    "VALUENUM DOUBLE, VALUEUOM STRING, FLAG STRING")
PRESCRIPTIONS = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, ICUSTAY_ID BIGINT, STARTDATE STRING, "
                        "ENDDATE STRING, DRUG_TYPE STRING, DRUG STRING, DRUG_NAME_POE STRING, "
                        "DRUG_NAME_GENERIC STRING, FORMULARY_DRUG_CD STRING, GSN STRING, NDC STRING, "
                        "PROD_STRENGTH STRING, DOSE_VAL_RX STRING, DOSE_UNIT_RX STRING, FORM_VAL_DISP STRING, "
                        "FORM_UNIT_DISP STRING, ROUTE STRING")
NOTES = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, CHARTDATE STRING, CHARTTIME STRING, "
                "STORETIME STRING, CATEGORY STRING, DESCRIPTION STRING, CGID BIGINT, ISERROR INT, TEXT STRING")
MICROBIOLOGY = _struct("ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, CHARTDATE STRING, CHARTTIME STRING, "
                       "SPEC_ITEMID BIGINT, SPEC_TYPE_DESC STRING, ORG_ITEMID BIGINT, ORG_NAME STRING, "
                       "ISOLATE_NUM INT, AB_ITEMID BIGINT, AB_NAME STRING, DILUTION_TEXT STRING, "
                       "DILUTION_COMPARISON STRING, DILUTION_VALUE DOUBLE, INTERPRETATION STRING")

EVENT = _struct("entity_id BIGINT, date DATE, feature STRING, value DOUBLE")
PERIOD = _struct("entity_id BIGINT, earliest DATE, last DATE")
EMBEDDING = _struct("entity_id BIGINT, vec ARRAY<DOUBLE>")
