"""Record-shaped views over the generated test tables.

Each view is one SELECT that reads the same in Spark SQL and DuckDB. ``{name}`` stands for a
base table or an earlier view.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

# declared, so that opening a table starts no job
BASE_TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}

VIEWS: dict[str, str] = {
    "patients": """
SELECT c.c_custkey AS SUBJECT_ID, CASE WHEN c.c_mktsegment='BUILDING' THEN 1 ELSE 0 END AS EXPIRE_FLAG,
  CASE WHEN c.c_mktsegment='BUILDING' THEN CAST(m.d AS DATE) + CAST(c.c_custkey % 90 AS INT) END AS DOD,
  CASE WHEN c.c_mktsegment='BUILDING' AND c.c_custkey % 3 > 0
    THEN CAST(m.d AS DATE) + CAST(c.c_custkey % 90 AS INT) END AS DOD_SSN
FROM {customer} c
LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS d FROM {orders} GROUP BY o_custkey) m ON m.o_custkey=c.c_custkey""",
    "admissions": """
SELECT o.o_custkey AS SUBJECT_ID, o.o_orderkey AS HADM_ID, o.o_orderdate AS ADMITTIME,
  CAST(CAST(o.o_orderdate AS DATE) + CAST(1 + o.o_orderkey % 20 AS INT) AS TIMESTAMP) AS DISCHTIME,
  SUBSTRING(o.o_orderpriority, 3, 20) AS ADMISSION_TYPE
FROM {orders} o""",
    "diagnoses": """
SELECT o.o_custkey AS SUBJECT_ID, l.l_orderkey AS HADM_ID, l.l_linenumber AS SEQ_NUM,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL
    WHEN l.l_partkey % 10 = 0 THEN 'E' || CAST(800 + l.l_partkey % 40 AS STRING)
    WHEN l.l_partkey % 10 = 1 THEN 'V' || CAST(10 + l.l_partkey % 40 AS STRING)
    ELSE CAST(440 + l.l_partkey % 100 AS STRING) || CAST(l.l_suppkey % 3 AS STRING) END AS ICD9_CODE
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey=l.l_orderkey""",
    "labevents": """
SELECT o.o_custkey AS SUBJECT_ID, l.l_orderkey AS HADM_ID, 50800 + l.l_suppkey % 40 AS ITEMID,
  CASE WHEN l.l_linenumber=7 THEN 'not done' ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) END AS VALUE,
  CASE WHEN l.l_linenumber=7 THEN NULL ELSE l.l_quantity END AS VALUENUM, l.l_shipdate AS CHARTTIME
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey=l.l_orderkey""",
    "prescriptions": """
SELECT o.o_custkey AS SUBJECT_ID, l.l_orderkey AS HADM_ID,
  CASE WHEN l.l_partkey % 53 = 0 THEN NULL ELSE LPAD(CAST(l.l_partkey % 120 AS STRING), 6, '0') END AS GSN,
  l.l_shipdate AS STARTDATE, CASE WHEN l.l_returnflag='R' THEN NULL ELSE l.l_shipdate END AS ENDDATE,
  CASE l.l_linenumber WHEN 1 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || ' mg'
    WHEN 2 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || '-' || CAST(CAST(l.l_quantity AS INT)+5 AS STRING)
    WHEN 3 THEN '>' || CAST(CAST(l.l_quantity AS INT) AS STRING)
    WHEN 4 THEN '1,' || LPAD(CAST(CAST(l.l_quantity AS INT) AS STRING),3,'0')
    WHEN 5 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || '-'
    WHEN 6 THEN '3/4' ELSE NULL END AS DOSE_VAL_RX
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey=l.l_orderkey""",
    "procedure_orders": """
SELECT o.o_custkey AS SUBJECT_ID, l.l_orderkey AS HADM_ID,
  CASE WHEN l.l_partkey % 53 = 0 THEN NULL ELSE LPAD(CAST(l.l_partkey % 120 AS STRING), 6, '0') END AS GSN,
  l.l_shipdate AS STARTDATE,
  CASE WHEN l.l_linenumber <= 4 THEN CAST(l.l_quantity / 4 AS STRING) WHEN l.l_linenumber = 5 THEN 'as needed'
    WHEN l.l_linenumber = 6 THEN '3/4' ELSE NULL END AS DOSE_VAL_RX
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey=l.l_orderkey""",
    "microbiology": """
SELECT e.event_id AS ROW_ID, e.user_id AS SUBJECT_ID,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE 90000 + e.event_id % 12 END AS AB_ITEMID,
  CASE e.event_type WHEN 'error' THEN 'R' WHEN 'click' THEN 'S' WHEN 'view' THEN 'I' WHEN 'signup' THEN 'P'
    ELSE NULL END AS INTERPRETATION,
  CAST(e.ts AS DATE) - 8600 AS CHARTTIME
FROM {events} e""",
    "notes": """
SELECT d.doc_id AS ROW_ID, d.doc_id % 150 AS SUBJECT_ID, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE d.doc_id END AS HADM_ID,
  DATE '1995-01-01' + CAST((d.doc_id * 37) % 2400 AS INT) AS CHARTDATE,
  CASE d.doc_id % 4 WHEN 0 THEN 'Discharge summary' WHEN 1 THEN 'Nursing' WHEN 2 THEN 'Radiology' ELSE 'ECG' END AS CATEGORY,
  d.text AS TEXT
FROM {documents} d""",
    "token_vectors": """
SELECT v.vec_id % 150 AS SUBJECT_ID, v.vec_id AS POS, v.embedding AS VEC, v.label AS ARRIVAL FROM {embeddings} v""",
    "scores": """
SELECT c.c_custkey AS SUBJECT_ID, CASE WHEN c.c_mktsegment='BUILDING' THEN 1 ELSE 0 END AS LABEL,
  CAST((c.c_custkey * 7919) % 101 AS DOUBLE) / 101 AS SCORE_A, CAST((c.c_custkey * 104729) % 37 AS DOUBLE) / 37 AS SCORE_B
FROM {customer} c""",
}


def tables_in(template: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(template) if name})


class Fixtures:
    """Lazy access to the views for one data folder: ``Fixtures(spark, dir).notes``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            template = VIEWS[name]
            table = self.spark.sql(template, **{t: getattr(self, t) for t in tables_in(template)})
        elif name in BASE_TABLES:
            table = self.spark.read.schema(BASE_TABLES[name]).parquet(table_path(self.folder, name))
        else:
            raise AttributeError(name)
        setattr(self, name, table)
        return table
