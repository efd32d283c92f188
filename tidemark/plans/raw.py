"""The raw extracts as a folder of gzip CSV files, or as Parquet made from them once."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import stage
from ..sources.clustered import open_clustered, read_layout, write_clustered_tables
from ..sources.readers import CORRUPT, read_csv, with_corrupt_column
from ..sources.writers import write_parquet
from .records import Records

# File names of the extracts.
FILES = {
    "patients": "PATIENTS.csv.gz",
    "admissions": "ADMISSIONS.csv.gz",
    "diagnoses": "DIAGNOSES_ICD.csv.gz",
    "labevents": "LABEVENTS.csv.gz",
    "prescriptions": "PRESCRIPTIONS.csv.gz",
    "notes": "NOTEEVENTS.csv.gz",
    "microbiology": "MICROBIOLOGYEVENTS.csv.gz",
}
SCHEMAS = {
    "patients": schemas.PATIENTS,
    "admissions": schemas.ADMISSIONS,
    "diagnoses": schemas.DIAGNOSES,
    "labevents": schemas.LABEVENTS,
    "prescriptions": schemas.PRESCRIPTIONS,
    "notes": schemas.NOTES,
    "microbiology": schemas.MICROBIOLOGY,
}


def read_extract(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One extract with its declared types; note texts may hold line breaks."""
    return read_csv(spark, f"{base}/{FILES[table]}", SCHEMAS[table], multi_line=table == "notes")


def load_records(spark: SparkSession, base: str) -> Records:
    """All extracts below ``base``. A gzip file is read by one task; :func:`convert` large ones first."""
    return Records(**{table: read_extract(spark, base, table) for table in FILES})


def misfits(rows: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """``table, line, field, reason`` of the lines that do not fit: a row per field that is unreadable, or one for the line.

    ``rows`` were read with a column for such lines. The line is split again as text and every field tried by itself.
    """
    names = [f.name for f in schema.fields]
    as_text = ", ".join(f"`{n}` STRING" for n in names)
    lines = rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    # one row per number of fields more than declared: the parser puts what is beyond in the last one
    parsed = lines.select("line", F.from_csv("line", f"{as_text}, _more STRING", {"escape": '"'}).alias("own"))
    bad = [
        F.when(
            F.col(f"own.{f.name}").isNotNull() & F.col(f"own.{f.name}").try_cast(f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("field"), F.lit(f"not a {f.dataType.simpleString()}").alias("reason")),
        )
        for f in schema.fields
        if f.dataType.simpleString() != "string"
    ]
    whole = F.struct(
        F.lit(None).cast("string").alias("field"),
        F.when(F.col("own._more").isNotNull(), "too many fields")
        .when(F.col(f"own.{names[-1]}").isNull(), "too few fields")
        .otherwise("unreadable")
        .alias("reason"),
    )
    found = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array()
    faults = F.when(F.col("own._more").isNull() & (F.size("found") > 0), F.col("found")).otherwise(F.array(whole))
    return parsed.withColumn("found", found).select(F.lit(table).alias("table"), "line", F.inline(faults))


def quarantine(rows: DataFrame, schema: T.StructType, table: str, clean: str, rejected: str, files: int | None = None) -> tuple[int, int, int]:
    """Write the rows that fit their types to ``clean`` and the lines that do not to ``rejected``; counts of all, clean and rejected lines.

    ``rows`` are read once and written, so the three counts are of the same rows; they must add up, or it is an error.
    """
    spark = rows.sparkSession
    # the parser gives the line only where the other columns are asked for too, so it is settled by writing
    read = stage(rows, f"read_{table}")
    write_parquet(read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), clean, files)
    write_parquet(misfits(read, schema, table), rejected)
    counts = (
        read.count(),
        spark.read.schema(schema).parquet(clean).count(),
        read.filter(F.col(CORRUPT).isNotNull()).count(),
    )
    if counts[0] != counts[1] + counts[2]:
        raise RuntimeError(f"{table}: {counts[0]} lines read, {counts[1]} clean and {counts[2]} rejected")
    return counts


def convert_with_quarantine(spark: SparkSession, base: str, out: str, files: int) -> dict[str, tuple[int, int, int]]:
    """As :func:`convert`, but lines that do not fit go to ``rejected/<table>`` instead of standing in the table."""
    counts = {}
    for table in FILES:
        rows = read_csv(spark, f"{base}/{FILES[table]}", with_corrupt_column(SCHEMAS[table]), multi_line=table == "notes")
        counts[table] = quarantine(rows, SCHEMAS[table], table, f"{out}/{table}", f"{out}/rejected/{table}", files)
    return counts


def convert(spark: SparkSession, base: str, out: str, files: int) -> dict[str, int]:
    """Rewrite the extracts as Parquet in ``files`` parts each, for all later runs.

    Returns how many lines of each table did not fit their types. Those lines are kept, with null where a field
    is unreadable, and stand as text in a column of the written table.
    """
    misfits = {}
    for table in FILES:
        schema = with_corrupt_column(SCHEMAS[table])
        rows = read_csv(spark, f"{base}/{FILES[table]}", schema, multi_line=table == "notes")
        write_parquet(rows, f"{out}/{table}", files)
        written = spark.read.schema(schema).parquet(f"{out}/{table}")
        misfits[table] = written.filter(F.col(CORRUPT).isNotNull()).count()
    return misfits


#: tables whose rows belong to an entity and are worked on per entity
CLUSTERED = ("patients", "admissions", "diagnoses", "labevents", "prescriptions", "notes", "microbiology")


def cluster(records: Records, out: str, buckets: int) -> DataFrame:
    """Write the tables below ``out`` bucketed and sorted by entity; the layout says how each came out."""
    tables = {f.name: getattr(records, f.name) for f in fields(records) if getattr(records, f.name) is not None}
    return write_clustered_tables(tables, out, "SUBJECT_ID", buckets, CLUSTERED)


def load_clustered(spark: SparkSession, base: str) -> Records:
    """The tables that :func:`cluster` wrote, with their buckets known to the planner."""
    tables = {}
    for table, (key, buckets) in read_layout(spark, base).items():
        schema = spark.read.parquet(f"{base}/{table}").schema
        tables[table] = open_clustered(spark, f"{base}/{table}", schema, key, buckets)
    return Records(**tables)


def load_converted(spark: SparkSession, base: str) -> Records:
    """The tables that :func:`convert` or :func:`cluster` wrote."""
    if read_layout(spark, base):
        return load_clustered(spark, base)
    return Records(**{t: spark.read.schema(SCHEMAS[t]).parquet(f"{base}/{t}") for t in FILES})
