"""A corpus pipeline over ``documents``: language ID, exact dedup, near dedup, mixing, tokens.

Every stage takes all rows its predecessor kept and returns the columns it got, but for the last, which
adds the token ids. Counts, samples and statistics are those of the stage's own input.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, pieces, simhash, trie_dedup
from tidemark.llm.queries import PIECE_MODEL
from tidemark.session import fresh_path, stage, staging


#: Of rows sent to Python at once.
BATCH_BYTES = 4_000_000


@contextmanager
def short_plan_texts(spark: SparkSession) -> Iterator[None]:
    """Spark's driver keeps the text of every plan that a job ran by, in each form it had; here those are many and long."""
    wanted = {"spark.sql.maxPlanStringLength": "2000", "spark.sql.ui.explainMode": "simple"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of 4 MB at most; both sides hold a batch and its results.

    The setting stays: the frame that a stage returns runs after the stage's function has ended.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold; documents that are ``und`` go."""
    small_batches(spark)
    return langid.accepted_documents(docs, langid.fit(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the row with the largest id stays."""
    small_batches(spark)
    return trie_dedup.distinct_texts(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of likeness 0.8 in five-word shingles stays, the one with the smallest id.

    Prints propose the pairs, with a limit and masks that miss under 1 % of those at 0.8; the shingle sets decide.
    """
    small_batches(spark)
    distance = simhash.bits_apart(0.8, 128, deviations=3)
    with short_plan_texts(spark):
        return simhash.one_of_each_group(
            docs, words=5, width=2, repeats=False, distance=distance, likeness=0.8, bits=16, rounds=10
        )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by the weights and share of the mixing query."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; decoding gave every text back where ``round_trip`` is true."""
    small_batches(spark)
    table = pieces.load(PIECE_MODEL)
    both = pieces.encode_and_decode(docs, table)
    added = ["token_ids", F.size("token_ids").alias("n_tokens"), pieces.same_text("text", "decoded").alias("round_trip")]
    return both.select(*docs.columns, *added)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("tokens", tokens),
]

#: Model fits and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        target = fresh_path(spark, name)
        with staging(spark):  # what a stage wrote on its way goes with it
            docs = stage(function(spark, docs, sf_dir), name, target)
    return STAGES[-1][1](spark, docs, sf_dir)
