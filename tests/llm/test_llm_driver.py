"""What the driver and the executors keep during the pipeline."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tidemark.llm import langid, pieces, simhash


def test_plan_texts_are_short_only_within(spark):
    keys = ("spark.sql.maxPlanStringLength", "spark.sql.ui.explainMode")
    before = [spark.conf.get(k) for k in keys]
    plan = spark.range(10).selectExpr(*[f"id + {i} AS a{i}" for i in range(300)])
    with corpus_pipeline.short_plan_texts(spark):
        assert len(plan._jdf.queryExecution().toString()) < 10_000
    assert [spark.conf.get(k) for k in keys] == before


def test_features_share_their_memory():
    rows = np.arange(12, dtype=np.float32).reshape(4, 3)
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    for part, wanted in ((column, rows), (column[1:3], rows[1:3])):
        got = langid._float_rows(part)
        assert (got == wanted).all() and not got.flags.owndata


def test_language_model_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's features stay off the driver; a model is what it gets."""
    def on_driver(*_):
        raise AssertionError("features reached the driver")

    monkeypatch.setattr(langid, "_fit_bits", on_driver)
    docs = spark.createDataFrame([(i, f"{'eins zwei drei' if i % 2 else 'one two three'} {i}", "de" if i % 2 else "en") for i in range(40)],
                                 "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ["de", "en"]


def test_language_model_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(i, "12 34", "de") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == []


def batch_sizes(df):
    """Bytes of the batches that Python gets."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], ["n"])

    return [r["n"] for r in df.mapInArrow(sizes, "n long").collect()]


def test_stages_send_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        for name, function in corpus_pipeline.STAGES:
            if name in ("exact_dedup", "tokens"):
                spark.conf.set(key, before)
                function(spark, docs.withColumn("doc_id", F.lit(1).cast("bigint")), "")
                assert max(batch_sizes(docs)) < 1.5 * corpus_pipeline.BATCH_BYTES, name
    finally:
        spark.conf.set(key, before)


def test_tokens_are_made_of_few_rows_at_a_time(spark):
    def seen(batch, table):
        return batch.append_column("n", pa.array([batch.nbytes] * batch.num_rows, pa.int64()))

    docs = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("word "), 200).alias("text"))
    got = pieces._mapped(docs, None, [StructField("n", LongType())], [(seen,)]).agg(F.max("n"), F.count("n")).first()
    assert got[0] < 600_000 and got[1] == 2000


def test_near_dedup_gives_spark_no_lists(spark, monkeypatch):
    """A list becomes an RDD of pickled rows, for which each executor keeps a second set of Python workers."""

    def no_list(*_, **__):
        raise AssertionError("a list was given to Spark")

    text = "a b c d e f g h i j k l m n o p"
    rows = [(1, text), (2, text + " q"), (3, "other words that stand here alone in a line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", no_list)
    kept = simhash.one_of_each_group(docs, words=5, width=2, repeats=False, distance=31, likeness=0.8, bits=16, rounds=10)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
