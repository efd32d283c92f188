"""Term weights of documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY, FEATURE, VALUE
from ..session import stage


def tokens(docs: DataFrame, text: str = "clean_text", stop_words: Iterable[str] = ()) -> DataFrame:
    """``(entity_id, term)`` rows: words of two or more characters."""
    words = docs.select(ENTITY, F.explode(F.split(text, " ")).alias("term")).filter(F.length("term") >= 2)
    stop = list(stop_words)
    return words.filter(~F.col("term").isin(stop)) if stop else words


def term_counts(docs: DataFrame, text: str = "clean_text", stop_words: Iterable[str] = ()) -> DataFrame:
    """``(entity_id, term, tf)``, counted on each task before the shuffle."""
    return tokens(docs, text, stop_words).groupBy(ENTITY, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms with their document frequency; ties go by name."""
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    return per_term.orderBy(F.desc("n"), "term").limit(size).select("term", "df")


def tfidf(
    docs: DataFrame, size: int = 200, text: str = "clean_text", stop_words: Iterable[str] = (), prefix: str = "TFIDF_"
) -> DataFrame:
    """Long TF-IDF features of the ``size`` most frequent terms, one document per entity.

    ``idf = ln((1 + n) / (1 + df)) + 1``; each document's weights have length 1. The texts are
    split and counted once: the vocabulary and the weights read the same exchange. The
    vocabulary has ``size`` rows; the planner broadcasts it if that is small.
    """
    counts = term_counts(docs, text, stop_words)
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    terms = vocabulary(counts, size).select("term", idf.alias("idf"))
    weighted = counts.join(terms, "term").select(ENTITY, "term", (F.col("tf") * F.col("idf")).alias("w"))
    # at most `size` entries per document
    packed = weighted.groupBy(ENTITY).agg(
        F.collect_list(F.struct("term", "w")).alias("cells"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    return packed.select(ENTITY, "norm", F.inline("cells")).select(
        ENTITY, F.concat(F.lit(prefix), "term").alias(FEATURE), (F.col("w") / F.col("norm")).alias(VALUE)
    )


def hashing_tfidf(docs: DataFrame, words: str = "words", buckets: int = 100, min_doc_freq: int = 3) -> DataFrame:
    """Hashed term counts and their inverse-document-frequency weights as vectors."""
    hashed = HashingTF(inputCol=words, outputCol="raw_features", numFeatures=buckets).transform(docs)
    return IDF(inputCol="raw_features", outputCol="features", minDocFreq=min_doc_freq).fit(hashed).transform(hashed)


def portable_bucket(term: str | Column, buckets: int) -> Column:
    """A term's bucket by the first 32 bits of its MD5, which any engine can repeat."""
    column = F.col(term) if isinstance(term, str) else term
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint") % buckets


def portable_hashing_tfidf(docs: DataFrame, words: str = "words", buckets: int = 100, min_doc_freq: int = 3) -> DataFrame:
    """``entity_id, bucket, tf, df, weight``: hashed term counts and their weights, one row per bucket a document has.

    ``weight = tf * ln((n + 1) / (df + 1))``, 0 where fewer than ``min_doc_freq`` documents have the bucket. The form of
    :func:`hashing_tfidf` with a hash that does not depend on the engine. A document is a row of ``docs``, one per entity. Counts are
    added up on each task before the shuffle and written, so that texts are split once; document frequencies are at most
    ``buckets`` rows.
    """
    terms = docs.select(ENTITY, F.explode(words).alias("term"))
    counts = terms.groupBy(ENTITY, portable_bucket("term", buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))
    counts = stage(counts, "bucket_counts")
    frequency = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    idf = F.when(F.col("df") >= min_doc_freq, F.log((n_docs + 1) / (F.col("df") + 1))).otherwise(0.0)
    return counts.join(frequency, "bucket").select(ENTITY, "bucket", "tf", "df", (F.col("tf") * idf).alias("weight"))
