"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .tables import floats, fold, pieces_of

_WORD = re.compile(r"\w+")
#: Forms that address the reader, in a few languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti toi vous votre vos usted ustedes du dich dir dein deine ihr euch sie".split())
#: Signs that stand for letters in disguised words.
_DISGUISE = str.maketrans("013457@$!|*", "oieastasii*")
# from the first letter of a run only, without going back: a text of one run is read once
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!|*]++[^\W\d_]+")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_SPELT = re.compile(r"\b(?:[^\W\d_][ .\-*]){3,}[^\W\d_]\b")
_REACH = 8  # words within which address and insult count as near

FEATURES = (
    "strong_per_word", "weak_per_word", "strong_count", "strong_kinds", "disguised_per_word", "address_per_word",
    "address_near", "capital_share", "shouted_share", "exclamations", "questions", "punctuation_share", "mixed_share",
    "repeat_share", "spelt_out", "log_words",
)


def stem(word: str) -> str:
    """A word's first four letters, marked: inflected insults share them."""
    return word[:4] + "-" if len(word) > 4 else ""


@dataclass
class Lexicon:
    """Words and stems that tell toxic documents of the training sample from others; strong ones tell more."""

    strong: frozenset[str]
    weak: frozenset[str]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text; all of them are 0 for an empty one."""
    lower = text.lower()
    words = _WORD.findall(lower)
    n, length = max(len(words), 1), max(len(text), 1)
    strong = [i for i, w in enumerate(words) if w in lexicon.strong or stem(w) in lexicon.strong]
    weak = sum(w in lexicon.weak or stem(w) in lexicon.weak for w in words)
    address = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    mixed = _MIXED.findall(lower)
    disguised = sum(m.translate(_DISGUISE) in lexicon.strong for m in mixed)
    near = 0
    if strong and address:
        at = np.searchsorted(address, strong)
        places = np.array([-(10**9), *address, 10**9])
        near = int((np.minimum(np.array(strong) - places[at], places[at + 1] - np.array(strong)) <= _REACH).sum())
    capitals = sum(map(str.isupper, text)) if not text.isascii() else sum(text.count(chr(c)) for c in range(65, 91))
    shouted = sum(w.isupper() and len(w) > 2 for w in _WORD.findall(text)) if capitals > 2 else 0
    signs = sum(text.count(c) for c in "!?.,;:*#%&$@")
    return [
        len(strong) / n, weak / n, float(len(strong)), float(len({words[i] for i in strong})), disguised / n,
        len(address) / n, near / n, capitals / length, shouted / n, text.count("!") / n, text.count("?") / n,
        signs / length, len(mixed) / n, len(_REPEAT.findall(lower)) / n,
        len(_SPELT.findall(lower)) / n, float(np.log1p(len(words))),
    ]


def add_features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``features`` (array of double) of every row; needs a column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            matrix = np.array([features(t or "", shared.value) for t in batch["text"].to_pylist()])
            matrix = matrix.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], floats(matrix)], [*keep, "features"])

    rows = docs.select(*keep, "text")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def training_sample(
    docs: DataFrame, labels: DataFrame, most_rows: int, id_column: str, text_column: str, label_column: str
) -> DataFrame:
    """``doc_id, label, part, text`` of about ``most_rows`` labelled rows outside the held-out fold, one per text."""
    known = (
        labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).cast("bigint").alias("doc_id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("label"))
        .filter(fold("doc_id") != 0)
    )
    count = known.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, most_rows / max(count, 1))) + 1)
    ids = F.broadcast(known.filter(drawn))  # as many short rows as most_rows allows
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = rows.join(ids, "doc_id").withColumn("_copy", F.xxhash64("text"))
    # copies of one text would teach words that only they share
    return (
        found.groupBy("_copy", "label").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
        .select("doc_id", "label", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("part"), "text")
    )


def learn_lexicon(sample: DataFrame, most_words: int = 1000, least_share: float = 0.02) -> Lexicon:
    """Words and stems of toxic sample documents whose odds against the others are high.

    One is taken if ``least_share`` of the toxic documents, five at least, hold it; ``most_words`` bounds the result.
    """

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            words, marks = [], []
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                found = {w for w in _WORD.findall(text.lower()) if len(w) < 40}
                found |= {s for w in found if (s := stem(w))}
                words += found
                marks += [label] * len(found)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(marks, pa.int32())], ["word", "label"])

    totals = sample.groupBy().agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("c")).first()
    toxic, clean = totals["t"] or 0, totals["c"] or 0
    counts = sample.select("text", "label").mapInArrow(distinct_words, "word string, label int").groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") != 1).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    chosen = (
        counts.filter(F.col("t") >= max(5, least_share * toxic))
        .select("word", odds.alias("odds"))
        .filter(F.col("odds") > 0.7)
        .orderBy(F.col("odds").desc(), "word")
        .limit(most_words)
        .collect()
    )
    strong = frozenset(r["word"] for r in chosen if r["odds"] >= 3)
    return Lexicon(strong, frozenset(r["word"] for r in chosen) - strong)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float  # what every text scores when there was nothing to learn


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 20_000,
    rounds: int = 20,
    depth: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> ToxicityModel:
    """Learn lexicon, trees and calibration from a bounded sample of labelled rows outside the held-out fold.

    ``most_rows`` bounds the sample. Lexicon and trees use three of its four other folds, the isotonic
    calibration the fourth, so it sees scores of texts that taught nothing. Null labels, null ids and
    labels without a document are not used; of contradicting labels the larger counts. With one class or none, or a
    calibration fold without both, there is no model and every score is the sample's rate.
    """
    sample = stage(training_sample(docs, labels, most_rows, id_column, text_column, label_column), "sample")
    counts = {(r["c"], r["label"]): r["n"] for r in sample.groupBy((F.col("part") == 1).alias("c"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    rate = sum(n for (_, label), n in counts.items() if label == 1) / total if total else 0.0
    if any((part, label) not in counts for part in (True, False) for label in (0, 1)):
        return ToxicityModel(Lexicon(frozenset(), frozenset()), None, None, rate)
    lexicon = learn_lexicon(sample.filter(F.col("part") != 1))
    rows = stage(add_features(sample, lexicon, ["doc_id", "label", "part"]), "features")
    vectors = rows.select("doc_id", "part", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    few = vectors.filter(F.col("part") != 1).coalesce(4)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=32, seed=7, minInstancesPerNode=5).fit(few)
    scored = trees.transform(vectors.filter(F.col("part") == 1)).select(
        "label", vector_to_array("probability")[1].alias("probability")
    )
    calibration = IsotonicRegression(featuresCol="probability", labelCol="label", predictionCol="score").fit(scored)
    return ToxicityModel(lexicon, trees, calibration, rate)


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the raw ``probability`` of every whole text.

    Null counts as empty, and an empty text is scored like any other. Repeated rows are kept, nothing is shuffled,
    and no column but id and text is looked at.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        (fold(id_column) == 0).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    if model.trees is None:
        constant = rows.select("doc_id", "held_out", F.lit(float(model.rate)).alias("score"), F.lit(float(model.rate)).alias("probability"))
    else:
        ready = add_features(rows, model.lexicon, ["doc_id", "held_out"]).withColumn("features", array_to_vector("features"))
        graded = model.trees.transform(ready).select("doc_id", "held_out", vector_to_array("probability")[1].alias("probability"))
        constant = model.calibration.transform(graded)
    bounded = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return constant.select("doc_id", "held_out", bounded.alias("score"), (bounded >= 0.5).cast("int").alias("predicted"), "probability")
