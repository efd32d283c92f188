"""Text vectors: encoding, pooling, storing."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY
from ..sources.writers import embeddings_or_empty, missing_entities

Encoder = Callable[[Sequence[str]], np.ndarray]


class HashingEncoder:
    """A deterministic stand-in for a language model.

    A word's vector is 1 or -1 at one position, both taken from its MD5; a text's vector is the mean
    over its words.
    """

    def __init__(self, width: int = 32):
        self.width = width

    def _cell(self, word: str) -> int:
        """The word's position, moved up by the width when its sign is negative."""
        digest = hashlib.md5(word.encode()).hexdigest()
        return int(digest[:8], 16) % self.width + (0 if digest[8] < "8" else self.width)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        cells: dict[str, int] = {}  # of this call's words, each hashed once
        for row, text in enumerate(texts):
            words = re.findall(r"\w+", (text or "").lower(), flags=re.ASCII)
            if words:
                counts = np.zeros(2 * self.width)
                for word, times in Counter(words).items():
                    if word not in cells:
                        cells[word] = self._cell(word)
                    counts[cells[word]] += times
                out[row] = (counts[: self.width] - counts[self.width :]) / len(words)
        return out


def embed_text(
    docs: DataFrame, make_encoder: Callable[[], Encoder], text: str = "to_tok", tasks: int | None = None
) -> DataFrame:
    """``(entity_id, vec)``: the text column encoded in Arrow batches.

    ``make_encoder`` runs once per worker task, so a model is loaded there and not shipped.
    ``tasks`` spreads the texts first; without it a small table of texts may be few tasks,
    which is too few for a slow encoder.
    """
    # worker tasks need not have this package installed to use the encoder
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    docs = docs.select(ENTITY, text)
    if tasks:
        docs = docs.repartition(tasks, ENTITY)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.tolist()), dtype="float64")))

    # marked so that the optimiser does not run the encoder a second time inside a filter
    once = encode.asNondeterministic()
    return docs.select(ENTITY, once(F.col(text)).alias("vec"))


def text_windows(docs: DataFrame, text: str = "to_tok", size: int = 256, step: int = 192) -> DataFrame:
    """``entity_id, window, n_words, text``: overlapping windows of at most ``size`` blank-separated words, ``step`` apart.

    Every word is in a window, and a text that fits one has one; so does an empty or null text, of no words.
    """
    if not 0 < step <= size:
        raise ValueError("windows must not leave words out")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    last = F.greatest(F.ceil((F.size("_words") - size) / step), F.lit(0)).cast("int")
    windows = docs.select(ENTITY, words.alias("_words")).select(ENTITY, "_words", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    own = windows.select(ENTITY, "window", F.slice("_words", F.col("window") * step + 1, F.lit(size)).alias("_own"))
    return own.select(ENTITY, "window", F.size("_own").alias("n_words"), F.array_join("_own", " ").alias("text"))


def embed_windows(
    docs: DataFrame,
    make_encoder: Callable[[], Encoder],
    text: str = "to_tok",
    size: int = 256,
    step: int = 192,
    tasks: int = 64,
    lengths: int = 8,
) -> DataFrame:
    """``entity_id, vec``: texts of any length by an encoder that takes ``size`` words, as the mean of their windows by words.

    Windows are dealt to ``tasks`` tasks at random places and sorted by length class there, so a batch holds windows of like
    length and a long text is not one task's work. The mean over windows is a running aggregate. A text without words
    keeps its encoder's vector of the empty text.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    windows = text_windows(docs, text, size, step)
    by_class = F.floor(F.col("n_words") * lengths / size)
    dealt = windows.repartition(tasks, F.xxhash64(ENTITY, "window")).sortWithinPartitions(by_class)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch.tolist()), dtype="float64")))

    once = encode.asNondeterministic()
    weight = F.greatest(F.col("n_words"), F.lit(1)).cast("double").alias("weight")
    vectors = dealt.select(ENTITY, weight, array_to_vector(once("text")).alias("vec"))
    pooled = vectors.groupBy(ENTITY).agg(Summarizer.mean(F.col("vec"), F.col("weight")).alias("mean"))
    return pooled.select(ENTITY, vector_to_array("mean").alias("vec"))


def mean_pool(token_vectors: DataFrame, mask: str | None = None) -> DataFrame:
    """``(entity_id, vec)``: the mean of an entity's vectors, as an array of the input's width.

    All vectors count unless ``mask`` names a boolean column. A task holds one running mean per entity,
    so an entity with very many vectors sends one row per task.
    """
    rows = token_vectors.filter(F.col(mask)) if mask else token_vectors
    wide = rows.select(ENTITY, array_to_vector(F.col("vec").cast("array<double>")).alias("vec"))
    return wide.groupBy(ENTITY).agg(Summarizer.mean(F.col("vec")).alias("mean")).select(ENTITY, vector_to_array("mean").alias("vec"))


def mean_by_position(token_vectors: DataFrame, mask: str | None = None) -> DataFrame:
    """``(entity_id, pos, mean)``: the mean vector, one row per position."""
    return mean_pool(token_vectors, mask).select(ENTITY, F.posexplode("vec").alias("pos", "mean"))


def update_embedding_store(
    docs: DataFrame, path: str, make_encoder: Callable[[], Encoder], text: str = "to_tok", tasks: int | None = None
) -> DataFrame:
    """Encode only the entities the store lacks, append them, and return the whole store.

    ``docs`` holds one row per entity. What the store has is looked up once, by id, before anything is encoded.
    """
    spark = docs.sparkSession
    todo = missing_entities(docs, embeddings_or_empty(spark, path))
    embed_text(todo, make_encoder, text, tasks).write.mode("append").parquet(path)
    return embeddings_or_empty(spark, path)


def as_long(vectors: DataFrame, prefix: str = "EMBED_") -> DataFrame:
    """Vector elements as long feature rows."""
    return vectors.select(ENTITY, F.posexplode("vec").alias("_pos", "value")).select(
        ENTITY, F.concat(F.lit(prefix), F.col("_pos").cast("string")).alias("feature"), "value"
    )
