"""Language ID by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import fold, pieces_of, raw_texts

UNKNOWN = "und"
_BITS = 12  # of a feature's hash
_ORDERS = (1, 2, 3, 4)  # bytes in a gram
_STEP = 1 << 20  # bytes of a text looked at together
# ASCII letters in lower case, other ASCII as space; bytes of other scripts as they are
_PLAIN = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    plain = text.translate(_PLAIN)
    if plain.isascii():
        return bool(plain.strip())
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def gram_features(text: bytes) -> np.ndarray:
    """Square roots of hashed n-gram counts of the whole text, scaled to length one."""
    counts = np.zeros(1 << _BITS, np.float64)
    plain = b" " + text.translate(_PLAIN) + b" "
    for at in range(0, len(plain), _STEP):
        # a step also sees the bytes that a gram begun in it needs
        octets = np.frombuffer(plain[at : at + _STEP + max(_ORDERS) - 1], np.uint8).astype(np.uint32)
        gram = octets
        for order in _ORDERS:
            if order > 1:
                gram = gram[:-1] * np.uint32(257) + octets[order - 1 :]
            hashed = ((gram + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(32 - _BITS)
            counts += np.bincount(hashed[:_STEP], minlength=1 << _BITS)
    counts = np.sqrt(counts)
    return (counts / max(float(np.linalg.norm(counts)), 1e-12)).astype(np.float32)


def codebook(classes: int, seed: int = 0) -> np.ndarray:
    """A row of +1 and -1 per class. Up to 7 classes get every split of the classes once, more get random splits."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 7:
        columns = range(1, 2 ** (classes - 1))
        return np.array([[1 if c == 0 or not (bits >> (c - 1)) & 1 else -1 for bits in columns] for c in range(classes)])
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best = None
    for _ in range(50):
        code = rng.choice([-1, 1], (classes, width))
        code[:, np.abs(code.sum(axis=0)) == classes] *= rng.choice([-1, 1], (classes, 1))
        apart = width - np.abs(code @ code.T).astype(float)
        nearest = apart[~np.eye(classes, dtype=bool)].min()
        if best is None or nearest > best[0]:
            best = nearest, code
    return best[1]


@dataclass
class LanguageModel:
    """Linear classifiers, one for each bit of the codewords."""

    languages: list[str]
    code: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    trust: np.ndarray = field(repr=False)  # weight of a bit's loss

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword, rows by classes."""
        margins = features @ self.weights + self.bias
        return np.stack([np.logaddexp(0, -margins * row) @ self.trust for row in self.code], axis=1)

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share against the others, and the share of the second."""
        losses = self.losses(features)
        odds = np.exp(losses.min(axis=1, keepdims=True) - losses)
        shares = odds / odds.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        ordered = np.sort(shares, axis=1)
        second = ordered[:, -2] if shares.shape[1] > 1 else np.zeros(len(shares))
        return best, ordered[:, -1], second


def _fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-4):
    """Logistic classifiers of all bits at once, by accelerated gradient steps on features centred in place."""
    mean = x.mean(axis=0)
    x -= mean
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        probe = x.T @ (x @ probe)
        norm = float(np.linalg.norm(probe))
        probe = probe / max(norm, 1e-12)
    rate = 1 / (max(norm, 1e-9) / len(x) / 4 + 0.25 + ridge)
    weights, bias = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    w_ahead, b_ahead = weights, bias
    for step in range(1, steps + 1):
        pull = (-y / (1 + np.exp(y * (x @ w_ahead + b_ahead)))).astype(np.float32) / len(x)
        w_next = w_ahead - rate * (x.T @ pull + ridge * w_ahead)
        b_next = b_ahead - rate * pull.sum(axis=0)
        momentum = (step - 1) / (step + 2)
        w_ahead, b_ahead = w_next + momentum * (w_next - weights), b_next + momentum * (b_next - bias)
        weights, bias = w_next, b_next
    # features have length one, so margins are scaled up to where a bit is nearly sure
    margins = x @ weights + bias
    scale = 3 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
    right = (margins * y > 0).mean(axis=0)
    return weights * scale, (bias - mean @ weights) * scale, np.maximum(right - 0.5, 0.01) * 2


def training_rows(docs: DataFrame, most_rows: int, id_column: str, text_column: str, lang_column: str) -> tuple[DataFrame, int]:
    """At most ``most_rows`` labelled rows outside the held-out fold, evenly over the languages, and how many they can be."""
    labelled = docs.filter((fold(id_column) != 0) & F.col(lang_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, most_rows // max(len(counts), 1))
    if not counts:
        return labelled.limit(0), 0
    # a hash below a language's share leaves a few more rows than wanted; only those are ranked
    share = F.element_at(
        F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * each / n + 20 / n))]), F.col("lang")
    )
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = labelled.filter(drawn < share).withColumn("_rank", F.row_number().over(ranked))
    room = sum(min(each, n) for n in counts.values())
    return few.filter(F.col("_rank") <= each).select("doc_id", "text", "lang"), room


def _float_rows(column: pa.BinaryArray) -> np.ndarray:
    """Binary values of one length as rows of a matrix over the same memory."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(column), -1)


def _fill(batches: Iterator[pa.RecordBatch], room: int) -> tuple[list[str], np.ndarray]:
    """Languages and features of a sorted sample; the features are held once, the batches one at a time."""
    names: list[str] = []
    x = np.empty((room, 1 << _BITS), np.float32)
    for batch in batches:
        if batch.num_rows:
            x[len(names) : len(names) + batch.num_rows] = _float_rows(batch["features"])
            names += batch["lang"].to_pylist()
    return names, x[: len(names)]


def _fit_rows(names: list[str], x: np.ndarray) -> LanguageModel:
    """The model of features ``x``, which are centred in place."""
    languages = sorted(set(names))
    code = codebook(len(languages))
    if not languages:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((1 << _BITS, 1)), np.zeros(1), np.ones(1))
    place = {lang: i for i, lang in enumerate(languages)}
    y = code[[place[n] for n in names]].astype(np.float32)
    return LanguageModel(languages, code, *_fit_bits(x, y))


def fit(
    docs: DataFrame,
    most_rows: int = 3000,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> LanguageModel:
    """Fit on a bounded, hash-drawn sample of labelled rows outside the held-out fold.

    ``most_rows`` bounds the sample and with it what one task holds: hashed features of the sample's whole texts, 16 KB a
    row. The classifiers are fitted there, so only the model reaches the driver. Rows with a null language are not
    used; texts without a letter teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = raw_texts(batch["text"])
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            features = [gram_features(texts[i]).tobytes() for i in kept]
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.record_batch(
                [rows["doc_id"], rows["lang"], pa.array(features, pa.binary())], ["doc_id", "lang", "features"]
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, x = _fill(batches, room)
        yield pa.record_batch([pa.array([pickle.dumps(_fit_rows(names, x))], pa.binary())], ["model"])

    sample, room = training_rows(docs, most_rows, id_column, text_column, lang_column)
    if not room:
        return _fit_rows([], np.empty((0, 1 << _BITS), np.float32))
    rows = sample.mapInArrow(run, "doc_id long, lang string, features binary")
    in_order = rows.repartition(1).sortWithinPartitions("lang", "doc_id")
    fitted = in_order.mapInArrow(train, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else _fit_rows([], np.empty((0, 1 << _BITS), np.float32))


def predict(
    docs: DataFrame,
    model: LanguageModel,
    least_lead: float = 0.2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is everything if no row had a label.
    ``score`` is the chosen codeword's share, ``ambiguous`` marks a lead over the second below
    ``least_lead``. Equal losses go to the first language in order. Repeated rows are kept; the input's other
    columns are not looked at. The model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces_of(batches, 8_000_000):
            texts = raw_texts(batch["text"])
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            unsure = np.ones(len(texts), bool)
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
            for at in range(0, len(known), 512):
                rows = known[at : at + 512]
                best, first, second = model.predict(np.stack([gram_features(texts[i]) for i in rows]))
                for i, b in zip(rows, best):
                    names[i] = model.languages[b]
                scores[rows], unsure[rows] = first, first - second < least_lead
            yield pa.record_batch(
                [batch["doc_id"], batch["held_out"], pa.array(names), pa.array(scores), pa.array(unsure)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), (fold(id_column) == 0).alias("held_out"), F.col(text_column).alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted_documents(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with a predicted language, with the columns they came with; ``und`` ones go.

    The decision is made where the row is, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces_of(batches):
            texts = raw_texts(batch[text_column])
            lettered = np.fromiter(map(has_letter, texts), bool, len(texts))
            rows = np.flatnonzero(lettered) if model.languages else []
            kept = []
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                best, _, _ = model.predict(np.stack([gram_features(texts[i]) for i in some]))
                kept += [i for i, b in zip(some.tolist(), best) if model.languages[b] != UNKNOWN]
            yield batch.take(pa.array(kept, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
