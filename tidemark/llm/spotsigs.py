"""SpotSigs document fingerprints: chains of content words behind common-word anchors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces_of, shuffle_tasks

#: Common words of a few languages: they are frequent in running text and rare in menus and tables.
ANCHORS = frozenset(
    "a an and are as at be but by for from has he in is it not of on or that the this to was were which with "
    "au ce dans de des du elle en est et il la le les mais ne par pas pour que qui sur un une "
    "das dem den der die ein eine einer es ist mit nicht sich sie und von war zu zur "
    "con del el ella era las los no para pero por se sin son su una y".split()
)
_WORD = re.compile(r"\w+")
_START = "^"


def spots(text: str, chain: int = 2, anchors: Iterable[str] = ANCHORS) -> set[int]:
    """Signatures of a whole text: an anchor and the ``chain`` content words that follow it, hashed to 32 bits.

    The start of the text is an anchor too, a text without any common word has every word as an anchor, and
    a chain that the end cuts short counts, so a text with one word has a signature and one without has none.
    """
    words = _WORD.findall(text.lower())
    content, heads = [], [(_START, 0)]
    for word in words:
        if word in anchors:
            heads.append((word, len(content)))
        else:
            content.append(word)
    if len(heads) == 1:
        heads += [(word, at + 1) for at, word in enumerate(content)]
    if not words:
        return set()
    return {zlib.crc32(" ".join((head, *content[at : at + chain])).encode()) for head, at in heads}


def print_of(signatures: set[int]) -> str:
    """A fingerprint as text: the sorted signatures, eight hex digits each."""
    return np.sort(np.fromiter(signatures, np.uint32, len(signatures))).astype(">u4").tobytes().hex()


def likeness(a: set[int], b: set[int], floor: float = 0.0) -> float:
    """Jaccard likeness, or 0 where the set lengths alone keep it below ``floor``; two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < floor * large:
        return 0.0
    shared = len(a & b)
    return shared / (small + large - shared)


def length_class(size, threshold: float):
    """Number of a set-length partition: sets of likeness ``threshold`` are in the same one or in neighbours."""
    return F.floor(F.log(size) / F.lit(-log(threshold))).cast("int")


def fingerprints(docs: DataFrame, chain: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, signatures`` (array of bigint, sorted) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            found = [sorted(spots(t or "", chain)) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, signatures array<long>")


def alike_classes(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``doc_id, class_id`` of every row and ``a, b, likeness`` of class pairs.

    A class holds the documents of equal signature sets and is named by its smallest id; documents without
    signatures are one class. Classes are paired when their Jaccard likeness is ``threshold`` or more. Sets are
    partitioned by length, so partners are in the same or the next partition. Within one, signatures go from
    rare to frequent and only the first ``n - ceil(threshold * n) + 1`` are looked up: alike sets share one
    of those, and a frequent signature hardly ever is among them. Candidates whose lengths rule them out are
    pruned before their sets are compared. Rows with a null id have a null class unless another document shares it.
    """
    key = F.sha2(F.concat_ws(",", F.col("signatures").cast("array<string>")), 256)
    keyed = prints.select("doc_id", "signatures", key.alias("_key"))
    classes = keyed.groupBy("_key").agg(F.min("doc_id").alias("id"))
    sets = keyed.join(classes, "_key").filter(F.col("doc_id") == F.col("id")).select("id", "signatures").dropDuplicates(["id"])
    members = keyed.select("doc_id", "_key").join(classes, "_key").select("doc_id", F.col("id").alias("class_id"))
    spread = sets.filter(F.size("signatures") > 0).select("id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    frequency = spread.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ordered = (
        spread.join(frequency, "s")
        .groupBy("id", "n")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "s"))), lambda x: x["s"]).alias("rare"))
        .withColumn("part", length_class(F.col("n"), threshold))
    )
    looked = F.slice("rare", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    entries = ordered.select("id", "n", "part", F.explode(looked).alias("s"))
    left = entries.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "part", "s")
    right = entries.select(
        F.col("id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "s"
    )
    same_part = F.col("n_a") >= F.col("n_b")
    first = (F.col("n_a") > F.col("n_b")) | (F.col("a") < F.col("b"))
    candidates = (
        left.join(right, ["s", "part"])
        .filter(same_part & first & (F.col("a") != F.col("b")) & (F.col("n_b") >= F.col("n_a") * threshold))
        .select("a", "b")
        .distinct()
    )
    with_a = candidates.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("likeness"))
    pairs = scored.filter(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return members, pairs


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edit_probe(
    docs: DataFrame, chain: int = 2, floor: float = 0.0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The next document has the next smaller id, and after the smallest comes the largest. The edited text
    has the last third of the text replaced by the start of the next one. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures``.

    Ids are cut into ranges at quantiles and every range is one ordered group; the largest id of a range is
    also sent to the range above, whose last document it follows. So whole texts are shuffled once and a task
    holds two of them. Null texts are empty, a null id is below all others, a single document follows itself.
    Of rows that repeat an id, ``text`` breaks the tie.
    """
    from hashlib import sha256

    ranges = 4 * shuffle_tasks(docs)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    ids = rows.select("doc_id", order.alias("_order")).filter(~F.isnan("_order"))
    steps = [i / ranges for i in range(1, ranges)]
    found = ids.filter(F.col("doc_id").isNotNull()).agg(F.percentile_approx("_order", steps, 20 * ranges)).first()[0]
    splits = [float("-inf"), *sorted(set(found or (0.0,))), float("inf")]
    split = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep")
    # one row per range: its number and largest id; as many rows as there are ranges at most
    heads = sorted(
        (int(r["_range"]), r["head"])
        for r in split.transform(ids).groupBy("_range").agg(F.max("doc_id").alias("head")).collect()
    )
    plain = split.transform(rows.withColumn("_order", order)).withColumn("_range", F.col("_range").cast("int")).drop("_order")
    # the head of a range closes the range above; that of the highest closes the lowest
    closes = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}
    named = {k: v for k, v in closes.items() if k is not None}
    above = F.element_at(F.create_map(*[F.lit(x).cast("bigint" if i % 2 == 0 else "int") for pair in named.items() for i, x in enumerate(pair)]), F.col("doc_id")) if named else F.lit(None).cast("int")
    if None in closes:
        above = F.when(F.col("doc_id").isNull(), F.lit(closes[None])).otherwise(above)
    places = F.array_compact(
        F.array(
            F.struct(F.col("_range").alias("range"), F.lit(False).alias("closing")),
            F.when(above.isNotNull(), F.struct(above.alias("range"), F.lit(True).alias("closing"))),
        )
    )
    dealt = plain.select("doc_id", "text", F.inline(places))
    sorted_rows = dealt.repartition(shuffle_tasks(docs), "range").sortWithinPartitions(
        F.col("range"), F.col("closing"), F.col("doc_id").desc_nulls_last(), F.col("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in pieces_of(batches, 4_000_000):
            out = []
            columns = (batch[c].to_pylist() for c in ("doc_id", "text", "closing"))
            for doc_id, text, closing in zip(*columns):
                signatures = spots(text, chain)
                if before is not None:
                    own_id, own_text, own = before
                    edited = _edited(own_text, text)
                    changed = spots(edited, chain)
                    out.append(
                        (
                            own_id, len(own_text), sha256(edited.encode()).hexdigest(), print_of(own), print_of(changed),
                            likeness(own, changed, floor), likeness(own, signatures, floor), len(own),
                        )
                    )
                before = None if closing else (doc_id, text, signatures)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
    kinds = ["long", "long", "string", "string", "string", "double", "double", "long"]
    return sorted_rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
