"""Exact dedup by compressed radix (Patricia) tries whose terminal nodes own a text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tables import ascii_lower, pieces_of, raw_texts, shuffle_tasks

_LENGTH, _HASH, _COPIES = "_trie_length", "_trie_hash", "_trie_copies"


class RadixTrie:
    """Byte strings along compressed edges; a terminal node keeps the row that owns its text.

    A node is ``[label, children, owner]`` where ``children`` maps a first byte to a node. An owner
    is ``[rank, row, copies]``; of equal texts the largest rank owns, the first one among ties.
    """

    def __init__(self) -> None:
        self._root: list = [b"", {}, None]
        self.owners: list[list] = []

    def insert(self, text: bytes, rank, row: int, copies: int) -> None:
        node, at = self._root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = [text[at:], {}, None]
                node[1][text[at]] = child
                node, at = child, len(text)
                break
            label = child[0]
            if not text.startswith(label, at):
                child = self._split(node, child, self._shared(label, text, at))
            node, at = child, at + len(child[0])
        owner = node[2]
        if owner is None:
            node[2] = [rank, row, copies]
            self.owners.append(node[2])
        else:
            owner[2] += copies
            if rank > owner[0]:
                owner[0], owner[1] = rank, row

    @staticmethod
    def _shared(label: bytes, text: bytes, at: int) -> int:
        """Length of the common prefix of ``label`` and ``text[at:]``, by halving."""
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(label[low:middle], at + low):
                low = middle
            else:
                high = middle - 1
        return low

    @staticmethod
    def _split(parent: list, child: list, length: int) -> list:
        """Cut an edge in two and return the new inner node."""
        label = child[0]
        inner = [label[:length], {label[length]: child}, None]
        child[0] = label[length:]
        parent[1][label[0]] = inner
        return inner


def _winners(rows: pa.Table, id_column: str, text_column: str) -> pa.Table:
    """One row per distinct text, with its copies summed; a trie per (length, hash) cell."""
    texts = [t.lower() for t in raw_texts(rows[text_column].combine_chunks())]
    lengths, hashes = rows[_LENGTH].to_pylist(), rows[_HASH].to_pylist()
    copies = rows[_COPIES].to_pylist()
    ids = [float("-inf") if i is None else i for i in rows[id_column].to_pylist()]
    cells: dict[tuple[int, int], RadixTrie] = {}
    for row, text in enumerate(texts):
        cells.setdefault((lengths[row], hashes[row]), RadixTrie()).insert(text, ids[row], row, copies[row])
    owners = [owner for trie in cells.values() for owner in trie.owners]
    kept = rows.take(pa.array([row for _, row, _ in owners], pa.int64()))
    return kept.set_column(kept.schema.get_field_index(_COPIES), _COPIES, pa.array([n for _, _, n in owners], pa.int64()))


def _first_pass(id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            texts = [t.lower() for t in raw_texts(batch[text_column])]
            rows = pa.Table.from_batches([batch])
            rows = rows.append_column(_LENGTH, pa.array(map(len, texts), pa.int64()))
            rows = rows.append_column(_HASH, pa.array((xxhash.xxh3_64_intdigest(t) >> 1 for t in texts), pa.int64()))
            rows = rows.append_column(_COPIES, pa.array([1] * len(texts), pa.int64()))
            yield from _winners(rows, id_column, text_column).to_batches()

    return run


def _last_pass(id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in pieces_of(batches):
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows.cast(held.schema)])
            lengths, hashes = rows[_LENGTH].to_pylist(), rows[_HASH].to_pylist()
            start = len(lengths) - 1
            while start > 0 and lengths[start - 1] == lengths[-1] and hashes[start - 1] == hashes[-1]:
                start -= 1
            # cells before `start` are complete: their subtrees leave memory here
            if start:
                yield from _winners(rows.slice(0, start), id_column, text_column).to_batches()
            held = _winners(rows.slice(start), id_column, text_column)
        if held is not None:
            yield from held.to_batches()

    return run


def distinct_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row that stays of each group of equal texts, with all its columns and ``group_size``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so nulls and
    empty texts form one group. Of equal texts the largest id stays; a null id is below all others,
    and of rows that repeat id and text any one stays. An empty table gives an empty result.

    Every input batch goes through tries first, so a text reaches the shuffle once per batch and not
    once per copy. What is left is dealt out by length and content hash and sorted by them. A task
    then holds the trie of one cell at a time: Spark's external sort is what spills, and a finished
    subtree is written out and freed when the next cell begins. Full byte strings are compared, so
    texts that share length and hash stay apart. A column ``group_size`` of the input is replaced.
    """
    plain = docs.drop("group_size", _LENGTH, _HASH, _COPIES)
    added = [StructField(name, LongType()) for name in (_LENGTH, _HASH, _COPIES)]
    schema = StructType([*plain.schema.fields, *added])
    local = plain.mapInArrow(_first_pass(id_column, text_column), schema)
    dealt = local.repartition(shuffle_tasks(docs), _LENGTH, _HASH).sortWithinPartitions(_LENGTH, _HASH)
    owners = dealt.mapInArrow(_last_pass(id_column, text_column), schema)
    return owners.withColumn("group_size", F.col(_COPIES)).drop(_LENGTH, _HASH, _COPIES)


def text_digest(text_column: str = "text"):
    """Lower-case hex SHA-256 of the normalised text."""
    return F.sha2(ascii_lower(F.coalesce(F.col(text_column), F.lit(""))), 256)


def copy_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The owners come from :func:`distinct_texts`; members find theirs by the text's digest, a join of
    short rows in which adaptive execution can split the key of a very large group. Edge cases
    are those of :func:`distinct_texts`; repeated rows of the staying id are all marked kept.
    """
    owners = distinct_texts(docs.select(id_column, text_column), id_column, text_column).select(
        text_digest(text_column).alias("text_sha256"), F.col(id_column).alias("keep_id"), "group_size"
    )
    members = docs.select(id_column, text_digest(text_column).alias("text_sha256"))
    return members.join(owners, "text_sha256").select(
        id_column,
        "keep_id",
        "group_size",
        F.col(id_column).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
