"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights and rounded.

Only the histogram, one count per length up to the capacity, is solved in one place; pieces are cut, numbered and placed
by Spark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordering import running_totals
from ..session import stage
from .tables import pieces_of, raw_texts

CAPACITY = 1024
END_ID = 2

# --- ids -----------------------------------------------------------------------------------------

# white space as Unicode lists it
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# white space and then letters a-z up to another sign of ASCII, or else all up to the next white space
_CHUNK = re.compile(rf"[{_BLANKS}]*(?:[A-Za-z]++(?![^\x00-\x7f])|[^{_BLANKS}]+)|[{_BLANKS}]+")
_BREAK = re.compile(f"[^{_BLANKS}](?=[{_BLANKS}])")
_KNOWN: dict[str, dict[str, bytes]] = {}


@cache
def _token_bytes(path: str) -> tuple:
    """The tokenizer, and how many bytes each of its tokens stands for."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    vocabulary = model.get_vocab()
    sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, number in vocabulary.items():
        sizes[number] = len(token)  # a byte-level token has one sign per byte
    return model, sizes


class ByteTokens:
    """Ids of texts by a byte-level tokenizer of the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    Such a tokenizer ends a word before white space, and a run of letters before another sign, whatever stands around. So a
    text may be cut into chunks there, and each distinct chunk goes through the library once: a worker remembers at most
    ``most`` chunks of at most ``longest`` characters. Long texts are cut into blocks.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 40, block: int = 1 << 20):
        self.model, self.sizes = _token_bytes(path)
        self.known = _KNOWN.setdefault(path, {})
        self.most, self.longest, self.block = most, longest, block

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks. Chunks that start with white space and end with a letter may follow each other in one text."""
        out = {}
        joined = [c for c in chunks if c[0] in _BLANKS and c[-1].isascii() and c[-1].isalpha()]
        for at in range(0, len(joined), 1024):
            some = joined[at : at + 1024]
            ids = np.asarray(self.model.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(c.encode()) for c in some])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) * 4 + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(some, (raw[i:j] for i, j in zip([0, *cuts], cuts))))
        others = [c for c in chunks if c not in out]
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            found = self.model.encode_batch_fast(some, add_special_tokens=False)
            out.update((c, np.asarray(f.ids, "<u4").tobytes()) for c, f in zip(some, found))
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        chunked = [_CHUNK.findall(t) for t in texts]
        found = [list(map(known.get, chunks)) for chunks in chunked]
        gaps = [i for i, own in enumerate(found) if None in own]
        new = {c for i in gaps for c, ids in zip(chunked[i], found[i]) if ids is None}
        if new:
            known |= self._encoded(list(new))
            for i in gaps:
                found[i] = map(known.__getitem__, chunked[i])
        out = [b"".join(own) for own in found]
        for chunk in new:
            if len(chunk) > self.longest:
                del known[chunk]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. All texts together should be no more than some blocks, but for single long ones."""
        done = iter(self._block([t for t in texts if len(t) <= self.block]))
        out = []
        for text in texts:
            if len(text) <= self.block:
                out.append(next(done))
                continue
            parts, at = [], 0
            while at < len(text):
                cut = _BREAK.search(text, at + self.block)
                end = cut.end() if cut else len(text)
                parts += self._block([text[at:end]])
                at = end
            out.append(b"".join(parts))
        return out


def cut_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, but for the first, which takes what is left over."""
    full, rest = divmod(tokens, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every whole text.

    A text's ids are the tokenizer's, then ``end_id``; a null text is empty, so it is that one id. A document of more than
    ``capacity`` ids is cut, its first piece being the short one. Other columns are not read; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens(tokenizer)
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in pieces_of(batches, 4_000_000):
            rows: list[tuple] = []
            texts = tokens([t.decode() for t in raw_texts(batch["text"])])
            for doc_id, own in zip(batch["doc_id"].to_pylist(), texts):
                ids, start = memoryview(own + last), 0
                for number, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None))
                    start += length
            columns = list(zip(*rows)) or [[]] * 6
            made = [pa.array(c, t.type) for c, t in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    names = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields, names = [*fields, ("ids", pa.list_(pa.int32()))], f"{names}, ids array<int>"
    schema = pa.schema(fields)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, names)


# --- the linear program ----------------------------------------------------------------------------


def _priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over every capacity, items without limit: the best total price, and the item to take first (or -1)."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        own = best[room - lengths[: fits[room]]] + prices[: fits[room]]
        at = int(own.argmax())
        best[room], item[room] = own[at], at
    return best, item


def _filled(lengths: np.ndarray, item: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The best configuration that holds item ``first``: items and how often."""
    taken, room = {first: 1}, capacity - int(lengths[first])
    while (at := int(item[room])) >= 0:
        taken[at] = taken.get(at, 0) + 1
        room -= int(lengths[at])
    return taken


def fractional(
    counts: Mapping[int, int], capacity: int, rounds: int = 80, rate: float = 0.1, slack: float = 0.001
) -> dict[tuple[tuple[int, int], ...], float]:
    """A solution of the configuration program: configurations (length, how often) and how many of each.

    The program covers each length's count by configurations, multisets of lengths that fit the capacity, and asks for
    the fewest. Multiplicative weights hold a price per length, at first its share of the capacity, which is a feasible dual
    solution. Each round multiplies a price by a power of how far its length is behind the others, prices
    configurations by the knapsack, and takes a part of each that is within ``slack`` of the best. No count is
    exceeded, so a remainder is left for rounding.
    """
    lengths = np.array(sorted(x for x, n in counts.items() if n > 0), np.int64)
    total = np.array([counts[int(x)] for x in lengths], float)
    left, weights = total.copy(), np.zeros(len(lengths))
    chosen: dict[tuple, float] = {}
    for turn in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        sizes = lengths[open_]
        behind = left[open_] / total[open_] - (left[open_] * sizes).sum() / (total[open_] * sizes).sum()
        weights[open_] += rate * behind
        prices = sizes / capacity * np.exp(weights[open_])
        best, item = _priced(sizes, prices, capacity)
        value = prices + best[capacity - sizes]
        for first in np.flatnonzero(value >= (1 - slack) * value.max())[::-1]:
            taken = _filled(sizes, item, int(first), capacity)
            at, many = open_[list(taken)], np.array(list(taken.values()))
            step = min(total[open_[first]] / (rounds - turn), float((left[at] / many).min()))
            if step <= 0:
                continue
            left[at] -= step * many
            key = tuple(sorted(((int(lengths[i]), int(m)) for i, m in zip(at, many)), reverse=True))
            chosen[key] = chosen.get(key, 0.0) + step
    return chosen


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths that fill ``room`` as far as any within the counts can, large ones before small ones."""
    reach, stages = 1, []
    limit = (1 << room + 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        stages.append((length, reach))
        many, step = min(counts[length], room // length), 1
        while many > 0:
            use = min(step, many)
            reach |= reach << use * length & limit
            many, step = many - use, step * 2
        if reach >> room & 1:
            break
    room, taken = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        many = 0
        while not before >> room & 1:
            room, many = room - length, many + 1
        if many:
            taken[length] = many
    return taken


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def _rounded(counts: Mapping[int, int], solution: Mapping[tuple, float], part: float, capacity: int) -> Plan:
    """Whole numbers of configurations: ``part`` of the solution rounded down, then best fit for what is left.

    Best fit puts the largest piece with the set that fills its sequence furthest, and repeats that while the counts allow.
    """
    left, plan = dict(counts), {}

    def use(config: tuple, copies: int) -> None:
        plan[config] = plan.get(config, 0) + copies
        for length, many in config:
            left[length] -= many * copies

    for config, amount in solution.items():
        if copies := min(int(part * amount + 1e-9), *(left[x] // m for x, m in config)):
            use(config, copies)
    while longest := max((x for x, n in left.items() if n), default=0):
        left[longest] -= 1
        taken = _fullest(left, capacity - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        use(tuple(sorted(taken.items(), reverse=True)), min(left[x] // m for x, m in taken.items()))
    return list(plan.items())


def configurations(
    counts: Mapping[int, int],
    capacity: int = CAPACITY,
    rates: Sequence[float] = (0.02, 0.3),
    parts: Sequence[float] = (1.0, 0.5, 0.2, 0.05),
) -> Plan:
    """Configurations and whole numbers of sequences that hold exactly the counted pieces.

    The program is solved at each of the learning ``rates`` and each solution rounded with several ``parts`` of it kept: a
    solution that is out of balance leaves long pieces without short ones to go with, and then less of it is better.
    The rounding with the fewest sequences is taken; it ends early at the lower bound, all tokens over the
    capacity. Pieces as long as the capacity have a sequence each. The work depends on the capacity alone, not on the counts.
    """
    wanted = {int(x): int(n) for x, n in counts.items() if n > 0}
    if any(x < 1 or x > capacity for x in wanted):
        raise ValueError("lengths lie between 1 and the capacity")
    full = wanted.pop(capacity, 0)
    least = -(-sum(x * n for x, n in wanted.items()) // capacity)
    best: tuple[int, Plan] | None = None
    for rate in rates if wanted else ():
        solution = fractional(wanted, capacity, rate=rate)
        for part in parts:
            if best is None or best[0] > least:
                plan = _rounded(wanted, solution, part, capacity)
                size = sum(copies for _, copies in plan)
                best = min(best or (size, plan), (size, plan), key=lambda x: x[0])
    plan = best[1] if best else []
    return sorted([*plan, *([(((capacity, 1),), full)] if full else [])], reverse=True)


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each length go, as arrays; a row holds the places of one length in one configuration.

    ``key`` is the length and the number of the first piece that goes there. Rows are as many as lengths in
    configurations, some tens of thousands for a capacity of 1,024 whatever the data.
    """

    key: np.ndarray
    many: np.ndarray
    offset: np.ndarray
    sequence: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and their number among those of that length."""
        at = np.searchsorted(self.key, _slot_key(length, number), side="right") - 1
        copy, which = np.divmod(_slot_key(length, number) - self.key[at], np.maximum(self.many[at], 1))
        return self.sequence[at] + copy, self.offset[at] + which * length


def _slot_key(length, number):
    return (length << 48) + number


def slots(plan: Plan) -> Slots:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for config, copies in plan:
        offset = 0
        for length, many in config:
            rows.append((_slot_key(length, used.get(length, 0)), many, offset, sequence))
            used[length] = used.get(length, 0) + many * copies
            offset += many * length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*(np.ascontiguousarray(c) for c in table.T))


# --- placing -----------------------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    The histogram has at most ``capacity`` rows and is solved on the driver. Pieces are numbered within their length by
    distributed prefix sums in the stated order, nulls first, so that reruns agree and a length that very many pieces
    share is spread; a piece's number gives its place by one search in the solved table. Rows that agree in all
    of the order are alike and may change places. No pieces give an empty result.
    """
    sorted_by = [F.struct(F.col(c).isNotNull(), c).alias(f"_by_{c}") for c in order]
    keyed = stage(cut.select(*cut.columns, *sorted_by, F.lit(1).cast("bigint").alias("_pack")), "pieces")
    names = cut.columns
    counts = {r["length"]: r["count"] for r in keyed.groupBy("length").count().collect()}
    where = slots(configurations(counts, capacity))
    numbered = running_totals(keyed, ["length", *(f"_by_{c}" for c in order)], ["_pack"], group=["length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch[c], np.int64) for c in ("length", "_pack_before"))
            sequence, offset = where.place(length, number) if len(length) else (length, length)
            kept = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return numbered.select(*names, "_pack_before").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, tokenizer, capacity, **options), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts``: the packed sequences themselves, each of at most ``capacity`` ids."""
    placed = pack(pieces(docs, tokenizer, capacity, with_ids=True, **options), capacity)
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("own"))
    return rows.select(
        "sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.offset").alias("starts")
    )
