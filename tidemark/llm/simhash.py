"""SimHash near-dedup over a Gray-order hierarchical index of the fingerprints."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import component_roots
from .tables import pieces_of, raw_texts, shuffle_tasks

_SEED = 42
_FAN = 8  # children of an index node
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _remix(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other 64 bits of the same shingles: each hash goes through an invertible mixer, offset by ``turn``."""
    if not turn:
        return hashes
    mixed = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def shingles(text: bytes, words: int, repeats: bool = True) -> np.ndarray:
    """64-bit hashes of a text's shingles in their order, or each once and ascending; none for a text without words."""
    tokens = text.lower().split()  # bytes: white space is space and 9-13, lower-casing is A-Z
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(tokens) - length + 1].tolist(), ends[length - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], _SEED) for a, b in cuts), np.uint64, len(tokens) - length + 1)
    return hashes if repeats else np.unique(hashes)


def simhash(text: bytes, words: int, width: int = 1, repeats: bool = True) -> list[int]:
    """Bit-wise majority of the shingles' hashes, as ``width`` words of 64 bits; a bit is 1 if set in over half of them.

    Without ``repeats`` a shingle counts once, so that prints estimate the likeness of sets.
    """
    return _majority(shingles(text, words, repeats), width)


def _majority(hashes: np.ndarray, width: int) -> list[int]:
    counts = np.zeros((width, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        for turn in range(width):
            octets = _remix(hashes[at : at + (1 << 16)], turn).astype(">u8").view(np.uint8).reshape(-1, 8)
            counts[turn] += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > len(hashes), axis=1)
    return [int.from_bytes(word.tobytes(), "big", signed=True) for word in majority]


def print_columns(width: int) -> list[str]:
    return [f"fp{i}" for i in range(width)]


def bits_apart(similarity: float, bits: int, deviations: float = 1.0) -> int:
    """Differing bits up to which two prints count as similar, for sets of shingles of that Jaccard likeness.

    Sets of likeness ``s`` have a cosine of about ``2s / (1 + s)``, and a bit differs with the probability of their angle
    over pi. One standard deviation is added, so that most of the pairs at the limit itself are within it; with three, about
    one in 400 of them is not.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return floor(bits * share + deviations * sqrt(bits * share * (1 - share)))


def fingerprints(
    docs: DataFrame,
    words: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 1,
    repeats: bool = True,
    digest: bool = False,
) -> DataFrame:
    """``doc_id, fp0, fp1, ...`` (``width`` columns of 64 bits as a signed bigint) of every row.

    With ``digest`` also ``shingles``, 16 bytes that are equal for equal sets of shingles.

    Words are runs without ASCII white space after lower-casing A-Z, shingles keep ``repeats`` or count once. A text with
    fewer words than a shingle is one shingle; one without words, or null, has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            fps, digests = [], []
            for text in raw_texts(batch["text"]):
                hashes = shingles(text, words, repeats)
                fps.append(_majority(hashes, width))
                if digest:
                    digests.append(xxhash.xxh3_128_digest((np.unique(hashes) if repeats else hashes).tobytes()))
            columns = [pa.array([fp[i] for fp in fps], pa.int64()) for i in range(width)]
            columns += [pa.array(digests, pa.binary())] if digest else []
            yield pa.record_batch([batch["doc_id"], *columns], ["doc_id", *names, *extra])

    names, extra = print_columns(width), ["shingles"] if digest else []
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, ", ".join([*(f"{c} long" for c in ["doc_id", *names]), *(f"{c} binary" for c in extra)]))


def masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of which any two values within ``distance`` agree on one at least.

    64 bits are cut into ``blocks`` runs. ``distance`` differing bits touch that many runs at most, so
    some ``blocks - distance`` runs are equal; there is a mask for each choice of them.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(runs, blocks - distance)]


def sampled_masks(width: int, bits: int, rounds: int) -> list[list[int]]:
    """Masks over wide prints: each round shuffles all bit positions by a fixed seed and deals them out, ``bits`` to a mask."""
    masks_, places = [], list(range(64 * width))
    dealer = random.Random(_SEED)
    for _ in range(rounds):
        dealer.shuffle(places)
        for at in range(0, len(places) - bits + 1, bits):
            mask = [0] * width
            for place in places[at : at + bits]:
                mask[place // 64] |= 1 << place % 64
            masks_.append(mask)
    return masks_


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of prints, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of a value in reflected Gray order: the prefix parity of its bits."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a[i]`` and ``b[i]``; every entry then points at its set's smallest member."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return parent
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


def _link_neighbours(cell: np.ndarray, value: np.ndarray, distance: int, parent: np.ndarray) -> np.ndarray:
    """Join close neighbours in eight rotated orders of the larger cells.

    A start for the exact search: a dense group of near copies mostly connects here, in sorting time, and
    its node pairs are then skipped as known.
    """
    large = np.flatnonzero(np.bincount(cell)[cell] > _FAN * _FAN) if len(cell) else np.zeros(0, int)
    width = value.shape[1]
    for turn in range(0, 64 * width, 8 * width) if len(large) else ():
        word, left, right = value[large, turn // 64], np.uint64(turn % 64), np.uint64((64 - turn) % 64)
        rotated = (word << left) | (word >> right)
        order = large[np.lexsort((_gray_rank(rotated), cell[large]))]
        a, b = order[:-1], order[1:]
        near = (cell[a] == cell[b]) & (_apart(value[a], value[b]) <= distance)
        parent = _merge(parent, a[near], b[near])
    return parent


def _index_levels(cell: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Levels of nodes, leaves first: first member, members, shared pattern, mask of shared bits, first child and children."""
    starts, owner, pattern, mask = np.arange(len(value)), cell, value, np.full(value.shape, _FULL)
    levels = [(starts, np.ones(len(value), np.int64), pattern, mask, np.zeros(len(value), np.int64))]
    while True:  # build: each level groups up to _FAN nodes of one cell
        heads = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        if heads.all():
            break
        first = np.flatnonzero(heads)
        index = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        cuts = np.flatnonzero(index % _FAN == 0)
        both = np.bitwise_and.reduceat(mask, cuts)
        every, some = (op.reduceat(pattern, cuts) for op in (np.bitwise_and, np.bitwise_or))
        mask = both & ~(every ^ some)
        pattern, owner, starts = every & mask, owner[cuts], starts[cuts]
        below = np.diff(np.append(cuts, len(index)))
        levels.append((starts, np.diff(np.append(starts, len(value))), pattern, mask, np.stack([cuts, below], 1)))
    return levels


def _below(children: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of node pairs, each once."""
    n_a, n_b = children[a, 1], children[b, 1]
    many = n_a * n_b
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = np.repeat(n_b, many)
    below_a, below_b = np.repeat(children[a, 0], many) + place // wide, np.repeat(children[b, 0], many) + place % wide
    once = below_a <= below_b
    return below_a[once], below_b[once]


def link_cells(cell: np.ndarray, value: np.ndarray, distance: int, slab: int = 1 << 18) -> np.ndarray:
    """For each value the position of its group's first member; ``cell`` marks values to compare.

    ``value`` has a row per print and a column per 64 bits of it. Values come sorted by cell and Gray rank. Upper nodes hold up to ``_FAN`` neighbours of one cell with
    the mask of bits they share and the shared pattern, so a node pair's differences on bits shared
    by both are a lower bound for all pairs below it. From the pairs (cell, cell) down, a pair of nodes is
    dropped when that bound exceeds ``distance``, taken whole when even the bits not shared cannot exceed it,
    dropped when all its members are one group already, and else replaced by its children's
    pairs. Pairs wait in slabs, deepest first, so memory stays bounded.
    """
    parent = np.arange(len(value))
    levels = _index_levels(cell, value)
    parent = _link_neighbours(cell, value, distance, parent)
    top = len(levels) - 1
    whole = np.flatnonzero(levels[top][1] > 1)
    waiting = [(top, whole[i : i + slab], whole[i : i + slab]) for i in range(0, len(whole), slab)]
    while waiting:
        level, a, b = waiting.pop()
        start, size, pattern, mask, children = levels[level]
        shared = mask[a] & mask[b]
        apart = _apart(pattern[a] & shared, pattern[b] & shared)
        most = apart + _apart(shared, _FULL)
        close = (apart <= distance) & ((a != b) | (size[a] > 1))
        taken = close & (most <= distance)
        if taken.any():
            parent = _merge(parent, start[a[taken]], start[b[taken]])
            inside = np.unique(np.concatenate([a[taken], b[taken]]))
            inside = inside[size[inside] > 1]
            if len(inside):
                members = np.concatenate([np.arange(s, s + n) for s, n in zip(start[inside], size[inside])])
                parent = _merge(parent, np.repeat(start[inside], size[inside]), members)
        a, b = a[close & ~taken], b[close & ~taken]
        if level == 0 or not len(a):
            continue
        # members in one group already need no comparison
        low = np.minimum.reduceat(parent, start)
        high = np.maximum.reduceat(parent, start)
        known = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~known], b[~known]
        if not len(a):
            continue
        below_a, below_b = _below(children, a, b)
        waiting += [(level - 1, below_a[i : i + slab], below_b[i : i + slab]) for i in range(0, len(below_a), slab)]
    return parent


def _numbers(cells: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum((cells[1:] != cells[:-1]).any(axis=1)))) if len(cells) else np.zeros(0, int)


def _links_of(distance: int, names: list[str]):
    """Links inside the sorted cells of a task."""

    def linked(cells: np.ndarray, ids: np.ndarray, known: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = link_cells(_numbers(cells), values, distance)
        # a link joins a member to the first of its group: one row per member, not per pair
        far = np.flatnonzero(group != np.arange(len(group)))
        yield pa.record_batch([pa.array(ids[far]), pa.array(ids[group[far]])], ["a", "b"])

    return _by_cells(names, linked)


def _following(distance: int, names: list[str]):
    """Pairs of neighbours in the order of a cell that are within ``distance`` and in different groups, the smaller id first."""

    def linked(cells: np.ndarray, ids: np.ndarray, known: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = (cells[1:] == cells[:-1]).all(axis=1) & (known[1:] != known[:-1])
        near = np.flatnonzero(same & (_apart(values[1:], values[:-1]) <= distance))
        ends = np.sort(np.stack([ids[near], ids[near + 1]], axis=1), axis=1)
        yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return _by_cells(names, linked)


def _by_cells(names: list[str], linked):
    """Calls ``linked`` with the sorted cells of a task; a cell is never cut between two calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            prints = np.stack([np.asarray(batch[c]) for c in names], axis=1).view(np.uint64)
            fresh = [*(np.asarray(batch[c]) for c in ("mask", "key", "id", "known")), prints]
            rows = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            cells = np.stack(rows[:2], axis=1).astype(np.int64)
            if not len(cells):
                continue
            other = np.flatnonzero((cells != cells[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            # grow to a fair size before the vectorised search; the open cell stays for the next batch
            if cut >= 1 << 16:
                yield from linked(cells[:cut], *(x[:cut] for x in rows[2:]))
                rows = [x[cut:] for x in rows]
            held = rows
        if held is not None:
            yield from linked(np.stack(held[:2], axis=1).astype(np.int64), *held[2:])

    return run


def _rotated(fp, turn: int):
    """The 64 bits of a column moved up by ``turn`` in a circle."""
    turn %= 64
    return F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp


def gray_rank_column(fp):
    """Gray rank as a column expression; sorts as signed, which only rotates the order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def fingerprint_links(classes: DataFrame, distance: int = 4, blocks: int = 6, bits: int = 18, rounds: int = 5) -> DataFrame:
    """``a, b``: ids of distinct fingerprints, links within ``distance`` bits that connect what they should.

    ``classes`` holds ``id, fp0, ...`` with each fingerprint once. The index's upper nodes are masked patterns, dealt
    out by Spark; within a cell rows arrive sorted by Gray rank and :func:`link_cells` builds the lower nodes. A
    cell of many near copies costs nearly one visit per node, because groups already connected are not compared again.

    Prints of 64 bits use :func:`masks` and lose no link: with 6 blocks and 4 bits there are 15 masks of about 21
    bits, so a fingerprint is sent 15 times and a pattern's cell holds one in two million fingerprints. More blocks
    give longer patterns and more masks (8 blocks: 70 of 32 bits). Wider prints, made for larger distances where no
    such family is small, use :func:`sampled_masks`: two prints that differ in a share ``x`` of their bits meet unless
    all masks separate them, which happens with probability ``(1 - (1 - x) ** bits) ** masks``. ``bits`` sets the size of a cell (one in two to the
    ``bits`` of unlike prints): raise it with the logarithm of the documents, and ``rounds`` with it.
    """
    names = [c for c in classes.columns if c != "id"]
    chosen = sampled_masks(len(names), bits, rounds) if len(names) > 1 else [[m] for m in masks(blocks, distance)]
    return _cells(classes.withColumn("known", F.lit(0).cast("bigint")), chosen).mapInArrow(_links_of(distance, names), "a long, b long").distinct()


def _cells(classes: DataFrame, chosen: list[list[int]], turn: int | None = None) -> DataFrame:
    """``mask, key, fp0, ..., id, known``: every class under each mask, dealt out by pattern and sorted in each cell.

    Cells are sorted by group and Gray rank; with ``turn`` by the Gray rank alone, of the print's bits from another place on.
    """
    names = [c for c in classes.columns if c not in ("id", "known")]
    # a constant table of one row per mask
    table = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), *[F.lit(w - (1 << 64) if w >> 63 else w).alias(f"m{j}") for j, w in enumerate(m)])
            for i, m in enumerate(chosen)
        ]
    )
    entries = classes.select("id", "known", *names, F.inline(table))
    patterns = [F.col(c).bitwiseAND(F.col(f"m{j}")) for j, c in enumerate(names)]
    # unequal patterns with equal hashes may share a cell, where the distance is compared all the same
    key = F.xxhash64(*patterns) if len(names) > 1 else patterns[0]
    dealt = entries.select("mask", key.alias("key"), *names, "id", "known").repartition(shuffle_tasks(classes), "mask", "key")
    # the rank is made from the print after the shuffle
    word = _rotated(F.col(names[(turn or 0) % len(names)]), 8 * (turn or 0))
    ranked = dealt.withColumn("rank", gray_rank_column(word))
    order = ["mask", "key", "known", "rank"] if turn is None else ["mask", "key", "rank", "id"]
    return ranked.sortWithinPartitions(*order).select("mask", "key", *names, "id", "known")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``id, own``: the sorted 64-bit hashes of a text's shingles, each once, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            found = [shingles(t, words, repeats=False).tobytes() for t in raw_texts(batch["text"])]
            yield pa.record_batch([batch["id"], pa.array(found, pa.binary())], ["id", "own"])

    return texts.select("id", "text").mapInArrow(run, "id long, own binary")


def alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets (``id, own``) have a Jaccard likeness of ``likeness`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            kept = []
            for x, y in zip(raw_texts(batch["x"]), raw_texts(batch["y"])):
                small, large = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                if len(small) < likeness * len(large) - 1e-9:
                    kept.append(False)
                    continue
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                kept.append(shared + 1e-9 >= likeness * (len(small) + len(large) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(kept)), batch["b"].filter(pa.array(kept))], ["a", "b"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _set_rows(sets: DataFrame) -> DataFrame:
    """``part, id, shingle``: a row per hash of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 4_000_000):
            own = [np.frombuffer(x, np.int64) for x in raw_texts(batch["own"])]
            many = [len(x) for x in own]
            columns = [pa.array(np.repeat(np.asarray(batch[c]), many)) for c in ("part", "id")]
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(flat)], ["part", "id", "shingle"])

    return sets.select("part", "id", "own").mapInArrow(run, "part long, id long, shingle long")


def rare_shingles(sets: DataFrame, likeness: float) -> DataFrame:
    """``part, shingle, id, size, at, short``: the places of each set where another one that can be alike must meet it.

    ``sets`` holds ``part, id, own``. With every set's shingles in one order, the rarest of the part first, two alike sets
    share one among the first few of each: of the longer one ``n - likeness * n``, of the shorter one ``n - 2 * likeness / (1 + likeness) * n``
    (``short`` tells whether a place is among these), one more each. Shingles that one set alone has are counted in the places and left
    out. The order takes two shuffles of the shingles.
    """
    share = likeness / (1 + likeness)
    among = Window.partitionBy("part", "shingle")
    counted = _set_rows(sets).withColumn("n", F.count(F.lit(1)).over(among))
    own = Window.partitionBy("id")
    placed = counted.select(
        "*", F.row_number().over(own.orderBy("n", "shingle")).alias("at"), F.count(F.lit(1)).over(own).alias("size")
    ).filter(F.col("n") > 1)
    first = placed.filter(F.col("at") <= F.col("size") - F.ceil(likeness * F.col("size") - 1e-9) + 1)
    short = F.col("at") <= F.col("size") - F.ceil(2 * share * F.col("size") - 1e-9) + 1
    return first.select("part", "shingle", "id", "size", "at", short.alias("short"))


def rare_shingle_neighbours(rare: DataFrame, likeness: float, tasks: int, turn: int = 0) -> DataFrame:
    """``a, b``: sets of different ``known`` groups that follow each other in the random order of a shared rare shingle.

    ``rare`` has the columns of :func:`rare_shingles` and ``known``. There are no more pairs than rows, and a shingle that very many sets
    share is cut at the borders of ranges: a start that joins dense groups, so that
    fewer are left to tell apart.
    """
    share = likeness / (1 + likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in pieces_of(batches, 4_000_000):
            rows = np.stack([np.asarray(batch[c]) for c in ("part", "shingle", "known", "id", "size", "at")], axis=1).astype(np.int64)
            rows = rows if last is None else np.concatenate([last, rows])
            if not len(rows):
                continue
            last = rows[-1:]
            x, y = rows[:-1], rows[1:]
            least, most = np.minimum(x[:, 4], y[:, 4]), np.maximum(x[:, 4], y[:, 4])
            shared = 1 + np.minimum(x[:, 4] - x[:, 5], y[:, 4] - y[:, 5])
            met = (x[:, :2] == y[:, :2]).all(axis=1) & (x[:, 2] != y[:, 2])
            met &= (least >= likeness * most - 1e-9) & (shared >= share * (least + most) - 1e-9)
            ends = np.sort(np.stack([x[met, 3], y[met, 3]], axis=1), axis=1)
            yield pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    order = ["part", "shingle", "_order"]
    mixed = rare.select("part", "shingle", F.xxhash64("id", "shingle", F.lit(turn)).alias("_order"), "known", "id", "size", F.col("at").cast("bigint"))
    return mixed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def rare_shingle_pairs(sets: DataFrame, likeness: float) -> DataFrame:
    """:func:`pairs_that_meet` of sets given as ``part, id, known, own``."""
    return pairs_that_meet(rare_shingles(sets, likeness).join(sets.select("id", "known"), "id"), likeness)


def pairs_that_meet(rare: DataFrame, likeness: float) -> DataFrame:
    """``a, b``: pairs of sets of one ``part`` and different ``known`` groups that can be alike; no alike pair is missing.

    ``rare`` has the columns of :func:`rare_shingles` and ``known``. Near copies that differ in too many places, each in its own, never
    meet, however many they are. A pair must also be long enough from where it meets on.
    """
    share = likeness / (1 + likeness)
    x, y = rare.alias("x"), rare.filter("short").alias("y")
    ahead = F.struct("y.size", "y.id") < F.struct("x.size", "x.id")
    most = 1 + F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    met = (
        (F.col("x.part") == F.col("y.part"))
        & (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.known") != F.col("y.known"))
        & ahead
        & (F.col("y.size") >= likeness * F.col("x.size") - 1e-9)
        & (most >= share * (F.col("x.size") + F.col("y.size")) - 1e-9)
    )
    return x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def differences(sets: DataFrame, likeness: float) -> DataFrame:
    """``part, id, known, rep, core, over, need, removed, added``: each set against its part's representative.

    ``sets`` holds ``part, id, known, own, rep, rep_own``. ``removed`` and ``added`` are the shingles that only the representative or only the set has. Two sets
    with ``removed`` and ``added`` in common ``c`` times share ``m - removed - removed' + c`` shingles, ``m`` the representative's number. So
    they are alike exactly if ``c >= cost + cost' - b``, where ``cost`` weighs a removed shingle by ``1 - share`` and an added one by
    ``share = likeness / (1 + likeness)``, and ``b = m * (1 - 2 * share)``. Sets of a cost up to ``b`` are alike to the representative (``core``);
    ``over`` is what the cost has above ``b``. Any two that
    have no difference in common and are alike are both of the core; a set outside must have ``need`` differences in common with its
    partner, since those weigh ``share`` each in the partner's cost too.
    """
    share = likeness / (1 + likeness)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 4_000_000):
            core, over, need, removed, added = [], [], [], [], []
            for own, rep in zip(raw_texts(batch["own"]), raw_texts(batch["rep_own"])):
                x, r = np.frombuffer(own, np.int64), np.frombuffer(rep, np.int64)
                removed.append(np.setdiff1d(r, x, assume_unique=True))
                added.append(np.setdiff1d(x, r, assume_unique=True))
                over.append((1 - share) * len(removed[-1]) + share * len(added[-1]) - len(r) * (1 - 2 * share))
                core.append(over[-1] <= 1e-9)
                need.append(max(1, ceil(over[-1] / (1 - share) - 1e-6)))
            longs = pa.list_(pa.int64())
            columns = [pa.array(core, pa.bool_()), pa.array(over, pa.float64()), pa.array(need, pa.int64()), pa.array(removed, longs), pa.array(added, longs)]
            kept = ["part", "id", "known", "rep"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], [*kept, "core", "over", "need", "removed", "added"])

    schema = "part long, id long, known long, rep long, core boolean, over double, need long, removed array<long>, added array<long>"
    return sets.select("part", "id", "known", "rep", "own", "rep_own").mapInArrow(run, schema)


def pairs_with_differences(against: DataFrame, likeness: float) -> DataFrame:
    """``a, b``: sets outside the representative's group with members of it that can be alike; no alike pair is missing.

    ``against`` is what :func:`differences` gives; ``rep`` also names the representative's group. A set outside meets members by the
    differences that fewest of them have: if ``need`` of ``n`` must be in common, one is among the first ``n - need + 1``. No
    member has more differences in common than differences of each kind, so sets that need more than any member has meet none, and
    a pair must be able to have as many as its two costs ask for.
    """
    share = likeness / (1 + likeness)
    each = F.explode(F.concat(*[F.transform(c, lambda v: F.struct(v.alias("shingle"), F.lit(c).alias("kind"))) for c in ("removed", "added")]))
    inside = F.col("core") | (F.col("known") == F.col("rep"))
    sized = against.select("*", inside.alias("inside"), F.size("removed").alias("less"), F.size("added").alias("more"))
    keys, sizes = ["part", "shingle", "kind"], ["less", "more"]
    members = sized.filter("inside").select("part", F.col("id").alias("member"), *sizes, each.alias("d")).select("part", "member", *sizes, "d.*")
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    widest = sized.filter("inside").groupBy("part").agg(F.max(F.col("less") + F.col("more")).alias("widest"))
    near = sized.filter("not inside").join(widest, "part").filter("need <= widest")
    outside = near.select("part", "id", "over", "need", *sizes, each.alias("d")).select("part", "id", "over", "need", *sizes, "d.*")
    at = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "shingle", "kind"))
    placed = outside.join(counts, keys, "left").withColumn("at", at)
    first = placed.filter((F.col("at") <= F.col("less") + F.col("more") - F.col("need") + 1) & F.col("n").isNotNull())
    x, y = first.alias("x"), members.alias("y")
    left = F.col("x.less") + F.col("x.more") - F.col("x.at") + 1
    most = F.least(left, F.least("x.less", "y.less") + F.least("x.more", "y.more"))
    asked = F.col("x.over") + (1 - share) * F.col("y.less") + share * F.col("y.more")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys] + [most + 1e-6 >= asked])
    return met.select(F.least("x.id", "y.member").alias("a"), F.greatest("x.id", "y.member").alias("b")).distinct()


def confirmed_links(
    classes: DataFrame,
    texts: DataFrame,
    words: int,
    distance: int,
    likeness: float,
    bits: int = 16,
    rounds: int = 10,
    shares: int = 2,
    turns: int = 1,
    walks: int = 1,
) -> DataFrame:
    """``a, b``: links between classes whose sets of shingles have a Jaccard likeness of ``likeness`` or more.

    The prints only propose: the index connects what lies within ``distance`` bits and agrees on one of the sampled masks. A class
    that is alone then is done, and the sets of the others are made once. In each of the ``turns``, over one of the ``shares`` of the
    masks and in another order of the bits, neighbours of different groups are compared by their sets: a number of pairs
    that grows with the classes, not with the square of a group, and that joins a large group step by step. Parts that the
    prints connect and that are not one group by then are searched by rare shingles: ``walks`` times neighbours that share one are compared, as
    many as there are rare shingles at most. What is still apart then is searched exactly: from the largest group of a part to the others by
    :func:`pairs_with_differences`, which does not pair a straggler with every member, and among the others by :func:`pairs_that_meet`. No
    refused pair is compared again.
    """
    spark = classes.sparkSession
    names = [c for c in classes.columns if c != "id"]
    chosen = sampled_masks(len(names), bits, rounds)
    loose = component_roots(fingerprint_links(classes, distance, bits=bits, rounds=rounds), "a", "b")
    both = loose.select("node", "root").unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    crowd = stage(classes.join(both.select(F.col("node").alias("id"), F.col("root").alias("part")), "id"), "crowd")
    sets = stage(shingle_sets(texts.join(crowd.select("id"), "id", "left_semi"), words), "sets")
    # none yet; a list given to Spark would start Python workers of another kind beside those of the stages
    tried = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))

    def grouped() -> DataFrame:
        return crowd.join(roots, F.col("id") == F.col("node"), "left").withColumn("known", F.coalesce("root", "id"))

    def unsettled() -> DataFrame:
        """Classes of the parts that hold more than one group: their smallest and largest group tell."""
        known = grouped().select("id", "part", "known")
        parts = known.groupBy("part").agg(F.min("known").alias("least"), F.max("known").alias("most")).filter("least <> most")
        return stage(known.join(parts.select("part"), "part", "left_semi"), "rest")

    def with_links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that were compared, and the links of all groups: each group is a star, so that only new links make paths longer."""
        pairs = stage(found.join(tried, ["a", "b"], "left_anti"), "pairs")
        confirmed = stage(alike(pairs, sets, likeness), "confirmed")
        return pairs, confirmed.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))

    for turn in range(turns):
        entries = _cells(grouped().select("id", *names, "known"), chosen[turn::shares], turn)
        pairs, links = with_links(entries.mapInArrow(_following(distance, names), "a long, b long").distinct())
        tried, roots = tried.unionByName(pairs), component_roots(links, "a", "b")
    rest = unsettled()
    rare = stage(rare_shingles(sets.join(rest.select("id", "part"), "id"), likeness), "rare")
    for walk in range(walks):
        among = rare.join(rest.select("id", "known"), "id")
        pairs, links = with_links(rare_shingle_neighbours(among, likeness, shuffle_tasks(classes), walk))
        tried, roots = tried.unionByName(pairs), component_roots(links, "a", "b")
        rest = unsettled()
    # the largest group of a part is named by its smallest member, which stands for the part
    largest = rest.groupBy("part", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("part")
    reps = largest.agg(F.max(F.struct("n", F.negative("known").alias("low"))).alias("top")).select("part", F.negative("top.low").alias("rep"))
    reps = reps.join(sets.select(F.col("id").alias("rep"), F.col("own").alias("rep_own")), "rep")
    against = stage(differences(rest.join(sets, "id").join(reps, "part"), likeness), "against")
    outside = against.filter((F.col("known") != F.col("rep")) & ~F.col("core")).select("id", "known")
    found = pairs_with_differences(against, likeness).unionByName(pairs_that_meet(rare.join(outside, "id"), likeness)).distinct()
    star = against.filter("core and known <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return with_links(found)[1].unionByName(star)


def near_groups(
    docs: DataFrame,
    words: int = 4,
    distance: int = 4,
    blocks: int = 6,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 1,
    repeats: bool = True,
    likeness: float | None = None,
    bits: int | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; the component is named by its smallest id.

    With ``likeness`` (for prints of several words) a link also takes sets of shingles of that Jaccard likeness, and rows of
    one class have equal sets: see :func:`confirmed_links`. ``bits`` and ``rounds`` set the sampled masks.
    Fingerprints of ``width`` times 64 bits link at ``distance`` or fewer differing bits, links chain. Texts of equal
    fingerprint are one class before any comparison, so a large group of copies is one entry of the index. Null and
    empty texts have fingerprint zero and link like others. A row with a null id gets its group's smallest id
    (null if there is none). Repeated rows are kept; an empty table gives an empty result.
    """
    names = print_columns(width)
    sampled = {k: v for k, v in (("bits", bits), ("rounds", rounds)) if v is not None}
    exact = likeness is not None
    keys = [*names, "shingles"] if exact else names
    printed = stage(fingerprints(docs, words, id_column, text_column, width, repeats, digest=exact), "fingerprints")
    classes = printed.groupBy(*keys).agg(F.min("doc_id").alias("id")).filter(F.col("id").isNotNull())
    if exact:
        texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
        links = confirmed_links(classes.select("id", *names), texts, words, distance, likeness, **sampled)
    else:
        links = fingerprint_links(classes, distance, blocks, **sampled)
    roots = component_roots(links, "a", "b")
    # written, so that the join below reads plain rows and adaptive execution may split the key of many copies
    named = stage(
        classes.join(roots, F.col("id") == F.col("node"), "left").select(
            *keys, F.coalesce("root", "id").alias("component_id")
        ),
        "named",
    )
    hexes = [F.lower(F.lpad(F.hex(c), 16, "0")) for c in names]
    return printed.join(named, keys, "left").select("doc_id", F.concat(*hexes).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents whose id names their group, with the columns they came with; null ids stay."""
    groups = near_groups(docs, id_column=id_column, **options)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
