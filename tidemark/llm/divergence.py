"""Source divergence audit: a quadtree over the matrix of groups and terms, traversed jointly for pairs of groups.

Rows of a language's matrix are its sources and the language itself, columns its kept terms, cells counts. Both axes are
cut into tiles; a tile is a tree whose nodes have K x K quadrants. Quadrants without a count are not stored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordering import running_totals
from ..session import stage
from .tables import pieces_of, raw_texts, shuffle_tasks

K = 4  # a node has K x K quadrants
ROWS, COLUMNS = 32, K**5  # groups and terms of a tile
SCALE = 1_000_000_000
TOP = 10

_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+")


# --- counts ----------------------------------------------------------------------------------------


def _plain(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, text`` with nulls as empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])


def kept_counts(plain: DataFrame, min_docs: int, most: int = 400_000) -> DataFrame:
    """``lang, source, term, n``: occurrences in every group of the terms in at least ``min_docs`` documents of their language.

    Terms are runs of letters a-z and of anything beyond ASCII, A-Z lower-cased. A task adds up what it reads, ``most`` terms of
    all groups at a time, so a term that a third of all rows hold is few rows. They are shuffled once, by language and term: the counts of
    each source and the documents of all meet there, and what is too rare goes no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, in_docs = defaultdict(Counter), defaultdict(Counter)
        for batch in pieces_of(batches):
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), raw_texts(batch["text"])):
                words = _WORDS.findall(text.lower())
                n[lang, source].update(words)
                in_docs[lang, source].update(set(words))
            if sum(map(len, n.values())) > most:
                yield from added(n, in_docs)
                n, in_docs = defaultdict(Counter), defaultdict(Counter)
        yield from added(n, in_docs)

    def added(n: dict, in_docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            names = [pa.array([name] * len(found), pa.string()) for name in (lang, source)]
            docs = in_docs[lang, source]
            counts = [pa.array(list(found.values()), pa.int64()), pa.array([docs[t] for t in found], pa.int64())]
            term = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*names, term, *counts], ["lang", "source", "term", "n", "docs"])

    counted = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition(shuffle_tasks(plain), "lang", "term")
    summed = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return summed.withColumn("docs", in_lang).filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n")


def _mass(n: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))``, exact."""
    # the products stay below 10**38, and division of decimals by div is that of whole numbers
    return F.expr(f"1 + cast(({n} + 2) as decimal(20,0)) * {SCALE} div cast({total} + 2 * {terms} as decimal(20,0))").cast("bigint")


def group_matrix(docs: DataFrame, min_docs: int = 10, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Groups and cells of the matrices.

    Groups: ``lang, row, source, mass0, terms``; a language's sources are numbered from 1 and row 0 is the language (``source``
    null). ``mass0`` is the mass of a term the group does not have, ``terms`` the number of the language's kept terms, those in
    ``min_docs`` documents of it at least. Cells: ``lang, row, col, term, mass`` of every kept term that occurs in a group.
    """
    plain = _plain(docs, **columns)
    words = stage(kept_counts(plain, min_docs), "counts")
    kept = stage(words.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.lit(1).cast("bigint").alias("_one")), "kept")
    numbered = stage(running_totals(kept, ["lang", "term"], ["_one"], group=["lang"]), "numbered")
    terms = numbered.select("lang", "term", F.col("_one_before").alias("col"))
    sized = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    seen = words.join(terms, ["lang", "term"]).select("lang", "source", "term", "col", "n")
    totals = words.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = plain.select("lang", "source").distinct()
    place = sources.withColumn("_one", F.lit(1).cast("bigint"))
    place = running_totals(place, ["lang", "source"], ["_one"], group=["lang"])
    place = place.select("lang", "source", (F.col("_one_before") + 1).alias("row"))
    groups = place.join(totals, ["lang", "source"], "left").unionByName(
        place.select("lang").distinct().join(sized.select("lang", "total"), "lang", "left").withColumns(
            {"source": F.lit(None).cast("string"), "row": F.lit(0).cast("bigint")}
        )
    )
    groups = groups.join(sized.select("lang", "terms"), "lang", "left").select(
        "lang", "row", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")
    )
    # a language without kept terms has no masses
    groups = stage(groups.withColumn("mass0", F.when(F.col("terms") > 0, _mass("0", "total", "terms")).otherwise(0)), "groups")
    named = groups.filter("row > 0").select("lang", "source", "row", "total", "terms")
    own = seen.join(named, ["lang", "source"])
    all_ = numbered.select("lang", "term", F.col("_one_before").alias("col"), "n").join(
        groups.filter("row = 0").select("lang", "row", "total", "terms"), "lang"
    )
    shape = ["lang", "row", "col", "term", _mass("n", "total", "terms").alias("mass")]
    return groups.select("lang", "row", "source", "mass0", "terms"), own.select(*shape).unionByName(all_.select(*shape))


# --- the tree --------------------------------------------------------------------------------------


class Quadtree:
    """The nonzero quadrants of a tile, level by level: sorted codes ``row band * 2**32 + column band``, finest first."""

    def __init__(self, row: np.ndarray, col: np.ndarray, mass: np.ndarray, height: int):
        order = np.lexsort((col, row))
        self.row, self.col, self.mass = row[order], col[order], mass[order]
        self.levels = [np.unique((self.row // K**h << 32) + self.col // K**h) for h in range(height + 1)]

    def at(self, level: int, band: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Whether quadrants are stored, and at the finest level where."""
        codes, wanted = self.levels[level], (band << 32) + block
        if not len(codes):
            return np.full(len(wanted), -1)
        place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where(codes[place] == wanted, place, -1)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)**2 / (p + q))``; masses are at most SCALE + 1, so their squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


def joint_prices(a: Quadtree, b: Quadtree, zero_a: np.ndarray, zero_b: np.ndarray, width: int, height: int):
    """For every row of ``a`` and of ``b`` the sum of prices over ``width`` columns, and the cells met on the way.

    Both trees are walked together. A pair of quadrants over the same columns that are both empty is priced at once: the
    price of the two rows' empty masses times the columns. All others are replaced by the pairs of their children,
    down to single cells. ``zero_a`` and ``zero_b`` are the masses of a term that a row does not have. Also returns the
    row of ``a``, the row of ``b``, the column, and the price of all pairs of cells where ``a`` has a count.
    """
    empty = price(zero_a[:, None], zero_b[None, :])
    out = np.zeros((len(zero_a), len(zero_b)), np.int64)
    band_a = band_b = block = np.zeros(1, np.int64)
    for level in range(height, -1, -1):
        side = K**level
        in_a, in_b = a.at(level, band_a, block), b.at(level, band_b, block)
        none = (in_a < 0) & (in_b < 0)
        columns = np.clip(width - block * side, 0, side)
        for x, y, n in zip(band_a[none], band_b[none], columns[none]):
            # rows beyond the last group are not there, so the slice leaves them out
            out[x * side : (x + 1) * side, y * side : (y + 1) * side] += n * empty[x * side : (x + 1) * side, y * side : (y + 1) * side]
        band_a, band_b, block, in_a, in_b = (v[~none] for v in (band_a, band_b, block, in_a, in_b))
        if level == 0:
            break
        turn = np.arange(K**3)
        low = K ** (level - 1)
        band_a = (band_a[:, None] * K + turn // K**2).ravel()
        band_b = (band_b[:, None] * K + turn // K % K).ravel()
        block = (block[:, None] * K + turn % K).ravel()
        real = (band_a * low < len(zero_a)) & (band_b * low < len(zero_b)) & (block * low < width)
        band_a, band_b, block = band_a[real], band_b[real], block[real]
    p = np.where(in_a >= 0, a.mass[np.maximum(in_a, 0)] if len(a.mass) else 0, zero_a[band_a])
    q = np.where(in_b >= 0, b.mass[np.maximum(in_b, 0)] if len(b.mass) else 0, zero_b[band_b])
    value = price(p, q)
    np.add.at(out, (band_a, band_b), value)
    met = in_a >= 0
    return out, (band_a[met], band_b[met], block[met], value[met], (p > q)[met])


def _dealt(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of every pair of tiles in every block of columns: first the groups (``col`` null), then the cells."""
    tile, block = F.expr(f"row div {ROWS}"), F.expr(f"col div {COLUMNS}")
    last = groups.groupBy("lang").agg(F.max(tile).alias("last"))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(terms - 1) div {COLUMNS}"))).alias("block")
    heads = groups.filter("terms > 0").select("lang", "row", "mass0", "terms", tile.alias("tile"), blocks)
    heads = heads.select("lang", "tile", "block", "row", F.lit(None).cast("bigint").alias("col"), F.col("mass0").alias("mass"), "terms", F.lit(None).cast("string").alias("term"))
    body = cells.select("lang", tile.alias("tile"), block.alias("block"), "row", "col", "mass", F.lit(None).cast("bigint").alias("terms"), "term")
    both = heads.unionByName(body).join(last, "lang")
    # a tile meets itself and every other one once, as the first of the pair or the second
    return both.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("other")).select(
        "lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block",
        "tile", "row", "col", "mass", "terms", "term",
    )


def divergences(groups: DataFrame, cells: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, a, b, term, value``: partial results of all blocks of columns.

    With a null term, ``value`` is a part of the sum over all kept terms for rows ``a < b`` (add them up); a third of all counts
    in one language or source is spread, as a task takes one block of columns and one pair of row tiles at a time.
    With a term, ``value`` is its price in row ``a`` against the language, for the ``top`` such terms of a row and block
    that weigh more in the row.
    """
    height = next(h for h in range(32) if K**h >= max(ROWS, COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, size = [], defaultdict(int), 0
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("lang", "a", "b", "block"))))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if held and held[0] != keys[at]:
                    yield from _tile(*held, sums)
                    held = []
                held = held or [keys[at], []]
                held[1].append(batch.slice(at, end - at))
                at = end
            if len(sums) > 200_000:
                yield _sums(sums)
                sums = defaultdict(int)
        if held:
            yield from _tile(*held, sums)
        yield _sums(sums)

    def _sums(sums: dict) -> pa.RecordBatch:
        return _rows([(*k, None, v) for k, v in sums.items()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "a", "b", "term", "value"])

    def _tile(key: tuple, parts: list[pa.RecordBatch], sums: dict) -> Iterator[pa.RecordBatch]:
        lang, first, second, block = key
        rows = pa.Table.from_batches(parts)
        head = rows["col"].is_null().to_numpy()
        tile, row, mass = (rows[c].to_numpy() for c in ("tile", "row", "mass"))
        terms = int(rows["terms"].filter(pa.array(head))[0].as_py())
        width = min(COLUMNS, terms - block * COLUMNS)
        col = rows["col"].fill_null(0).to_numpy() - block * COLUMNS
        trees, zeros = [], []
        for t in (first, second):
            heads, own = head & (tile == t), ~head & (tile == t)
            order = np.argsort(row[heads])
            zeros.append(mass[heads][order])
            trees.append(Quadtree(row[own] - t * ROWS, col[own], mass[own], height))
        value, (a, b, at, own, more) = joint_prices(*trees, *zeros, width, height)
        for x, y in zip(*np.nonzero(value)):
            if first < second or x < y:
                sums[lang, int(x) + first * ROWS, int(y) + second * ROWS] += int(value[x, y])
        # the language is row 0: terms of a row against it come from pairs with its tile
        if first == 0:
            names = dict(zip((col[~head]).tolist(), rows["term"].filter(pa.array(~head)).to_pylist()))
            sides = [(a, b, at, own, more, 0)]
            if second:
                turned = joint_prices(*trees[::-1], *zeros[::-1], width, height)[1]
                sides = [(*turned, second)]
            for a, b, at, own, more, t in sides:
                best = defaultdict(list)
                for i in np.flatnonzero((b == 0) & more & (a + t * ROWS > 0)):
                    best[int(a[i])].append((-int(own[i]), names[int(at[i])].encode(), names[int(at[i])]))
                yield _rows([(lang, x + t * ROWS, 0, n, -v) for x, found in best.items() for v, _, n in sorted(found)[:top]])

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    keys = ["lang", "a", "b", "block"]
    dealt = _dealt(groups, cells).repartition(shuffle_tasks(cells), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "lang string, a long, b long, term string, value long")


def source_audit(docs: DataFrame, min_docs: int = 10, top: int = TOP, **columns: str) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far every source of a language is from each other one, and its own terms.

    Part ``pair`` has a row for every other source of the language, part ``term`` the ``top`` kept terms that weigh more in
    the source than in the language; both are ranked by value, then item. Null texts, languages and sources count as empty, a
    group without kept terms has pairs all the same, and a language without kept terms has pairs of value 0. No rows: no rows.
    """
    groups, cells = group_matrix(docs, min_docs, **columns)
    found = stage(divergences(groups, stage(cells, "cells"), top), "divergences")
    named = groups.filter("row > 0").select("lang", "row", "source")
    left = named.withColumnsRenamed({"row": "a"})
    right = named.withColumnsRenamed({"row": "b", "source": "item"})
    sums = found.filter(F.col("term").isNull() & (F.col("a") > 0)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # the contract's result: every pair of sources of a language
    pairs = left.join(right, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = found.filter(F.col("term").isNotNull()).join(left, ["lang", "a"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
