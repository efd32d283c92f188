"""Merkle dataset manifest: a content-addressed DAG in pages, and proofs by descent from the root.

Leaves are rows. Per source they form a tree of runs of three, and the roots of the sources form one more tree. A node is
stored as a record, its digest and the digests of its children. The records of seven levels make a page
(at most 3^7 leaves), so a tree of ``n`` leaves is built, and its proofs are found, in ``log(n) / log(3^7)`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..ordering import running_totals
from ..session import stage
from .tables import shuffle_tasks

FAN = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PATH = pa.list_(_STEP)
_PATH_TYPE = "array<struct<before: string, after: string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields one behind the other, each as its length in bytes, a colon and the value, or ``-`` for null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _digest(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _heights(leaves: Column) -> Column:
    """Levels above ``leaves`` leaves: the smallest number of thirds that leaves one node."""
    # the powers of three that a bigint holds
    return sum(((leaves > F.lit(FAN**level)).cast("int") for level in range(40)), F.lit(0))


def _page(size: int) -> Column:
    """The page of a rank; exact where a division as doubles would not be."""
    return F.expr(f"rank div {size}").alias("page")


def _by_page(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[list[tuple]]:
    """Rows of sorted batches, all those of one page (the first two columns) at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in columns)):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _records(nodes: DataFrame, page_size: int) -> DataFrame:
    """``tree, page, digest, children, top``: the records of every page over the nodes ``tree, rank, digest, rise``.

    ``rise`` is how many levels a page of that tree has. The record marked ``top`` is the page's root; a page without
    levels has that one record only, without children.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _by_page(batches, ["tree", "page", "digest", "rise"]):
            (tree, page, _, rise), level = rows[0], [r[2] for r in rows]
            found = []
            for _ in range(rise):
                runs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
                level = [_digest(r) for r in runs]
                found += [(tree, page, d, r, False) for d, r in zip(level, runs)]
            last = found.pop() if found else (tree, page, level[0], None, False)
            out += [*found, (*last[:4], True)]
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    schema = pa.schema(
        [("tree", pa.int64()), ("page", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("top", pa.bool_())]
    )
    paged = nodes.select("tree", _page(page_size), "rank", "digest", "rise")
    dealt = paged.repartition(shuffle_tasks(nodes), "tree", "page").sortWithinPartitions("tree", "page", "rank")
    made = dealt.select("tree", "page", "digest", F.col("rise").cast("int").alias("rise"))
    return made.mapInArrow(run, "tree long, page long, digest string, children array<string>, top boolean")


@dataclass
class Forest:
    """Trees over ranked leaves. A page spans ``levels`` levels; ``layers[k]`` holds the records of the pages ``k * levels``
    levels above the leaves, ``roots`` a row per tree: ``tree, height, root``."""

    layers: list[DataFrame]
    roots: DataFrame
    levels: int


def build(leaves: DataFrame, sizes: DataFrame, levels: int = LEVELS) -> Forest:
    """Records and roots over ``tree, rank, digest`` (ranks from 0 without gaps) and ``tree, leaves`` (their number).

    Each round reads the tops of the pages below, a 2,187th of the rows or one per tree, and is written, so a lost executor costs a part
    of one round.
    """
    heights = stage(sizes.select("tree", _heights(F.col("leaves")).alias("height")), "heights")
    most = heights.agg(F.max("height")).first()[0]
    layers, nodes, tops = [], leaves, None
    for layer in range(0, 1 + max(0, (most or 0) - 1) // levels):
        rise = F.least(F.col("height") - layer * levels, F.lit(levels))
        open_ = nodes.join(heights, "tree").select("tree", "rank", "digest", rise.alias("rise"))
        records = stage(_records(open_, FAN**levels), f"records{layer}")
        layers.append(records)
        top = records.filter("top").select("tree", F.col("page").alias("rank"), "digest")
        done = top.join(heights.filter(F.col("height") <= (layer + 1) * levels), "tree")
        done = done.select("tree", "height", F.col("digest").alias("root"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = top.join(heights.filter(F.col("height") > (layer + 1) * levels).select("tree"), "tree", "left_semi")
    return Forest(layers, tops, levels)


def _descend(records: DataFrame, requests: DataFrame, starts: DataFrame, payload: str, page_size: int) -> DataFrame:
    """Answers ``tree, rank, digest, path, <payload>`` of the requests ``tree, rank, <payload>`` in one layer of pages.

    ``starts`` holds ``tree, page, rise, above``: the path from each page's root up to the root of all. A request walks from the
    page's root down: the digits of its rank to base three, highest first, choose a child of each record, and the
    children not chosen are collected. Records, starts and requests of a page meet sorted in one stream, so a task holds
    one page's records and no more requests than have arrived.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, store, out = None, {}, []
        top = rise = above = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("tree", "page", "kind", "rank", "digest", "children", "rise", "above")]
            for at, (tree, page, kind, rank, digest, children, levels, path) in enumerate(zip(*columns)):
                if (tree, page) != key:
                    key, store, top, above = (tree, page), {}, None, None
                if kind == 0:
                    rise, above = levels, [(s["before"], s["after"]) for s in path]
                elif kind == 1:
                    store[digest] = children
                    top = digest if rank == 1 else top
                elif above is not None:
                    node, segments = top, []
                    place = rank - page * page_size
                    for level in range(rise - 1, -1, -1):
                        below, digit = store[node], place // FAN**level % FAN
                        segments.append(("".join(below[:digit]), "".join(below[digit + 1 :])))
                        node = below[digit]
                    # found from the root down, wanted from the leaf up
                    out.append((tree, rank, node, [*reversed(segments), *above], batch[payload][at].as_py()))
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
        yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        tree, rank, digest, paths, extra = list(zip(*rows)) or [[]] * 5
        steps = [{"before": b, "after": a} for p in paths for b, a in p]
        ends = [0]
        for p in paths:
            ends.append(ends[-1] + len(p))
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, _STEP))
        columns = [pa.array(tree, pa.int64()), pa.array(rank, pa.int64()), pa.array(digest, pa.string()), path, pa.array(extra, kept)]
        return pa.RecordBatch.from_arrays(columns, ["tree", "rank", "digest", "path", payload])

    field = requests.schema[payload]
    kept = to_arrow_type(field.dataType)
    nothing = {c: F.lit(None) for c in ("rank", "digest", "children", "rise", "above", payload)}
    shape = [c.split(" ", 1) for c in ("tree long", "page long", "kind int", "rank long", "digest string", "rise int")]
    shape += [["children", "array<string>"], ["above", _PATH_TYPE], [payload, field.dataType.simpleString()]]

    def row(df: DataFrame, kind: int, **columns) -> DataFrame:
        given = {"tree": F.col("tree"), "page": F.col("page"), "kind": F.lit(kind)} | nothing | columns
        return df.select(*[given[name].cast(type_).alias(name) for name, type_ in shape])

    both = row(starts, 0, rise=F.col("rise"), above=F.col("above"))
    both = both.unionByName(
        row(records, 1, digest=F.col("digest"), children=F.col("children"), rank=F.col("top").cast("long"))
    ).unionByName(row(requests, 2, page=_page(page_size), rank=F.col("rank"), **{payload: F.col(payload)}))
    dealt = both.repartition(shuffle_tasks(records), "tree", "page").sortWithinPartitions("tree", "page", "kind")
    return dealt.mapInArrow(run, f"tree long, rank long, digest string, path {_PATH_TYPE}, `{payload}` {field.dataType.simpleString()}")


def prove(forest: Forest, requests: DataFrame, above: DataFrame | None = None, payload: str = "payload") -> DataFrame:
    """``tree, rank, digest, path, <payload>`` of the leaves that ``requests`` names by ``tree, rank``.

    ``path`` goes from the leaf to the root: a step holds the digests of the run's other nodes, those before and those after it.
    ``above`` (``tree, path``) goes on from a tree's root. The pages that hold requested leaves are requested of the
    layer above, and so on, so every page is walked once per request of its own.
    """
    roots = forest.roots.select("tree", "height")
    if above is not None:
        roots = roots.join(above.select("tree", F.col("path").alias("above")), "tree")
    else:
        roots = roots.withColumn("above", F.lit([]).cast(_PATH_TYPE))
    roots = stage(roots, "tops")
    levels, page = forest.levels, _page(FAN**forest.levels)
    wanted = [requests.select("tree", "rank", payload)]
    for layer in range(1, len(forest.layers)):
        pages = wanted[-1].select("tree", page).distinct().withColumnRenamed("page", "rank")
        higher = roots.filter(F.col("height") > layer * levels).select("tree")
        wanted.append(stage(pages.join(higher, "tree", "left_semi").withColumn(payload, F.lit(0)), f"wanted{layer}"))
    answers = None
    for layer in range(len(forest.layers) - 1, -1, -1):
        # pages whose root is the tree's root start with what is above it, the others with the answer of the layer above
        own = roots.filter(F.col("height") <= (layer + 1) * levels).filter(F.col("height") > (layer * levels if layer else -1))
        starts = own.select("tree", F.lit(0).cast("bigint").alias("page"), (F.col("height") - layer * levels).alias("rise"), "above")
        if answers is not None:
            starts = starts.unionByName(
                answers.select("tree", F.col("rank").alias("page"), F.lit(levels).alias("rise"), F.col("path").alias("above"))
            )
        answers = _descend(forest.layers[layer], wanted[layer], starts, payload, FAN**levels)
        answers = stage(answers, f"paths{layer}") if layer else answers
    return answers


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


@dataclass
class Manifest:
    """``leaves``: ``tree, rank, doc_id, digest, other`` of every row; ``trees``: ``tree, source, leaves``; the trees of
    the sources and the tree over their roots."""

    leaves: DataFrame
    trees: DataFrame
    sources: Forest
    whole: Forest


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, other: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``: a leaf per row, a tree per source, a tree over the sources.

    A source's leaves ascend by ``fields[0]`` (null first; equal ids by digest, which makes repeated rows alike), sources
    by name in code point order, null first; a null source is a source of its own. Ranks are distributed prefix sums, so
    a source that holds a third of all rows is spread. ``other`` is a second digest of a row that travels with
    it. Other columns are not read; an empty table has no leaves and no roots.
    """
    id_, source = F.col(fields[0]), F.col("source")
    hashed = docs.select(
        id_.alias("doc_id"),
        source.alias("source"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        (other if other is not None else F.lit(None).cast("string")).alias("other"),
    )
    keyed = hashed.select(
        "*",
        F.col("source").isNotNull().alias("_named"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("doc_id").isNotNull().alias("_has"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    keyed = stage(keyed, "leaves")
    ranked = running_totals(keyed, ["_named", "_source", "_has", "_id", "digest"], ["_one"])
    counted = keyed.groupBy("_named", "_source", "source").agg(F.sum("_one").alias("leaves"), F.lit(1).cast("bigint").alias("_tree"))
    trees = stage(running_totals(stage(counted, "sources"), ["_named", "_source"], ["leaves", "_tree"]), "trees")
    first = trees.select("_named", "_source", F.col("_tree_before").alias("tree"), F.col("leaves_before").alias("_first"))
    placed = ranked.join(first, ["_named", "_source"]).select(
        "tree", (F.col("_one_before") - F.col("_first")).alias("rank"), "doc_id", "digest", "other"
    )
    leaves = stage(placed, "placed")
    trees = trees.select(F.col("_tree_before").alias("tree"), "source", "leaves")
    sources = build(leaves.select("tree", "rank", "digest"), trees, levels)
    subroots = sources.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("root").alias("digest"))
    subroots = stage(subroots, "subroots")
    whole = build(subroots, subroots.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves")), levels)
    return Manifest(leaves, trees, sources, whole)


def proofs(made: Manifest) -> DataFrame:
    """``doc_id, leaf, other, subroot, root, path`` of every row; the path leads from the leaf over the source's root to the root."""
    top = made.whole.roots.select(F.col("tree").alias("_zero"), "root")
    subroots = made.sources.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("root").alias("payload"))
    upper = prove(made.whole, subroots).select(F.col("rank").alias("tree"), "path", F.col("payload").alias("subroot"))
    upper = stage(upper.join(top, F.col("_zero") == 0).drop("_zero"), "upper")
    asked = made.leaves.select("tree", "rank", F.struct("doc_id", "other").alias("payload"))
    found = prove(made.sources, asked, upper.select("tree", "path"))
    named = found.join(upper.select("tree", "subroot", "root"), "tree")
    return named.select("payload.doc_id", F.col("digest").alias("leaf"), "payload.other", "subroot", "root", "path")


def audit(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """Proof digests of every row, and whether each row still leads to the root when some texts have lost their line breaks.

    ``tampered`` marks those rows (null: not). Returns ``doc_id, leaf, subroot, root, proof_sha256`` of the rows as given, and
    ``folded_root, verified`` of the rows as tampered with. A row whose text has no line break, or is null, is
    not changed by it.
    """
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields]
    changed = F.coalesce(tampered, F.lit(False)) & F.contains(F.col("text"), F.lit("\n"))
    found = proofs(manifest(docs, fields, F.when(changed, leaf_digest(cut)), levels))
    folded = found.select(
        "doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
