"""SentencePiece BPE encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .tables import pieces_of

_SPACE = "▁"
_MEMO = 200_000  # chunks, and atoms, whose ids a worker remembers
_PAIRS = 1 << 21  # places for verdicts on pairs of pieces
_INDEX = 8_000  # atoms indexed together
_STEP = 500_000  # bytes of rows encoded together
_WORD = 8  # bytes in one sort key


class PieceTable:
    """What encoding needs of a BPE model with byte fallback, made once on the driver.

    Merging joins the adjacent pair whose piece has the best score, the leftmost among equals, until none
    is left. A text's pieces are therefore the one sequence in which every neighbouring pair, encoded alone,
    stays as it is. So a piece may follow another exactly if no merge crosses their border, and that is
    a property of the two pieces alone.
    """

    def __init__(self, model: bytes) -> None:
        self.model = model
        sp = self.processor
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.bytes_at = np.full(256, -1, np.int32)
        plain = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                plain.append(i)
        if (self.bytes_at < 0).any():
            raise ValueError("the model has no byte fallback")
        ordered = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        #: place of a piece in the order of merging
        self.turn = {self.pieces[i]: n for n, i in enumerate(ordered)}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.halves = {p: h for p in self.ids if (h := self._last_merge(p)) is not None}
        #: no piece has a space mark behind another character, so chunks that begin with one are independent
        self.by_chunk = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        #: scores fall from part to whole, so the time of a merge is its score
        self.falling = all(
            self.score[p] <= min(self.score.get(a, 0.0) if len(a) > 1 else 0.0, self.score.get(b, 0.0) if len(b) > 1 else 0.0)
            for p, (a, b) in self.halves.items()
            if b
        )

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("processor", "search_keys", "neighbours", "gather")}

    @cached_property
    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def merge(self, text: str) -> list[str]:
        """The definition, for short strings: merge the best pair until none is left."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not scored:
                break
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts a piece is made of at last; ``(piece, "")`` for a character, None if it is never made."""
        if len(piece) == 1:
            return piece, ""
        parts = list(piece)
        while len(parts) > 2:
            scored = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not scored:
                return None
            i = min(scored)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two pieces that stand side by side.

        The symbol at the border is a part of ``left`` until that part is merged into a larger one, likewise
        on the other side; a crossing merge happens if its score beats the end of both.
        """
        if not self.falling:
            return self.merge(left + right) == [left, right]
        score, a, a_end = self.score, left, float("-inf")
        while True:
            b, b_end = right, float("-inf")
            while True:
                crossing = score.get(a + b)
                # of equal scores the leftmost merges first
                if crossing is not None and crossing > a_end and crossing >= b_end:
                    return False
                if len(b) == 1:
                    break
                b_end, b = score[b], self.halves[b][0]
            if len(a) == 1:
                return True
            a_end, a = score[a], self.halves[a][1]

    @cached_property
    def search_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte lengths of all pieces that can be made, and their first and last sort keys, word by word."""
        texts = [(p.encode(), self.ids[p]) for p in self.halves]
        longest = -(-max(len(t) for t, _ in texts) // _WORD) * _WORD
        low = np.frombuffer(b"".join(t.ljust(longest, b"\x00") for t, _ in texts), ">u8").reshape(len(texts), -1)
        high = np.frombuffer(b"".join(t.ljust(longest, b"\xff") for t, _ in texts), ">u8").reshape(len(texts), -1)
        ids, lengths = np.array([i for _, i in texts], np.int32), np.array([len(t) for t, _ in texts], np.int64)
        return ids, lengths, low.astype(np.uint64), high.astype(np.uint64)

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A kind for every code point, and which kinds some piece holds side by side."""
        texts = [p for p in self.halves if len(p) > 1]
        kinds = np.zeros(0x110000, np.uint16)
        used = sorted({ord(c) for p in texts for c in p})
        kinds[used] = np.arange(1, len(used) + 1)
        adjacent = np.zeros((len(used) + 1, len(used) + 1), bool)
        for pair in {p[i : i + 2] for p in texts for i in range(len(p) - 1)}:
            adjacent[kinds[ord(pair[0])], kinds[ord(pair[1])]] = True
        return kinds, adjacent

    @cached_property
    def gather(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that pieces stand for in a text in one string, with begin and size for each id.

        Control pieces stand for none.
        """
        sp = self.processor
        out = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            else:
                out.append((" ⁇ " if sp.is_unknown(i) else piece.replace(_SPACE, " ")).encode())
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum(sizes) - sizes, sizes


def suffix_order(keys: np.ndarray, words: int) -> np.ndarray:
    """Positions sorted by the ``words * 8`` bytes that follow, by doubling the sorted length."""
    order = np.argsort(keys, kind="stable")
    width = 1
    while width < words:
        fresh = np.concatenate(([0], np.cumsum(keys[order][1:] != keys[order][:-1])))
        rank = np.zeros(len(keys), np.uint64)
        rank[order] = fresh + 1
        ahead = np.zeros(len(keys), np.uint64)
        step = width * _WORD
        ahead[: max(0, len(keys) - step)] = rank[step:]
        keys = (rank << np.uint64(32)) | ahead
        order = np.argsort(keys, kind="stable")
        width *= 2
    return order


class Encoder:
    """Encodes batches of texts; a worker keeps the ids of chunks and atoms it has seen."""

    def __init__(self, table: PieceTable) -> None:
        self.table = table
        self.chunks: dict[str, bytes] = {}
        self.atoms: dict[str, bytes] = {}
        # verdicts at a place given by the pair; a later pair may overwrite an earlier one
        self.pair_at, self.pair_fits = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)
        self.chunk = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+") if table.by_chunk else re.compile("(?s).+")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.chunk.findall(t) for t in self.table.processor.normalize(texts)]
        for memory in (self.chunks, self.atoms):
            if len(memory) > _MEMO:
                memory.clear()
        fresh = set().union(*cut).difference(self.chunks)
        self._learn_chunks(sorted(fresh))
        return [np.frombuffer(b"".join(map(self.chunks.__getitem__, chunks)), np.int32) for chunks in cut]

    def _learn_chunks(self, chunks: list[str]) -> None:
        """Cut chunks into atoms between characters that no piece holds side by side, and look those up."""
        if not chunks:
            return
        whole = "".join(chunks)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds, adjacent = self.table.neighbours
        kind = kinds[points]
        cut = np.concatenate([~adjacent[kind[:-1], kind[1:]], [True]])
        bounds = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        cut[bounds - 1] = True
        stops = np.flatnonzero(cut) + 1
        at, atoms = 0, []
        for stop in stops.tolist():
            atoms.append(whole[at:stop])
            at = stop
        fresh = sorted(set(atoms).difference(self.atoms))
        for low in range(0, len(fresh), _INDEX):
            self._learn(fresh[low : low + _INDEX])
        known, low = self.atoms, 0
        for chunk, high in zip(chunks, np.searchsorted(stops, bounds, "right").tolist()):
            if high - low == 1:
                self.chunks[chunk] = known[chunk]
            else:
                self.chunks[chunk] = b"".join([known[a] for a in atoms[low:high]])
            low = high

    def _learn(self, atoms: list[str]) -> None:
        """Index the concatenated atoms, match every piece, relax the matches in order of position."""
        text = np.frombuffer("\n".join(atoms).encode() + b"\n", np.uint8).copy()
        sizes = np.fromiter((len(a.encode()) for a in atoms), np.int64, len(atoms))
        stops = np.cumsum(sizes + 1) - 1
        firsts = stops - sizes
        text[stops] = 0xFF  # in no UTF-8 text, so no match crosses it
        starts, ends, tokens = self._edges(text)
        first_at = np.repeat(firsts.astype(np.int32), sizes + 1)
        depth = ends - first_at[starts]
        # by the place of their end in the atom; narrow numbers are sorted by radix
        narrow = depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth
        order = np.argsort(narrow, kind="stable")
        starts, ends, tokens, depth = starts[order], ends[order], tokens[order], depth[order]
        begins = first_at[starts] == starts
        last = np.full(len(text) + 1, -1, np.int32)  # the edge that ends an atom's prefix here
        cuts = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))) if len(depth) else np.zeros(0, int)
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)]):
            before = last[starts[low:high]]
            held = begins[low:high].copy()
            later = np.flatnonzero(~held & (before >= 0))
            held[later] = self._fits(tokens[before[later]], tokens[low:high][later])
            hit = np.flatnonzero(held) + low
            last[ends[hit]] = hit
        # back from the ends, all atoms a step at a time
        at, alive, path = stops.copy(), np.arange(len(stops)), []
        while len(alive):
            edge = last[at[alive]]
            if (edge < 0).any():
                raise AssertionError("a position that no piece reaches")
            path.append((alive, edge))
            at[alive] = starts[edge]
            alive = alive[at[alive] > firsts[alive]]
        atom = np.concatenate([a for a, _ in reversed(path)]) if path else np.zeros(0, int)
        edge = np.concatenate([e for _, e in reversed(path)]) if path else np.zeros(0, int)
        forward = np.argsort(atom, kind="stable")
        atom, edge = atom[forward], edge[forward]
        token = tokens[edge]
        many = np.where(token >= 0, 1, ends[edge] - starts[edge])
        flat = np.repeat(token, many)
        place = np.repeat(starts[edge], many) + np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
        flat = np.where(flat >= 0, flat, self.table.bytes_at[text[place]]).astype(np.int32)
        raw = flat.tobytes()
        until = (4 * np.cumsum(np.bincount(atom, many, len(atoms)))).astype(np.int64).tolist()
        low = 0
        for name, high in zip(atoms, until):
            self.atoms[name] = raw[low:high]
            low = high

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every match; a character that is no piece is a match of its own, piece -1."""
        ids, lengths, low, high = self.table.search_keys
        words = low.shape[1]
        padded = np.concatenate([text, np.zeros(_WORD * (words + 1), np.uint8)]).astype(np.uint64)
        size = len(text)
        keys = np.zeros(size + _WORD * words, np.uint64)
        for k in range(_WORD):
            keys |= padded[k : k + len(keys)] << np.uint64(56 - 8 * k)
        order = suffix_order(keys[:size], words)

        head = keys[order]
        from_, to = np.searchsorted(head, low[:, 0], "left"), np.searchsorted(head, high[:, 0], "right")
        # pieces of more than one sort key: on within the range of their first
        long = np.flatnonzero((lengths > _WORD) & (to > from_))

        def bound(wanted: np.ndarray, after_equal: bool) -> np.ndarray:
            """Where the suffixes below a key end, by halving the ranges of all long pieces at once."""
            first, final = from_[long].copy(), to[long].copy()
            while (open_ := first < final).any():
                middle = (first + final) // 2
                at = order[np.minimum(middle, size - 1)]
                below, same = np.zeros(len(long), bool), np.ones(len(long), bool)
                for w in range(1, words):
                    there = keys[at + _WORD * w]
                    below |= same & (there < wanted[:, w])
                    same &= there == wanted[:, w]
                if after_equal:
                    below |= same
                first = np.where(open_ & below, middle + 1, first)
                final = np.where(open_ & ~below, middle, final)
            return first

        from_[long], to[long] = bound(low[long], False), bound(high[long], True)
        count = to - from_
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = order[np.repeat(from_, count) + place].astype(np.int32)
        ends, tokens = starts + np.repeat(lengths.astype(np.int32), count), np.repeat(ids, count)
        heads = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
        following = np.append(heads[1:], size)
        marks = np.flatnonzero(text == 0xFF)
        tails = np.minimum(following, marks[np.searchsorted(marks, heads)])
        single = np.zeros(size + 1, bool)
        full = np.zeros(size, np.int64)
        full[heads] = tails
        single[starts[ends == full[starts]]] = True
        lone = ~single[heads]
        return (
            np.concatenate([starts, heads[lone].astype(np.int32)]),
            np.concatenate([ends, tails[lone].astype(np.int32)]),
            np.concatenate([tokens, np.full(lone.sum(), -1, np.int32)]),
        )

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the right piece may follow the left one; characters that are no piece never merge."""
        keys = left.astype(np.int64) * len(self.table.pieces) + right
        place = (keys * 0x9E3779B1) % _PAIRS
        pairs = (left >= 0) & (right >= 0)
        held = self.pair_at[place] == keys
        out = np.where(pairs, self.pair_fits[place], True)
        new = np.flatnonzero(pairs & ~held)
        if len(new):
            missed, which = np.unique(keys[new], return_inverse=True)
            pieces, n = self.table.pieces, len(self.table.pieces)
            fresh = np.array([self.table.may_follow(pieces[k // n], pieces[k % n]) for k in missed.tolist()], bool)
            out[new] = fresh[which]
            self.pair_at[place[new]], self.pair_fits[place[new]] = keys[new], out[new]
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(table: PieceTable) -> Encoder:
    """One encoder for each model in a worker, so its memory of chunks outlives a task."""
    key = hash(table.model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(table)
    return _ENCODERS[key]


def load(model_path: str) -> PieceTable:
    """Read a model file on the driver; its size is that of a vocabulary."""
    with open(model_path, "rb") as file:
        return PieceTable(file.read())


def _add_ids(batch: pa.RecordBatch, table: PieceTable, text_column: str, ids_column: str) -> pa.RecordBatch:
    ids = _encoder(table).encode([t or "" for t in batch[text_column].to_pylist()])
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    return batch.append_column(ids_column, pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)))


def _add_text(batch: pa.RecordBatch, table: PieceTable, ids_column: str, text_column: str) -> pa.RecordBatch:
    """All lists of a batch at once: every id's bytes are gathered from one string of all surfaces."""
    surface, begins, sizes = table.gather
    lists = batch[ids_column]
    counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    many = sizes[flat]
    place = np.repeat(begins[flat] - np.cumsum(many) + many, many) + np.arange(many.sum())
    raw = surface[place].tobytes()
    stops = np.concatenate(([0], np.cumsum(many)))[np.cumsum(counts)].tolist()
    texts, at = [], 0
    for stop in stops:
        texts.append(raw[at:stop].removeprefix(b" ").decode("utf-8", "replace"))
        at = stop
    return batch.append_column(text_column, pa.array(texts, pa.string()))


def _mapped(df: DataFrame, table: PieceTable, added: list[StructField], steps) -> DataFrame:
    """Apply steps to small batches; the table is broadcast, its size is fixed by the model."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    plain = df.drop(*[field.name for field in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, _STEP):
            for step, *names in steps:
                batch = step(batch, shared.value, *names)
            yield batch

    return plain.mapInArrow(run, StructType([*plain.schema.fields, *added]))


def _ids_field(name: str) -> StructField:
    return StructField(name, ArrayType(IntegerType(), False))


def encode(docs: DataFrame, table: PieceTable, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """Add the list of piece ids of every whole text; equal to the public library's ids for the same model.

    Null and empty texts have no ids. Texts are cut where the vocabulary has no piece across, so a batch
    is indexed by its distinct atoms. Rows, repeats included, keep their other columns; a column of the
    result's name is replaced.
    """
    return _mapped(docs, table, [_ids_field(ids_column)], [(_add_ids, text_column, ids_column)])


def decode(tokens: DataFrame, table: PieceTable, ids_column: str = "token_ids", text_column: str = "decoded") -> DataFrame:
    """Add the text of every id list: pieces joined, byte pieces as bytes, the leading space dropped.

    Bytes that are no UTF-8 become replacement characters; a null list gives an empty text. The space
    mark of the model is a space in the result, so a text that holds that mark itself comes back with a space.
    """
    return _mapped(tokens, table, [StructField(text_column, StringType())], [(_add_text, ids_column, text_column)])


def encode_and_decode(
    docs: DataFrame, table: PieceTable, text_column: str = "text", ids_column: str = "token_ids", decoded: str = "decoded"
) -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one pass over the rows."""
    steps = [(_add_ids, text_column, ids_column), (_add_text, ids_column, decoded)]
    return _mapped(docs, table, [_ids_field(ids_column), StructField(decoded, StringType())], steps)


def same_text(text: str, decoded: str):
    """Whether decoding gave the text back, but for the space mark that the model cannot tell from a space."""
    return F.coalesce(F.col(decoded) == F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE), F.lit(" ")), F.lit(False))


def encoded_documents(docs: DataFrame, table: PieceTable, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, token_ids, decoded_sha256, round_trip`` of every row, encoded and decoded again."""
    both = encode_and_decode(docs.select(F.col(id_column).alias("doc_id"), "text"), table)
    return both.select(
        "doc_id",
        F.size("token_ids").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        same_text("text", "decoded").alias("round_trip"),
    )
