"""Divergence audit, Merkle manifest and packing against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import divergence, merkle, packing
from tidemark.llm.queries import BYTE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the cat the dog", "en", "a", 15),
    (None, "the\ncat", "en", None, None),
    (None, "the\ncat", "en", None, None),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, "The été of " + "x" * 5000 + " the\n" * 3000, "fr", "b", 9),
    (4, "the twin", "fr", "b", 9),
    (5, "\n", None, "b", 1),
]


def odd(spark, copies=1):
    rows = [r for r in ODD for _ in range(copies)]
    clash = ("tree", "rank", "digest", "path", "length", "sequence_id", "offset", "row", "term", "n", "value", "_one")
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- divergence ------------------------------------------------------------------------------------


def plain_audit(rows, min_docs):
    """The audit as the definition reads, over every group and every kept term."""
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        own = Counter(w.decode() for w in divergence._WORDS.findall((text or "").encode().lower()))
        group = lang or "", source or ""
        n[group].update(own)
        in_docs[group[0]].update(own.keys())
        groups[group[0]].add(group[1])
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in in_docs[lang].items() if c >= min_docs)
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def masses(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mass, base = {s: masses(n[lang, s]) for s in sources}, masses(whole)
        for s in sources:
            def f(p, q):
                return (p - q) ** 2 // (p + q)

            pairs = [(-sum(f(mass[s][t], mass[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(mass[s][t], base[t]), t) for t in kept if n[lang, s][t] and mass[s][t] > base[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.source_audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs", [1, 2, 6])
def test_audit_of_odd_rows(spark, min_docs):
    assert audited(odd(spark), min_docs=min_docs) == plain_audit(ODD, min_docs)


def test_audit_over_several_tiles(spark):
    """Seventy sources are three tiles, 2,500 terms three blocks; one source holds a third of all rows."""
    rng = random.Random(3)
    words = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(2500)]
    rows = []
    for i in range(420):
        source = "s0" if i % 3 == 0 else f"s{rng.randrange(70)}"
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(120))), "en", source, 0))
    assert audited(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=2) == plain_audit(rows, 2)


def test_audit_of_nothing(spark):
    assert divergence.source_audit(odd(spark).filter("doc_id = -1")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.integers(1, 9), st.integers(1, 64))
def test_joint_walk_equals_dense_prices(seed, rows_a, rows_b, width):
    rng = np.random.default_rng(seed)
    dense, trees, zeros = [], [], []
    for rows in (rows_a, rows_b):
        zero = rng.integers(1, 1000, rows)
        met = rng.random((rows, width)) < 0.15
        mass = np.where(met, rng.integers(1000, 10**9, (rows, width)), zero[:, None])
        row, col = np.nonzero(met)
        dense.append(mass)
        zeros.append(zero)
        trees.append(divergence.Quadtree(row, col, mass[row, col], 3))
    out, (a, b, at, value, more) = divergence.joint_prices(*trees, *zeros, width, 3)
    want = divergence.price(dense[0][:, None, :], dense[1][None, :, :])
    assert (out == want.sum(axis=2)).all()
    assert (value == want[a, b, at]).all() and (more == (dense[0][a, at] > dense[1][b, at])).all()
    assert len(a) == (dense[0] != zeros[0][:, None]).sum() * rows_b


# --- Merkle manifest -------------------------------------------------------------------------------


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_proofs(rows):
    """Every row's leaf, subroot, root, proof digest, folded root and verdict, by whole lists in memory."""

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([hashed(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        steps = []
        for level in tree[:-1]:
            first = at // 3 * 3
            steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
            at //= 3
        return steps

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for s in sources]
    trees = [levels([leaf_of(*r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (group, tree) in enumerate(zip(groups, trees)):
        for i, row in enumerate(group):
            steps, digest = path(tree, i) + path(top, k), leaf_of(*row)
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                digest = leaf_of(row[0], row[1].replace("\n", ""), *row[2:])
            for before, after in steps:
                digest = hashed(before, digest, after)
            root = top[-1][0]
            out.append((row[0], leaf_of(*row), tree[-1][0], root, hashed(*(b + a for b, a in steps)), digest, digest == root))
    return sorted(out, key=str)


def proved(df, **options):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.audit(df, even, **options).select(columns).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_proofs_of_odd_rows(spark, levels):
    assert proved(odd(spark, 4), levels=levels) == plain_proofs([r for r in ODD for _ in range(4)])


def test_proofs_through_several_pages(spark):
    rows = [(i, f"text\n{i}", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(500)]
    got = proved(spark.createDataFrame(rows, SCHEMA).repartition(4), levels=2)
    assert got == plain_proofs(rows) and 0 < sum(r[-1] for r in got) < len(rows)


def test_one_row_is_its_own_root(spark):
    (row,) = proved(spark.createDataFrame(ODD[:1], SCHEMA))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == hashed("")


def test_no_rows_have_no_proofs(spark):
    assert proved(odd(spark).filter("doc_id = -1")) == []


# --- packing ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(BYTE_MODEL)


def check_packed(rows, texts, model, capacity):
    """Pieces cover every document in order, sequences hold them without gaps or overlap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packed_documents(spark, docs, model):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.packed_documents(docs.repartition(5), BYTE_MODEL).collect()
    used = check_packed(rows, texts, model, 1024)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 1024)
    assert sorted(rows) == sorted(packing.packed_documents(docs, BYTE_MODEL).collect())


def test_packing_odd_rows(spark, model):
    rows = [r for r in odd(spark).filter("doc_id is not null and text is distinct from 'the twin'").collect()]
    frame = spark.createDataFrame([(r.doc_id, r.text, "x") for r in rows], "doc_id long, text string, length string")
    got = packing.packed_documents(frame, BYTE_MODEL, capacity=16).collect()
    check_packed(got, {r.doc_id: r.text for r in rows}, model, 16)
    assert packing.packed_documents(odd(spark), BYTE_MODEL).count() == sum(-(-(len(model.encode(r[1] or "").ids) + 1) // 1024) for r in ODD)
    assert packing.packed_documents(odd(spark).filter("doc_id = -1"), BYTE_MODEL).count() == 0


def test_sequences_hold_the_ids(spark, docs, model):
    some = docs.filter("doc_id < 40")
    made = packing.sequences(some, BYTE_MODEL).collect()
    ids = sorted(i for r in some.collect() for i in [*model.encode(r.text, add_special_tokens=False).ids, 2])
    assert sorted(i for r in made for i in r.ids) == ids and max(len(r.ids) for r in made) <= 1024


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abslldAB  '12.,()\n\t\x1c\x85\xa0\u3000éß漢\U0001f600_")), max_size=60), max_size=4), st.integers(1, 9))
def test_chunks_give_the_ids_of_the_whole(texts, block):
    tokens = packing.ByteTokens(BYTE_MODEL, most=20, longest=4, block=block)
    want = [tokens.model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens(texts)] == want
    tokens = packing.ByteTokens(BYTE_MODEL)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens([*texts, *texts])] == want + want


def best_fit_decreasing(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in range(len(rooms)) if rooms[r] >= length]
            at = min(fits, key=lambda r: rooms[r], default=None)
            if at is None:
                rooms.append(capacity - length)
            else:
                rooms[at] -= length
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), max_size=20))
def test_configurations_hold_exactly_the_counts(counts):
    plan = packing.configurations(counts, 64)
    held = Counter()
    for config, copies in plan:
        assert copies > 0 and sum(x * m for x, m in config) <= 64
        held.update({x: m * copies for x, m in config})
    assert held == Counter(counts)
    used = sum(c for _, c in plan)
    assert used >= -(-sum(x * n for x, n in counts.items()) // 64) and used <= 1.05 * best_fit_decreasing(counts, 64) + 1


def test_program_finds_the_only_good_configuration():
    """Three lengths that fill a sequence together and in no other way: prices keep them in step."""
    counts = {511: 3000, 257: 3000, 256: 3000}
    assert sum(c for _, c in packing.configurations(counts, 1024)) <= 1.02 * 3000


def test_slots_cover_each_length_once():
    plan = packing.configurations({700: 5, 300: 9, 24: 17, 1024: 3})
    places = packing.slots(plan)
    seen = set()
    for length, n in {700: 5, 300: 9, 24: 17, 1024: 3}.items():
        sequence, offset = places.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            taken = {(s, o + i) for i in range(length)}
            assert not taken & seen and o + length <= 1024
            seen |= taken
