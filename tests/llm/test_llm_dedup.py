"""Exact and near dedup, fingerprints and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidemark.llm import simhash, spotsigs, trie_dedup
from tidemark.llm.components import component_roots


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- tries ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=40))
def test_trie_owners(entries):
    trie = trie_dedup.RadixTrie()
    for row, (text, rank) in enumerate(entries):
        trie.insert(text, rank, row, 1)
    want = {}
    for text, rank in entries:
        best, copies = want.get(text, (-1, 0))
        want[text] = max(best, rank), copies + 1
    assert sorted((rank, copies) for rank, _, copies in trie.owners) == sorted(want.values())
    assert {entries[row][0] for _, row, _ in trie.owners} == set(want)


def test_equal_hashes_do_not_merge_texts():
    rows = pa.table({"doc_id": [1, 2, 3], "text": ["abc", "abd", "ABC"], "_trie_length": [3] * 3, "_trie_hash": [7] * 3,
                     "_trie_copies": pa.array([1] * 3, pa.int64())})
    out = trie_dedup._winners(rows, "doc_id", "text").to_pylist()
    assert sorted((r["doc_id"], r["_trie_copies"]) for r in out) == [(2, 1), (3, 2)]


def test_hot_text_over_many_batches(spark):
    """A third of all rows hold one text; the shuffle gets it once per batch, the result has it once."""
    rows = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot TEXT' ELSE 'text ' || id END AS text")
    kept = trie_dedup.distinct_texts(rows.repartition(12))
    assert kept.count() == 20_001
    hot = kept.filter("lower(text) = 'hot text'").first()
    assert (hot.doc_id, hot.group_size) == (29_997, 10_000)


# --- SimHash -------------------------------------------------------------------------------------


def plain_simhash(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    """Smallest id reachable by flooding over all pairs."""
    ids, prints = list(values), np.array(list(values.values()), np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    label = np.array(ids)
    while True:
        fresh = np.array([label[row].min() for row in close])
        if (fresh == label).all():
            return dict(zip(ids, label.tolist()))
        label = fresh


def test_near_groups(docs, texts):
    prints = {i: plain_simhash(t, 4) for i, t in texts.items()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_groups(docs).collect()}
    roots = plain_components(prints, 4)
    assert got == {i: (prints[i], roots[i]) for i in texts}


@pytest.mark.parametrize("distance, blocks", [(4, 6), (3, 5), (4, 8)])
def test_links_find_all_components(spark, distance, blocks):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):  # chains of small steps
            for _ in range(rng.randint(0, distance + 1)):
                at ^= 1 << rng.randrange(64)
            values.add(at)
    values = dict(enumerate(sorted(values)))
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in values.items()]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "id long, fp long"), distance, blocks)
    roots = {r.node: r.root for r in component_roots(links, "a", "b").collect()}
    assert {i: roots.get(i, i) for i in values} == plain_components(values, distance)


@pytest.mark.parametrize("flips", [2, 5, 12])
def test_one_large_cell(flips):
    rng = np.random.default_rng(flips)
    values = np.full(700, rng.integers(0, 2**63, dtype=np.uint64))
    for _ in range(flips):
        values ^= np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)
    values = np.unique(values)
    values = values[np.argsort(simhash._gray_rank(values))]
    got = simhash.link_cells(np.zeros(len(values), int), values[:, None], 4)
    want = plain_components(dict(enumerate(values.tolist())), 4)
    assert got.tolist() == list(want.values())


def test_one_large_cell_of_wide_prints():
    rng = np.random.default_rng(8)
    bits = np.repeat(rng.integers(0, 2, (40, 256)), 20, axis=0) ^ (rng.random((800, 256)) < 0.07)
    values = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
    values = values[np.argsort(simhash._gray_rank(values[:, 0]))]
    close = np.bitwise_count(values[:, None] ^ values[None, :]).sum(axis=2) <= 38
    want = np.arange(800)
    while True:
        fresh = np.array([want[row].min() for row in close])
        if (fresh == want).all():
            break
        want = fresh
    assert simhash.link_cells(np.zeros(800, int), values, 38).tolist() == want.tolist()
    assert 20 < len(set(want)) < 200


def test_wide_prints_find_likeness(spark):
    """Families of edited texts: pairs of likeness 0.8 or more are found, unlike texts stay apart."""
    rng = random.Random(11)
    rows = []
    for family in range(80):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 500))]
        edited = list(base)
        for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.021)))):
            edited[rng.randrange(len(base))] = f"x{rng.randrange(3000)}"
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distance = simhash.bits_apart(0.8, 256)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, 5, distance, width=4).collect()}
    assert all(root // 2 == i // 2 for i, root in got.items())

    def grams(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    texts = dict(rows)
    alike = [i for i in range(0, 160, 2) if len(grams(texts[i]) & grams(texts[i + 1])) >= 0.8 * len(grams(texts[i]) | grams(texts[i + 1]))]
    assert len(alike) > 50 and sum(got[i + 1] == i for i in alike) >= 0.9 * len(alike)


def test_a_shared_line_does_not_make_texts_alike(spark):
    """Two texts that repeat a line often, with other words around it, are no near copies as sets of shingles."""
    rng = random.Random(3)
    line = " ".join(f"l{k}" for k in range(9))
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(60)) + f" {line}" * 40) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_groups(docs, 5, simhash.bits_apart(0.8, 256), width=4, repeats=False).collect()
    assert {r.component_id for r in found} == set(range(6))
    assert {r.component_id for r in simhash.near_groups(docs, 5, simhash.bits_apart(0.8, 256), width=4).collect()} == {0}


def test_confirmed_links_are_alike_and_few_are_missed(spark):
    """Pairs from 0.6 to 1: links are exactly those of likeness 0.8 or more, but for under 1 % that the prints do not propose."""
    rng = random.Random(21)
    rows = []
    for family in range(400):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        edited = list(base)
        for at in rng.sample(range(300), rng.randint(1, 14)):
            edited[at] = f"x{rng.randrange(3000)}"
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(edited))]
    # copies that differ in spaces or letters, and texts without words
    rows += [(5000, rows[0][1] + "  "), (5001, "a b c"), (5002, "A  b c"), (5003, None), (5004, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}

    def grams(text):
        words = text.split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    texts = dict(rows)
    pairs = {}
    for i in range(0, 800, 2):
        x, y = grams(texts[i]), grams(texts[i + 1])
        pairs[i + 1] = len(x & y) / len(x | y)
    alike = [i for i, x in pairs.items() if x >= 0.8]
    assert sum(0.65 < x < 0.8 for x in pairs.values()) > 80 and len(alike) > 100
    assert all(i in kept for i, x in pairs.items() if x < 0.8)
    assert sum(i not in kept for i in alike) >= 0.99 * len(alike)
    assert 0 in kept and 5000 not in kept and {5001, 5002, 5003, 5004} & kept == {5001, 5003}


def test_rare_shingles_lose_no_alike_pair(spark):
    """Families of sets with some hashes replaced, in two parts and several groups; pairs of one group are not wanted."""
    rng = random.Random(11)
    rows, sets = [], {}
    for i in range(240):
        part, base = i % 2, [hash((i % 6, k)) for k in range(rng.randint(40, 60))]
        own = {x if rng.random() > 0.04 else rng.getrandbits(62) for x in base} | {rng.getrandbits(62) for _ in range(i % 3)}
        sets[i] = part, i if i % 4 else 1000 + part, own
        rows.append((part, i, sets[i][1], bytearray(np.sort(np.array([x & (2**62 - 1) for x in own], np.int64)).tobytes())))
        sets[i] = part, sets[i][1], {x & (2**62 - 1) for x in own}
    rows.append((0, 998, 998, bytearray()))
    frame = spark.createDataFrame(rows, "part long, id long, known long, own binary").repartition(5)
    got = {(r.a, r.b) for r in simhash.rare_shingle_pairs(frame, 0.8).collect()}
    want, possible = set(), 0
    for a in range(240):
        for b in range(a + 1, 240):
            (p, g, x), (q, h, y) = sets[a], sets[b]
            possible += p == q and g != h
            if p == q and g != h and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                want.add((a, b))
    assert len(want) > 100 and want <= got and len(got) < possible / 2
    assert all(sets[a][0] == sets[b][0] and sets[a][1] != sets[b][1] for a, b in got)
    confirmed = {(r.a, r.b) for r in simhash.alike(spark.createDataFrame(sorted(got), "a long, b long"), frame.select("id", "own"), 0.8).collect()}
    assert confirmed == want


def test_differences_lose_no_alike_pair(spark):
    """Sets made from one by replacing hashes, some of them shared; the larger group is searched from every set outside it."""
    rng = random.Random(23)
    base = rng.sample(range(1 << 40), 50)
    swaps = [(rng.sample(base, 3), rng.sample(range(1 << 40), 3)) for _ in range(12)]
    sets = {0: set(base)}
    for i in range(1, 160):
        own = set(base)
        for gone, new in rng.sample(swaps, rng.randint(0, 4)):
            own = own - set(gone) | set(new)
        sets[i] = {x if rng.random() > 0.03 else rng.getrandbits(40) for x in own}
    sets[160], sets[161] = set(), {7}
    known = {i: 0 if i % 3 else i for i in sets} | {0: 0}

    def as_bytes(own):
        return bytearray(np.array(sorted(own), np.int64).tobytes())

    rows = [(3, i, known[i], as_bytes(own), 0, as_bytes(sets[0])) for i, own in sets.items()]
    schema = "part long, id long, known long, own binary, rep long, rep_own binary"
    against = simhash.differences(spark.createDataFrame(rows, schema).repartition(4), 0.8)
    found = {r.id: r for r in against.collect()}

    def are_alike(a, b):
        x, y = sets[a], sets[b]
        return len(x & y) >= 0.8 * len(x | y) - 1e-9

    for i, own in sets.items():
        assert sorted(found[i].removed) == sorted(sets[0] - own) and sorted(found[i].added) == sorted(own - sets[0])
        assert found[i].core == are_alike(i, 0)
    inside = {i for i in sets if known[i] == 0 or found[i].core}
    got = {(r.a, r.b) for r in simhash.pairs_with_differences(against, 0.8).collect()}
    possible = {(min(a, b), max(a, b)) for a in inside for b in set(sets) - inside}
    want = {(a, b) for a, b in possible if are_alike(a, b)}
    assert len(want) > 50 and want <= got <= possible and len(got) < len(possible)
    # two alike sets without a difference in common are both of the core
    for a in sets:
        for b in sets:
            common = set(found[a].removed) & set(found[b].removed) or set(found[a].added) & set(found[b].added)
            assert common or not are_alike(a, b) or (found[a].core and found[b].core) or not (sets[a] or sets[b])


def test_one_large_group_of_near_copies(spark):
    """Four hundred texts with one word changed each: most pairs are not alike, and the groups are exactly those of all links."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(400):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(words)
    grams = {i: {tuple(w[k : k + 5]) for k in range(56)} for i, w in ((i, t.split()) for i, t in texts.items())}
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(400):
        for b in range(a + 1, 400):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    distance = simhash.bits_apart(0.8, 128, deviations=3)
    groups = simhash.near_groups(docs, 5, distance, width=2, repeats=False, likeness=0.8, bits=16, rounds=10)
    assert {r.doc_id: r.component_id for r in groups.collect()} == {i: find(i) for i in range(400)}


def test_first_word_of_a_wide_print_is_the_narrow_one():
    text = b"one two three four five six seven"
    assert simhash.simhash(text, 4, 4)[:1] == simhash.simhash(text, 4) and len(set(simhash.simhash(text, 4, 4))) == 4


def test_masks_cover_every_difference():
    rng = random.Random(2)
    for blocks, distance in ((6, 4), (5, 3), (8, 4)):
        chosen = simhash.masks(blocks, distance)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), distance))
            assert any(not flips & m for m in chosen)


def test_component_of_a_long_path(spark):
    rng = random.Random(1)
    names = list(range(200))
    rng.shuffle(names)
    path = spark.createDataFrame(list(zip(names, names[1:])) + [(5, 5)], "a long, b long")
    assert {r.root for r in component_roots(path, "a", "b").collect()} == {0}
    assert component_roots(path.filter("a = b"), "a", "b").count() == 0


# --- SpotSigs ------------------------------------------------------------------------------------


def test_edit_probe(docs, texts):
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    out = spotsigs.edit_probe(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        own, after = texts[r.doc_id], texts[following[r.doc_id]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        a, b, c = spotsigs.spots(own), spotsigs.spots(edited), spotsigs.spots(after)
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
        assert {int(r.fingerprint[i : i + 8], 16) for i in range(0, len(r.fingerprint), 8)} == a
        assert {int(r.edited_fingerprint[i : i + 8], 16) for i in range(0, len(r.edited_fingerprint), 8)} == b


def test_spots_by_hand():
    assert len(spotsigs.spots("The quick brown fox is at the old barn")) == 5  # start, the, is, at, the
    assert spotsigs.spots("quick brown fox", 2) != spotsigs.spots("quick brown cat", 2)
    assert spotsigs.spots("") == set() and len(spotsigs.spots("word")) == 2


def test_one_document_follows_itself(spark):
    r = spotsigs.edit_probe(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_alike_classes(spark):
    rng = random.Random(4)
    sets = [set(rng.sample(range(3000), rng.randint(1, 30))) for _ in range(40)]
    for s in list(sets):
        for _ in range(4):  # variants around the threshold, and copies
            changed = set(s)
            for _ in range(rng.randint(0, 3)):
                changed.discard(rng.choice(sorted(changed)))
                changed.add(rng.randrange(3000))
            sets.append(changed)
    prints = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "doc_id long, signatures array<long>")
    members, pairs = spotsigs.alike_classes(prints, 0.8)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[frozenset(s)] for i, s in enumerate(sets)}
    reps = [(i, s) for s, i in first.items()]
    want = {(min(i, j), max(i, j)) for i, s in reps for j, t in reps if i < j and len(s & t) / len(s | t) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
