"""The pipeline's stages, each on its own input, against brute force."""

from collections import defaultdict

import pytest
from conftest import SMALL

import corpus_pipeline
from tidemark.llm import langid, mixing
from tidemark.session import stage


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for name, function in corpus_pipeline.STAGES:
        seen.append(stage(function(spark, seen[-1], SMALL), name))
    return seen


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_language_keeps_documents_with_letters(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after == {i: t for i, t in before.items() if langid.has_letter((t or "").encode())}


def test_exact_dedup_keeps_the_largest_id(stages):
    owner = defaultdict(int)
    for i, t in texts(stages[1]).items():
        key = t.encode().lower()
        owner[key] = max(owner[key], i)
    assert set(texts(stages[2])) == set(owner.values())


def test_near_dedup_keeps_one_of_each_group(stages):
    before, kept = texts(stages[2]), set(texts(stages[3]))
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in before.items())}
    ids = sorted(before)
    likeness = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in ids for b in ids if a < b}
    alike = [pair for pair, x in likeness.items() if x >= 0.8]
    # masks miss under 1 % of the pairs at 0.8 and fewer above: of these few, one at most
    missed = [pair for pair in alike if pair[1] in kept and pair[0] in kept]
    assert alike and len(missed) <= 1
    # what went has a document of a smaller id in its group, and every link of a group has a likeness of 0.8
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    gone = set(ids) - kept
    assert all(find(i) < i for i in gone)


def test_mixing_repeats_documents(stages):
    want = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(stages[3]).collect() if r.taken}
    got = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens_of_every_row(stages):
    assert stages[5].count() == stages[4].count() and stages[5].filter("NOT round_trip OR n_tokens = 0").count() == 0
