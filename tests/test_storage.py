"""Clustered storage, rejected lines, the embedding store, samples, code lists, parity and sparse correlations."""

import random
import sys
from collections import Counter
from functools import partial

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.queries import ClusteredTables, Tables
from tidemark.operators import cohort, compare, explore, features, tfidf, vectors
from tidemark.plans import raw
from tidemark.plans.records import Records
from tidemark.session import stage
from tidemark.sources import clustered, readers
from tidemark.sources.embedding_store import EmbeddingStore, text_digest

# workers cannot import test modules
vectors.cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- clustered storage -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clusters(spark):
    return ClusteredTables(spark, SMALL)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("table, joined", [("labs", 0), ("meds", 0), ("diagnoses", 0)])
def test_raw_rows_are_not_shuffled(spark, clusters, no_broadcast, table, joined):
    """From the scan to the entity-feature pairs only the windows move, to meet the buckets."""
    clusters.period = stage(clusters.period, "period")
    pairs = features._pairs(clusters.inside(getattr(clusters, table)), ["mean", "max"])
    pairs.write.format("noop").mode("overwrite").save()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert "Bucketed: true" in plan and "SelectedBucketsCount" in plan
    plain = Tables(spark, SMALL)
    plain.period = clusters.period
    shuffled = features._pairs(plain.inside(getattr(plain, table)), ["mean", "max"])
    assert shuffled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") > 1
    assert compare.multiset_difference(pairs, shuffled).count() == 0


def test_layout_and_reopened_tables(spark, tmp_path):
    rows = [(i % 50, i, None if i % 7 else "x") for i in range(600)] + [(None, 1, "lost")] * 3
    df = spark.createDataFrame(rows, "SUBJECT_ID long, n long, t string")
    layout = clustered.write_clustered_tables({"a": df, "b": df}, str(tmp_path), "SUBJECT_ID", 4, ["a"])
    assert {r.table: (r.buckets, r.largest_entity, r.rows) for r in layout.collect()} == {"a": (4, 12, 600), "b": (0, None, None)}
    for table, (key, buckets) in clustered.read_layout(spark, str(tmp_path)).items():
        again = clustered.open_clustered(spark, f"{tmp_path}/{table}", df.schema, key, buckets)
        assert compare.multiset_difference(df, again).count() == 0
    assert clustered.read_layout(spark, str(tmp_path / "nothing")) == {}


def test_clustering_reads_its_rows_once(spark, tmp_path):
    """Rows are counted where they were written, not by a second pass over what makes them."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i % 50, i) for i in range(600)], 3).map(lambda r: seen.add(1) or r)
    df = spark.createDataFrame(rows, "SUBJECT_ID long, n long")
    assert clustered.write_clustered(df, str(tmp_path / "once"), "SUBJECT_ID", 4) == (4, 12, 600)
    assert seen.value == 600


def test_hot_entity_is_left_to_adaptive_execution(spark, tmp_path):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("SUBJECT_ID"), "id")
    assert clustered.write_clustered(df, str(tmp_path / "hot"), "SUBJECT_ID", 64)[0] == 0
    back = clustered.open_clustered(spark, str(tmp_path / "hot"), df.schema, "SUBJECT_ID", 0)
    assert back.count() == 60_000


def test_empty_table_is_clustered(spark, tmp_path):
    df = spark.createDataFrame([], "SUBJECT_ID long, n long")
    assert clustered.write_clustered(df, str(tmp_path / "none"), "SUBJECT_ID", 4) == (4, 0, 0)
    assert clustered.open_clustered(spark, str(tmp_path / "none"), df.schema, "SUBJECT_ID", 4).count() == 0


def test_records_come_back(spark, clusters, tmp_path):
    raw.cluster(Records(**{n: getattr(clusters.records, n) for n in ("patients", "admissions", "diagnoses", "labevents", "prescriptions")}), str(tmp_path), 3)
    assert raw.load_converted(spark, str(tmp_path)).labevents.count() == clusters.records.labevents.count()


# --- rejected lines --------------------------------------------------------------------------------


def test_quarantine(spark, tmp_path):
    lines = ["a,b,c", "1,2.5,x", "one,2.5,x", "2,much,y", "three,more,z", "4,5.5", "5,6.5,x,extra", '6,7.5,"q""uo,te"', ",,"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    rows = readers.read_csv(spark, str(tmp_path / "t.csv"), readers.with_corrupt_column(schema))
    clean, rejected = str(tmp_path / "clean"), str(tmp_path / "rejected")
    assert raw.quarantine(rows, schema, "t", clean, rejected) == (8, 3, 5)
    assert sorted((r.a or 0, r.b or 0.0, r.c or "") for r in spark.read.parquet(clean).collect()) == [(0, 0.0, ""), (1, 2.5, "x"), (6, 7.5, 'q"uo,te')]
    found = {(r.table, r.line, r.field, r.reason) for r in spark.read.parquet(rejected).collect()}
    assert found == {
        ("t", "one,2.5,x", "a", "not a bigint"), ("t", "2,much,y", "b", "not a double"), ("t", "three,more,z", "a", "not a bigint"),
        ("t", "three,more,z", "b", "not a double"), ("t", "4,5.5", None, "too few fields"), ("t", "5,6.5,x,extra", None, "too many fields"),
    }


def test_a_word_is_hashed_once_a_call(monkeypatch):
    asked, plain = [], vectors.HashingEncoder._cell
    monkeypatch.setattr(vectors.HashingEncoder, "_cell", lambda self, word: asked.append(word) or plain(self, word))
    encoded = vectors.HashingEncoder(8)(["a b a", "b c", "", None])
    assert sorted(asked) == ["a", "b", "c"]
    assert (encoded == np.vstack([vectors.HashingEncoder(8)([t])[0] for t in ("a b a", "b c", "", None)])).all()


# --- embedding store -------------------------------------------------------------------------------


class Counting:
    """An encoder whose vectors show the text's length."""

    def __call__(self, texts):
        return np.array([[float(len(t or "")), 1.0] for t in texts])


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts), "entity_id long, to_tok string")


def held(store):
    return sorted((r.entity_id, r.encoder, r.vec[0]) for r in store.read().collect())


def test_texts_of_a_repeated_arrival_do_not_move(spark, tmp_path, monkeypatch):
    from tidemark.sources import embedding_store

    written, plain = [], embedding_store.stage
    monkeypatch.setattr(embedding_store, "stage", lambda df, name, path=None: written.append(df.columns) or plain(df, name, path))
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    texts = [(1, "a"), (None, "a"), (None, "a"), (2, None)]
    assert store.update(docs_of(spark, texts), Counting, "e") == 3 and store.update(docs_of(spark, texts), Counting, "e") == 0
    assert store.version() == 1 and not any("text" in columns for columns in written)


def test_store_adds_what_is_new(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.version() == 0
    assert store.update(docs_of(spark, [(1, "a"), (2, "bb"), (2, "bb"), (3, None)]), Counting, "e") == 3
    assert store.update(docs_of(spark, [(1, "a"), (2, "bb"), (3, "")]), Counting, "e") == 0 and store.version() == 1
    assert store.update(docs_of(spark, [(1, "changed"), (2, "bb"), (4, "a")]), Counting, "e") == 2
    assert store.update(docs_of(spark, [(1, "a")]), Counting, "other") == 1
    assert held(store) == [(1, "e", 1.0), (1, "e", 7.0), (1, "other", 1.0), (2, "e", 2.0), (3, "e", 0.0), (4, "e", 1.0)]
    assert [(r.entity_id, r.vec[0]) for r in store.current(docs_of(spark, [(1, "changed"), (9, "?")]), "e").collect()] == [(1, 7.0)]
    assert store.read(1).count() == 3


def test_uncommitted_parts_are_not_read(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    store.update(docs_of(spark, [(1, "a")]), Counting, "e")
    store.read().write.parquet(f"{store.path}/parts/half_failed")
    assert held(store) == [(1, "e", 1.0)]
    assert store.update(docs_of(spark, [(1, "a")]), Counting, "e") == 0


def test_two_writers_store_a_key_once(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's look and its commit."""
    store, other = (EmbeddingStore(spark, str(tmp_path / "store")) for _ in range(2))
    commit, raced = EmbeddingStore._commit, []

    def late(self, version, parts):
        if self is store and not raced:
            raced.append(other.update(docs_of(spark, [(1, "a"), (2, "b")]), Counting, "e"))
        return commit(self, version, parts)

    monkeypatch.setattr(EmbeddingStore, "_commit", late)
    assert store.update(docs_of(spark, [(1, "a"), (3, "c")]), Counting, "e") == 1 and raced == [2]
    assert held(store) == [(1, "e", 1.0), (2, "e", 1.0), (3, "e", 1.0)] and store.version() == 2


def test_digest_of_null_is_that_of_empty(spark):
    rows = docs_of(spark, [(1, None), (2, "")]).select(text_digest("to_tok").alias("d")).collect()
    assert rows[0].d == rows[1].d


# --- windows of long texts -------------------------------------------------------------------------


def test_windows_hold_every_word(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(i))) for i in (0, 1, 9, 10, 11, 14, 15, 41)] + [(100, None), (101, "  a \n b ")]
    rows = vectors.text_windows(docs_of(spark, texts), size=10, step=7).collect()
    for entity, text in texts:
        words = (text or "").split()
        own = sorted((r.window, r.text) for r in rows if r.entity_id == entity)
        want = [words[i * 7 : i * 7 + 10] for i in range(max(0, -(-(len(words) - 10) // 7)) + 1)]
        assert [t.split() for _, t in own] == want
    with pytest.raises(ValueError):
        vectors.text_windows(docs_of(spark, texts), size=5, step=6)


def test_windows_are_weighed_by_words(spark):
    (row,) = vectors.embed_windows(docs_of(spark, [(1, "aa bb cc")]), Counting, size=2, step=2, tasks=2).collect()
    assert row.vec[0] == pytest.approx((5 * 2 + 2 * 1) / 3)


# --- samples, code lists ---------------------------------------------------------------------------


@pytest.mark.parametrize("n, small, digits", [(0, 10, 1), (1, 1, 1), (37, 5, 1), (500, 10_000, 3), (999, 3, 2), (1000, 1, 1), (5000, 1, 1)])
def test_sample_takes_the_first_hashes(spark, n, small, digits):
    import hashlib

    ids = spark.range(1000).withColumnRenamed("id", "entity_id").repartition(7)
    got = [r.entity_id for r in cohort.entity_sample(ids, n, seed=4, small=small, digits=digits).collect()]
    want = sorted(range(1000), key=lambda i: hashlib.md5(f"{i}:4".encode()).hexdigest())[:n]
    assert sorted(got) == sorted(want)


def test_sample_of_repeated_ids_is_exact(spark):
    ids = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("entity_id"))
    counts = [cohort.entity_sample(ids, n, small=5, digits=2).count() for n in (0, 1, 299, 450, 899, 900, 901)]
    assert counts == [0, 1, 299, 450, 899, 900, 900]
    assert cohort.entity_sample(ids.limit(0), 5).count() == 0


def test_sample_has_no_sort_of_all_ids(spark):
    plan = cohort.entity_sample(spark.range(100_000).withColumnRenamed("id", "entity_id"), 500)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan and "TakeOrderedAndProject" in plan


def test_longest_code_decides(spark):
    groups = {"short": ["48"], "mid": [480], "long": ["48012"], "also_long": ["48012"], "letter": ["E"]}
    codes = ["48", "481", "480", "4801", "48012", "480123", "E1", "4", None, ""]
    events = spark.createDataFrame([(i, f"ICD_9_{c}" if c is not None else None) for i, c in enumerate(codes)], "entity_id long, feature string")
    got = sorted((codes[r.entity_id], r.code_group) for r in cohort.code_group_events(events, groups).collect())
    assert got == sorted([("48", "short"), ("481", "short"), ("480", "mid"), ("4801", "mid"), ("48012", "long"), ("48012", "also_long"),
                          ("480123", "long"), ("480123", "also_long"), ("E1", "letter")])
    assert cohort.code_group_events(events, {}).count() == 0
    with pytest.raises(ValueError):
        cohort.code_group_events(events, {"all": [""]})


# --- parity ----------------------------------------------------------------------------------------

LEFT = [(1, "a", 1.0, None), (1, "a", 1.0, None), (2, "b", None, [1]), (3, None, -0.0, [2]), (None, "n", 2.0, None)]
RIGHT = [(1, "a", 1.0, None), (2, "b", 9.0, [1]), (3, None, 0.0, [2]), (4, "d", 1.0, None), (None, "n", 2.0, None)]


def test_differences_as_multisets(spark):
    left, right = (spark.createDataFrame(rows, "k long, t string, v double, xs array<int>") for rows in (LEFT, RIGHT))
    found = compare.multiset_difference(left, right.select("xs", "v", "t", "k"))
    got = Counter({(r.k, r.t, r.v): r.n_left - r.n_right for r in found.collect()})
    assert got == {(1, "a", 1.0): 1, (2, "b", None): 1, (2, "b", 9.0): -1, (4, "d", 1.0): -1}
    parity = {r.column: (r.only_left, r.only_right) for r in compare.frame_parity(left, right, ["k"]).collect()}
    assert parity == {"k": (1, 1), "t": (1, 1), "v": (2, 2), "xs": (1, 1), "*": (2, 2)}
    same = {r.column: (r.only_left, r.only_right) for r in compare.frame_parity(left, left.repartition(3), ["k"]).collect()}
    assert set(same.values()) == {(0, 0)} and len(same) == 5
    none = compare.frame_parity(left.limit(0), right.limit(0), ["k"])
    assert {(r.only_left, r.only_right) for r in none.collect()} == {(0, 0)}
    with pytest.raises(ValueError):
        compare.frame_parity(left, right.drop("v"), ["k"])


def test_parity_spells_only_rows_that_differ(spark):
    """Equal rows are gone before a row becomes one row per column, and the counts are those of plain counting."""
    rng = random.Random(3)
    sides = [[(rng.randint(0, 3), rng.choice([None, "a", "b"]), rng.choice([None, 0.0, -0.0, 1.0])) for _ in range(n)] for n in (90, 70)]
    left, right = (spark.createDataFrame(rows, "k long, t string, v double") for rows in sides)
    out = compare.frame_parity(left, right, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.partition("Generate")[2]
    views = {"k": lambda r: r[0], "t": lambda r: r[:2], "v": lambda r: (r[0], r[2]), "*": lambda r: r}
    for r in out.collect():
        a, b = (Counter(views[r.column](x) for x in rows) for rows in sides)
        assert (r.only_left, r.only_right) == ((a - b).total(), (b - a).total()), r.column


# --- sparse correlation, portable hashing ----------------------------------------------------------


def test_texts_are_read_once_for_their_cells(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, ["a", "b", f"w{i % 7}"]) for i in range(40)], 3).map(lambda r: seen.add(1) or r)
    docs = spark.createDataFrame(rows, "entity_id long, words array<string>")
    cells = tfidf.portable_hashing_tfidf(docs, buckets=10).collect()
    assert sum(r.tf for r in cells) == 120
    # once for the cells and once for the number of documents
    assert seen.value == 80


def test_correlation_equals_numpy(spark):
    rng = random.Random(5)
    names = [f"f{i:03d}" for i in range(70)]
    flags = {e: {n for i, n in enumerate(names) if rng.random() < (0.9 if i == 0 else 0.08)} for e in range(200)}
    rows = [(e, n) for e, own in flags.items() for n in own] + [(0, "f000"), (0, "f000"), (9999, "stranger")]
    flags[0].add("f000")
    presence = spark.createDataFrame(rows, "entity_id long, feature string")
    entities = spark.range(220).withColumnRenamed("id", "entity_id")
    dense = np.array([[n in flags.get(e, ()) for n in names] for e in range(220)], float)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(dense.T)
    got = {(r.a, r.b): (r.n, r.r) for r in explore.flag_correlation(presence, entities).collect()}
    both = dense.T @ dense
    assert set(got) == {(names[i], names[j]) for i in range(70) for j in range(i, 70) if both[i, j]}
    for (a, b), (n, r) in got.items():
        i, j = names.index(a), names.index(b)
        assert n == both[i, j] and r == pytest.approx(want[i, j])


def test_blocks_of_the_gram_matrix(spark):
    presence = spark.createDataFrame([(e, f"f{i}") for e in range(6) for i in range(9) if (e * i) % 4 != 1], "entity_id long, feature string")
    codes = spark.createDataFrame([(f"f{i}", i) for i in range(9)], "feature string, idx long")
    whole = explore.co_occurrences(presence, codes)
    assert compare.multiset_difference(whole, explore.co_occurrences(presence, codes, block=2, held=2)).count() == 0


def test_portable_buckets(spark):
    import hashlib
    import math

    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "entity_id long, words array<string>")
    rows = tfidf.portable_hashing_tfidf(docs, buckets=5, min_doc_freq=1).collect()
    bucket = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 5 for w in "ab"}
    want = {1: Counter(bucket[w] for w in "aba"), 2: Counter([bucket["b"]])}
    assert {(r.entity_id, r.bucket): r.tf for r in rows} == {(e, b): n for e, c in want.items() for b, n in c.items()}
    for r in rows:
        assert r.weight == pytest.approx(r.tf * math.log(5 / (r.df + 1)))


def test_encoder_of_windows_is_loaded_on_workers(spark):
    made = vectors.embed_windows(docs_of(spark, [(i, "x " * i) for i in range(30)]), partial(vectors.HashingEncoder, 4), size=8, step=4, tasks=3)
    assert made.count() == 30
