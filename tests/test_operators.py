"""Operators against plain Python on small tables, with one hot entity and one hot feature."""

import datetime as dt
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort, evaluate, explore, features, normalize, notes, period, tfidf, vectors
from tidemark.ordering import dense_ids, running_totals
from tidemark.skew import spread_join

from conftest import SMALL

D = dt.date


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- joins and order ---------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, hot_events, how):
    events, _ = hot_events
    small = spark.range(1, 60).select(F.col("id").alias("entity_id"), (F.col("id") * 2).alias("twice"))
    assert rows(spread_join(events, small, "entity_id", how)) == rows(events.join(small, "entity_id", how))


def test_spread_join_spreads_a_hot_key(spark, hot_events):
    events, _ = hot_events
    small = spark.range(1, 121).select(F.col("id").alias("entity_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(events, small, "entity_id", spread_by=["date"])
        tasks = joined.filter("entity_id = 1").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 1


@pytest.mark.parametrize("partitions", [1, 8])
def test_running_totals(spark, partitions):
    data = [(g, float(i * 37 % 101), i % 5) for g in "ab" for i in range(101)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(data, "g string, k double, n long")
        got = {(r.g, r.k): r.n_before for r in running_totals(df, ["k"], ["n"], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {(g, k): sum(n for h, j, n in data if h == g and j < k) for g, k, _ in data}


def test_dense_ids(spark):
    names = [f"n{i % 50:02d}" for i in range(200)]
    got = dict(dense_ids(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect())
    assert got == {n: i for i, n in enumerate(sorted(set(names)))}


# --- windows -----------------------------------------------------------------------------------


def test_period_and_bounds(spark):
    events = spark.createDataFrame(
        [(1, D(2000, 1, 1)), (1, D(2001, 1, 1)), (2, D(2000, 6, 1)), (2, D(2001, 6, 1))], "entity_id long, date date"
    )
    outcomes = spark.createDataFrame([(2, D(2001, 12, 31)), (3, D(2002, 1, 1))], "entity_id long, outcome_date date")
    by_index = {r.entity_id: (r.earliest, r.last) for r in period.train_period([events], outcomes, 100, 50).collect()}
    assert by_index[1] == (D(2001, 1, 1) - dt.timedelta(100), D(2001, 1, 1))
    assert by_index[2] == (D(2001, 12, 31) - dt.timedelta(150), D(2001, 12, 31) - dt.timedelta(50))
    assert 3 in by_index, "an outcome without events keeps its window"
    other = period.train_period([events], outcomes, 100, 50, anchor="last_event", keep_without_events=False)
    assert {r.entity_id: r.earliest for r in other.collect()} == {
        1: D(2001, 1, 1) - dt.timedelta(100),
        2: D(2001, 6, 1) - dt.timedelta(100),
    }
    parity = period.period_parity(period.train_period([events], outcomes, 100, 50), other)
    assert {r.entity_id for r in parity.collect()} == {2, 3}


def test_window_bounds(spark):
    window = spark.createDataFrame([(1, D(2000, 1, 1), D(2000, 1, 3))], "entity_id long, earliest date, last date")
    days = spark.createDataFrame([(1, D(2000, 1, d)) for d in range(1, 5)] + [(2, D(2000, 1, 2))], "entity_id long, date date")
    kept = {b: [r.date.day for r in period.window_filter(days, window, b).orderBy("date").collect()] for b in
            ("half_open", "closed", "open")}
    assert kept == {"half_open": [1, 2], "closed": [1, 2, 3], "open": [2]}


# --- features ----------------------------------------------------------------------------------


def in_train(entity):
    import hashlib

    return hashlib.md5(f"{entity}:1".encode()).hexdigest()[:8] < "cccccccc"


@pytest.mark.parametrize("as_table", [True, False])
def test_build_features(spark, hot_events, as_table):
    events, data = hot_events
    train = cohort.in_train()
    if as_table:
        train = events.select("entity_id").distinct().filter(train)
    groups, holders, seen = defaultdict(list), defaultdict(set), set()
    for entity, _, feature, value in data:
        if feature is not None:
            groups[entity, feature].append(value)
            holders[feature].add(entity)
            if in_train(entity):
                seen.add(feature)
    low = sorted(map(len, holders.values()))[20]
    built = features.build_features(events, ["mean", "max", "min", "count"], train, low)
    expected = {}
    for (entity, feature), values in groups.items():
        if feature in seen and len(holders[feature]) > low:
            known = [v for v in values if v is not None]
            expected[entity, feature] = (
                (sum(known) / len(known), max(known), min(known), len(known)) if known else (None, None, None, 0)
            )
    got = {(r.entity_id, r.feature): (r["mean"], r["max"], r["min"], r["count"]) for r in built.collect()}
    assert got.keys() == expected.keys() and 0 < len({f for _, f in got}) < len(holders)
    for key, values in expected.items():
        assert got[key] == pytest.approx(values) if values[0] is not None else got[key] == values


def test_threshold_is_strict(spark):
    rows_ = [(e, D(2000, 1, 1), f, 1.0) for f, n in (("a", 3), ("b", 4)) for e in range(n)]
    events = spark.createDataFrame(rows_, "entity_id long, date date, feature string, value double")
    assert {r.feature for r in features.popular_features(events, 3).collect()} == {"b"}


@pytest.mark.parametrize("family, raw", [("lab_features", "labs"), ("med_features", "meds"), ("diag_presence", "diagnoses")])
def test_one_scan_of_events(spark, monkeypatch, family, raw):
    """Broadcast off: raw rows are read, joined to the windows and grouped in one written fragment, without a
    shuffle between the join and the grouping; popularity and pruning read what was written."""
    from tidemark.catalog.queries import Tables
    from tidemark.session import stage

    fragments = []

    def noted(df, name, path=None):
        fragments.append(df._jdf.queryExecution().sparkPlan().toString())
        noted.exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(entity_id"))
        return stage(df, name, path)

    noted.exchanges = []
    tables = Tables(spark, SMALL)
    tables.period = stage(tables.period, "period")
    monkeypatch.setattr(features, "stage", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = getattr(tables, family)
        plans = [*fragments, built._jdf.queryExecution().sparkPlan().toString()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [p.count("lineitem.parquet") for p in plans] == [1, 0, 0]
    # events and windows meet by entity; the grouping by entity and feature adds no exchange
    assert noted.exchanges[0] == 2


def test_window_filter_splits_a_hot_entity_with_one_date(spark):
    """Two thirds of all rows are one entity's on one day: adaptive execution reads them in several tasks."""
    events = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("entity_id"),
        F.lit("2000-01-01").cast("date").alias("date"),
        F.concat(F.lit("code"), F.col("id")).alias("feature"),
    )
    window = spark.range(-1, 60_000).select(
        F.col("id").alias("entity_id"), F.lit("1999-01-01").cast("date").alias("earliest"), F.lit("2001-01-01").cast("date").alias("last")
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, setting in small.items():
        spark.conf.set(key, setting)
    try:
        kept = period.window_filter(events.repartition(6), window)
        assert kept.count() == 60_000
        kept.write.format("noop").mode("overwrite").save()
        frame = kept.select("*")
        frame.collect()
        assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small:
            spark.conf.unset(key)


def test_presence_equals_positive_count(spark, hot_events):
    events, _ = hot_events
    counts = features.build_features(events.filter("value IS NOT NULL"), ["count"])
    presence = features.build_presence(events)
    assert {(r.entity_id, r.feature) for r in presence.collect()} == {(r.entity_id, r.feature) for r in counts.collect()}


def test_train_rows_rule_and_long_form(spark):
    window = spark.createDataFrame([(e, D(2000, 1, 1), D(2000, 1, 31)) for e in range(40)], "entity_id long, earliest date, last date")
    data = [(e, D(2000, 1, 1 + e % 31), "x", float(e)) for e in range(40)] + [(3, D(2000, 1, 2), "y", 1.0), (4, D(2000, 1, 2), "y", None)]
    events = spark.createDataFrame(data, "entity_id long, date date, feature string, value double")
    n = sum(in_train(e) for e in range(40))
    long = features.process_family(events, window, ["mean", "sum"], n - 1, cohort.in_train())
    assert {r.feature for r in long.collect()} == {"x_0", "x_1"}
    assert features.process_family(events, window, ["mean"], n, cohort.in_train()).count() == 0


def test_max_scale(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (1, "z", 0.0), (2, "n", None)], "entity_id long, feature string, value double")
    assert rows(features.max_scale(long)) == [(1, "a", 0.5), (2, "a", 1.0)]


def test_matrices_and_lines(spark):
    long = spark.createDataFrame([(1, "b", 0.25), (1, "a", 1.0), (2, "b", 0.1234567)], "entity_id long, feature string, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "entity_id long, label int")
    codes = features.codemap(long)
    assert dict(codes.collect()) == {"a": 0, "b": 1}
    lines = dict(features.svmlight_lines(long, codes, labels).collect())
    assert lines == {1: "1 0:1.000000 1:0.250000 ", 2: "0 1:0.123457 "}
    tagged = dict(features.svmlight_lines(long, codes, labels, entity_prefix=True).collect())
    assert tagged[2] == "2 0 1:0.123457 "
    vector = dict(features.sparse_vectors(long, codes, 2).collect())
    assert list(vector[1].toArray()) == [1.0, 0.25] and vector[2].numNonzeros() == 1
    wide = features.feature_matrix([long], ["a", "b"]).orderBy("entity_id").collect()
    assert [tuple(r) for r in wide] == [(1, 1.0, 0.25), (2, 0.0, 0.1234567)]
    assert features.feature_matrix([long], None).columns == ["entity_id", "a", "b"]
    many = features.pivot_features(long.withColumnRenamed("value", "mean"), ["a", "b", *[f"f{i}" for i in range(10_000)]], ["mean"])
    assert len(many.columns) == 10_003
    with pytest.raises(Exception, match="not in the list: b"):
        features.feature_matrix([long], ["a"]).collect()
    cells = {tuple(r) for r in features.vector_cells(features.sparse_vectors(long, codes, 2)).collect()}
    assert cells == {(1, 0, 1.0), (1, 1, 0.25), (2, 1, 0.1234567)}


def test_code_groups(spark):
    events = spark.createDataFrame([(1, "ICD9_4661"), (2, "ICD9_4671"), (3, "DIAG_519"), (4, "ICD9_V460")], "entity_id long, feature string")
    assert {(r.entity_id, r.code_group) for r in cohort.code_group_events(events).collect()} == {(1, "acute"), (3, "other_respiratory")}


# --- cohorts -----------------------------------------------------------------------------------


def test_split_is_complete_and_stable(spark):
    ids = spark.range(2000).select(F.col("id").alias("entity_id"))
    for frame in (ids, ids.repartition(7)):
        train, test = cohort.train_test_split(frame)
        assert {r.entity_id for r in train.collect()} == {i for i in range(2000) if in_train(i)}
        assert train.count() + test.count() == 2000


def test_entity_sample(spark):
    ids = spark.range(500).select(F.col("id").alias("entity_id"))
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"{i}:9".encode()).hexdigest())
    assert {r.entity_id for r in cohort.entity_sample(ids, 123, seed=9).collect()} == set(order[:123])


# --- notes, text weights -----------------------------------------------------------------------


def test_last_note_ties_and_ids(spark):
    data = [(1, D(2000, 1, 2), "B b"), (1, D(2000, 1, 2), "c!"), (1, D(2000, 2, 1), "late"), (2, D(2000, 1, 1), "x")]
    table = spark.createDataFrame(data, "entity_id long, date date, text string")
    window = spark.createDataFrame([(e, D(2000, 1, 1), D(2000, 2, 1)) for e in (1, 2)], "entity_id long, earliest date, last date")
    only = spark.createDataFrame([(1,)], "entity_id long")
    assert rows(notes.last_note(table, window, only)) == [(1, D(2000, 1, 2), "c ")]
    assert rows(notes.last_note_for_tokenizer(table, window)) == [(1, D(2000, 1, 2), "c "), (2, D(2000, 1, 1), "x")]


def test_tfidf_against_formula(spark):
    docs = {1: "aa bb aa c", 2: "bb cc", 3: "dd dd dd ee", 4: "c d", 5: "aa ee"}
    df = spark.createDataFrame(list(docs.items()), "entity_id long, clean_text string")
    got = {(r.entity_id, r.feature): r.value for r in tfidf.tfidf(df, 3).collect()}
    words = {k: [w for w in v.split() if len(w) > 1] for k, v in docs.items()}
    total = Counter(w for ws in words.values() for w in ws)
    vocabulary = sorted(total, key=lambda w: (-total[w], w))[:3]
    expected = {}
    for k, ws in words.items():
        weights = {
            w: ws.count(w) * (math.log((1 + len(docs)) / (1 + sum(w in o for o in words.values()))) + 1)
            for w in vocabulary if w in ws
        }
        norm = math.sqrt(sum(x * x for x in weights.values()))
        expected |= {(k, f"TFIDF_{w}"): x / norm for w, x in weights.items()}
    assert got == pytest.approx(expected)


def test_tfidf_rows_have_unit_length(spark, tables):
    long = tfidf.tfidf(tables.documents, 50)
    lengths = long.groupBy("entity_id").agg(F.sum(F.col("value") * F.col("value")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert lengths[0] == pytest.approx(1) and lengths[1] == pytest.approx(1)


def test_hashing_tfidf_weights(spark):
    docs = [(i, ["aa", "bb"] if i % 2 else ["aa"]) for i in range(1, 9)]
    df = spark.createDataFrame(docs, "entity_id long, words array<string>")
    vector = {r.entity_id: r.features.toArray() for r in tfidf.hashing_tfidf(df).collect()}
    assert len(vector[1]) == 100
    assert sorted(v for v in vector[1] if v) == pytest.approx([math.log(9 / 5)])
    assert not vector[2].any()


# --- vectors -----------------------------------------------------------------------------------


def test_mean_pool_with_hot_entity_and_mask(spark):
    data = [(1, [float(i), 1.0], i % 2 == 0) for i in range(90)] + [(2, [3.0, 4.0], True)]
    df = spark.createDataFrame(data, "entity_id long, vec array<double>, keep boolean").repartition(5)
    assert {r.entity_id: r.vec for r in vectors.mean_pool(df).collect()} == {1: [44.5, 1.0], 2: [3.0, 4.0]}
    assert {r.entity_id: r.vec for r in vectors.mean_pool(df, mask="keep").collect()}[1] == [44.0, 1.0]


def test_embedding_store_encodes_only_new_entities(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "entity_id long, to_tok string")
    more = spark.createDataFrame([(1, "changed"), (2, "changed"), (3, "d")], "entity_id long, to_tok string")
    make = lambda: vectors.HashingEncoder(8)
    before = {r.entity_id: r.vec for r in vectors.update_embedding_store(first, path, make).collect()}
    after = {r.entity_id: r.vec for r in vectors.update_embedding_store(more, path, make, tasks=2).collect()}
    assert before.keys() == {1, 2} and after.keys() == {1, 2, 3}
    assert all(after[k] == before[k] for k in before)
    assert vectors.update_embedding_store(more, path, make).count() == 3


# --- evaluation --------------------------------------------------------------------------------


def brute_auc(pairs):
    pos = [s for s, label in pairs if label]
    neg = [s for s, label in pairs if not label]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_exact_with_ties(spark):
    data = [(c, (i * 7919 % 11) / 11 if i % 3 else 0.5, int(i * 31 % 7 < 3)) for c in "ab" for i in range(150)]
    df = spark.createDataFrame(data, "cohort string, score double, label int")
    got = {r.cohort: r.auc for r in evaluate.roc_auc(df, group=["cohort"]).collect()}
    assert got == pytest.approx({c: brute_auc([(s, y) for d, s, y in data if d == c]) for c in "ab"})
    flipped = evaluate.roc_auc(df.withColumn("score", 1 - F.col("score")), group=["cohort"]).collect()
    assert {r.cohort: 1 - r.auc for r in flipped} == pytest.approx(got)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert evaluate.roc_auc(df).first().auc is None


def test_presence_correlation_of_constant_is_null(spark):
    presence = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "entity_id long, a int, b int")
    outcomes = spark.createDataFrame([(2,)], "entity_id long")
    got = {(r.a, r.b): r.r for r in explore.presence_correlation(presence, outcomes).collect()}
    assert got["a", "b"] is None and got["b", "DECEASED"] == pytest.approx(1.0)


def test_microbiology_keeps_last(spark):
    data = [(1, 7, 9.0, "S", "2000-01-01"), (2, 7, 9.0, "R", "1999-01-01"), (3, 7, 9.0, "P", "2001-01-01"), (4, 8, None, "R", "2001-01-01")]
    df = spark.createDataFrame(data, "ROW_ID long, SUBJECT_ID long, AB_ITEMID double, INTERPRETATION string, CHARTTIME string")
    assert rows(normalize.microbiology(df)) == [(7, D(1999, 1, 1), "MB_9_R", 1.0)]


def test_labels_of_entities_without_notes_stay_out(spark):
    """What meets the texts is one row per entity with notes, however many entities are labelled."""
    held = notes.with_labels(spark.range(40).selectExpr("id % 4 AS entity_id", "id AS row_id", "'a' AS text"), spark.range(3000).selectExpr("id AS entity_id", "1 AS label"))
    assert held.count() == 40
    paths = [f for f in held.select("label").inputFiles() if "noted_labels" in f]
    assert paths and spark.read.parquet(*paths).count() == 4


def test_days_are_grouped_before_the_union(spark):
    """A union of tables that lie by one key is dealt as one task a part; grouped days are what it may bring together."""
    tables = [spark.range(20).selectExpr("id AS entity_id", f"date_add(DATE'2000-01-01', {i}) AS date") for i in range(3)]
    text = period.last_event_date(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Union") < text.index("Aggregate", text.index("Union"))
    assert {str(r.last_event) for r in period.last_event_date(*tables).collect()} == {"2000-01-03"}
