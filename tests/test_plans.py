"""Whole plans on the smallest data, and the shape of the physical plans."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.__main__ import main
from tidemark.catalog.queries import QUERIES, Tables
from tidemark.config import StudyParams
from tidemark.operators import features, model, vectors
from tidemark.plans import etl, modelling, raw
from tidemark.plans.scaled import ScaledFeatures
from tidemark.plans.records import restricted
from tidemark.session import stage, staging
from tidemark.sources import readers

from conftest import SMALL

LOW = dataclasses.replace(
    StudyParams(), diag_min=5, lab_min=5, med_min=5, microbiology_min=1, procedure_min=1, tfidf_terms=20
)


@pytest.fixture(scope="module")
def study(spark):
    tables = Tables(spark, SMALL)
    tables.params = LOW
    return tables


@pytest.fixture(scope="module")
def outputs(spark, study, tmp_path_factory):
    paths = etl.run(study, str(tmp_path_factory.mktemp("etl")))
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def test_etl_outputs(outputs, study):
    assert tuple(outputs) == etl.OUTPUTS
    assert all(df.count() > 0 for df in outputs.values())
    train, test = ({r.entity_id for r in outputs[n].collect()} for n in ("train_ids", "test_ids"))
    assert not train & test and len(train | test) == study.ids.count()


def test_features_were_seen_in_training(outputs):
    train = outputs["train_ids"]
    for family in ("diag_built", "labs_built", "meds_built"):
        built = outputs[family]
        seen = built.join(train, "entity_id", "left_semi").select("feature").distinct()
        assert built.join(seen, "feature", "left_anti").count() == 0


def test_clipped_rows_lie_in_their_window(study):
    inside = study.inside(study.labs).join(study.period, "entity_id")
    assert inside.count() > 0
    assert inside.filter((F.col("date") < F.col("earliest")) | (F.col("date") >= F.col("last"))).count() == 0


def test_table_shapes(study):
    def shape(schema):
        return [(f.name, f.dataType) for f in schema]

    for events in (study.diagnoses, study.labs, study.meds):
        assert shape(events.schema) == shape(schemas.EVENT)
    assert shape(study.period.schema) == shape(schemas.PERIOD)


def test_models_and_cohorts(spark, outputs, study, tmp_path):
    forest = model.random_forest(trees=5, depth=4)
    base = modelling.baseline_long(outputs["diag_built"], outputs["labs_built"], outputs["meds_built"])
    terms = modelling.tfidf_long(outputs["last_note"], LOW.tfidf_terms)
    embeds = modelling.embedding_long(outputs["last_note_tokenized"], str(tmp_path / "store"), lambda: vectors.HashingEncoder(8))
    fitted = {
        "Baseline": modelling.train_kind(study, "Baseline", base, classifier=forest),
        "TF_IDF": modelling.train_kind(study, "TF_IDF", base, terms, forest),
        "Embeddings": modelling.train_kind(study, "Embeddings", base, embeds, forest),
    }
    assert fitted["TF_IDF"].matrix.width > fitted["Baseline"].matrix.width
    for result in fitted.values():
        low, high, n = result.scores.agg(F.min("score"), F.max("score"), F.count("*")).first()
        assert 0 <= low <= high <= 1 and n > 0
    again = modelling.train_kind(study, "Baseline", base, classifier=forest)
    assert sorted(again.scores.collect()) == sorted(fitted["Baseline"].scores.collect())
    compared = modelling.compare(fitted, modelling.respiratory_entities(study)).collect()
    assert {r.model for r in compared} == set(fitted)
    assert all(r.auc is None or 0 <= r.auc <= 1 for r in compared)
    matrix, fit = fitted["Baseline"].matrix, fitted["Baseline"].model
    top = model.top_importances(fit, matrix.codes, 5).collect()
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True)
    _, scores, kept = model.select_and_retrain(matrix.rows, fit, matrix.width, forest, study.train, 20)
    assert len(kept) == 20 and scores.count() == fitted["Baseline"].scores.count()
    mean_kept = model.selected_features(fit, matrix.width)
    weights = fit.featureImportances.toArray()
    assert mean_kept == [i for i, w in enumerate(weights) if w >= weights.mean()]
    _, lr = model.fit_and_score(matrix.rows, model.logistic_regression(5), study.train)
    assert lr.count() > 0


def test_extra_block_is_required(study):
    base = study.lab_means
    with pytest.raises(ValueError):
        model.training_long("TF_IDF", base)
    with pytest.raises(NotImplementedError):
        model.training_long("Other", base)


def test_scaled_plan_writes_both_parts(spark, study, tmp_path):
    plan = ScaledFeatures(study)
    codes = plan.write(str(tmp_path))
    width = codes.count()
    for part in ("train", "test"):
        lines = readers.read_svmlight(spark, f"{tmp_path}/features.{part}")
        assert lines.count() > 0
        assert lines.agg(F.max(F.array_max("indices"))).first()[0] < width


def test_raw_folder_and_sample(spark, study, tmp_path):
    """Gzip extracts in a folder give the same features as the tables themselves; a sample narrows every table."""
    for name, file in raw.FILES.items():
        table = getattr(study.records, name, None)
        if table is not None and name in raw.SCHEMAS:
            columns = [f.name for f in raw.SCHEMAS[name]]
            full = table.select(*[F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns])
            options = {"header": True, "escape": '"', "compression": "gzip"}
            full.coalesce(1).write.options(**options).csv(str(tmp_path / file))
    loaded = etl.Study(raw.load_records(spark, str(tmp_path)), LOW)
    assert sorted(loaded.period.collect()) == sorted(study.period.collect())
    assert sorted(loaded.labs.collect(), key=str) == sorted(study.labs.collect(), key=str)
    sample = study.ids.filter("entity_id % 10 = 0")
    small = etl.Study(restricted(loaded.records, sample), LOW)
    wanted = {r.entity_id for r in sample.collect()}
    assert {r.entity_id for r in small.labs.collect()} <= wanted
    assert {r.SUBJECT_ID for r in small.records.notes.collect()} <= wanted
    assert small.labs.count() == study.labs.join(sample, "entity_id").count()
    out = str(tmp_path / "out")
    low = ["--diag-min", "5", "--lab-min", "5", "--med-min", "5"]
    main(["etl", "--input", str(tmp_path), "--output", out, "--sample", "100", *low])
    assert spark.read.parquet(f"{out}/sample_ids").count() == 100
    built = {name: spark.read.parquet(f"{out}/{name}") for name in etl.OUTPUTS}
    assert built["labs_built"].select("entity_id").distinct().count() <= 100 and built["labs_built"].count() > 0
    # the whole study on what was just written, with two encoders
    results = str(tmp_path / "results")
    encoders = ["--encoder", "a=tidemark.operators.vectors:HashingEncoder", "--encoder", "b=tidemark.operators.vectors:HashingEncoder"]
    main(["etl", "--input", str(tmp_path), "--output", out, *low])
    main(["model", "--input", str(tmp_path), "--output", results, "--features", out, "--trees", "5", "--depth", "4",
          "--select-features", "20", *encoders, *low])
    auc = {r.model: r.auc for r in spark.read.parquet(f"{results}/auc").collect()}
    kinds = ("Baseline", "TF_IDF", "Embeddings_a", "Embeddings_b")
    assert auc.keys() == {*kinds, *(f"{k}_logistic" for k in kinds), "Baseline_top", "Baseline_mean"}
    assert all(0 <= v <= 1 for v in auc.values()) and auc["Embeddings_a"] == auc["Embeddings_b"]
    assert {r.model for r in spark.read.parquet(f"{results}/cohort_auc").collect()} == auc.keys()
    assert spark.read.parquet(f"{results}/importances").filter("importance > 0").count() > 0


@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("name", ["lab_features", "tfidf_topk", "codemap", "cohort_auc", "svmlight_lines"])
def test_partitioning_does_not_change_results(spark, name, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(str, QUERIES[name](spark, SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == sorted(map(str, QUERIES[name](spark, SMALL).collect()))


def test_staged_data_goes_with_its_block(spark, study):
    import os

    with staging(spark) as scope:
        kept = stage(study.ids, "ids")
        assert kept.count() > 0 and os.path.isdir(scope.removeprefix("file:"))
    assert not os.path.exists(scope.removeprefix("file:"))


def test_windows_move_neither_codes_nor_twice(spark, study):
    """The window plan shuffles diagnoses by admission only, without their codes, and windows are made once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = study.period_as()._jdf.queryExecution().executedPlan().toString()
        dated = study.diagnoses._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ICD9" not in plan and "l_suppkey" not in plan
    # lineitem and orders by order, and the admissions to meet them
    assert dated.count("Exchange hashpartitioning") == 3, dated
    tables = Tables(spark, SMALL)
    assert tables.period is tables.period and len(tables.period.inputFiles()) > 0


def test_clipped_events_are_made_once(spark, study):
    """What asks which features training has does not compute the events a second time."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i % 9, f"F{i % 4}", 1.0) for i in range(90)], 3).map(lambda r: seen.add(1) or r)
    events = spark.createDataFrame(rows, "entity_id long, feature string, value double")
    assert features.train_features_only(events, F.col("entity_id") < 5).count() == 90 and seen.value == 90


MODELS = {
    "rf_scores", "lr_scores", "model_roundtrip", "model_score_rows", "feature_importance", "importance_check",
    "select_and_retrain", "select_by_mean_importance",
}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - MODELS))
def test_plan_shape(spark, name):
    """No cross join, no unpartitioned window, Python only where an encoder or a vector needs it."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ("embed_text", "embed_windows"):
        assert "EvalPython" not in plan and "MapInPandas" not in plan


def test_scaled_families_equal_scaling_the_union(study):
    """Scaling where popularity is counted gives the rows and training names of the general operators."""
    plan = ScaledFeatures(study)
    scaled = features.max_scale(plan.combined())
    assert sorted(plan.scaled().collect()) == sorted(scaled.collect())
    assert sorted(plan.training_codes().collect()) == sorted(features.codemap(scaled.filter(study.train)).collect())


def test_lines_are_gathered_once(study):
    """One gathering of cells makes the lines of both parts; the scaled rows are not written for it."""
    plan = ScaledFeatures(study)
    text = plan.lines(plan.training_codes())._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("collect_list(") == 1
