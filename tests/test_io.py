"""Sources and sinks: what is written comes back."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.session import shared_dir, stage
from tidemark.sources import readers, writers


def test_gzip_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    df.coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "x"))
    back = readers.read_csv(spark, str(tmp_path / "x"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    inferred = readers.read_csv(spark, str(tmp_path / "x"))
    assert dict(inferred.dtypes)["id"] == "int"
    writers.write_parquet(back, str(tmp_path / "p"), files=3)
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())


def test_csv_with_newlines_quotes_and_blanks(spark, tmp_path):
    texts = ['line\nbreak "quoted", comma', "  blanks kept  ", "back\\slash", "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    writers.write_csv(df, str(tmp_path / "notes"))
    back = readers.read_csv(spark, str(tmp_path / "notes"), df.schema, multi_line=True)
    assert sorted(back.collect()) == sorted(df.collect())


def test_json_families_and_frozen_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "2000-01-01")], "entity_id long, d string").withColumn("d", F.to_date("d"))
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == df.collect()
    assert writers.freeze_ids(df.select("entity_id"), str(tmp_path / "ids")).collect() == [(1,)]
    writers.write_feature_families({"a": df, "b": df}, str(tmp_path / "m"))
    assert {r.family for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"a", "b"}


@pytest.mark.parametrize("base", [0, 1])
def test_svmlight_round_trip(spark, tmp_path, base):
    long = spark.createDataFrame([(1, "b", 0.25), (1, "a", 1.0), (2, "c", 0.5)], "entity_id long, feature string, value double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "entity_id long, label int")
    path = str(tmp_path / "svm")
    writers.write_svmlight(features.svmlight_lines(long, features.codemap(long), labels, index_base=base), path)
    cells = {r.label: (r["indices"], r["values"]) for r in readers.read_svmlight(spark, path, zero_based=base == 0).collect()}
    assert cells == {1.0: ([0, 1], [1.0, 0.25]), 0.0: ([2], [0.5])}
    if base == 1:
        vectors = {r.label: r.features for r in readers.read_libsvm(spark, path, 3).collect()}
        assert list(vectors[1.0].toArray()) == [1.0, 0.25, 0.0]


def test_svmlight_with_entity(spark, tmp_path):
    long = spark.createDataFrame([(7, "a", 1.0)], "entity_id long, feature string, value double")
    labels = spark.createDataFrame([(7, 1)], "entity_id long, label int")
    path = str(tmp_path / "svm")
    writers.write_svmlight(features.svmlight_lines(long, features.codemap(long), labels, entity_prefix=True), path)
    assert readers.read_svmlight(spark, path, entity_prefix=True).collect() == [(7, 1.0, [0], [1.0])]


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(3).toDF("id"), "numbers")
    assert sorted(df.collect()) == [(0,), (1,), (2,)]
    assert shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]


def test_embedding_reader_of_missing_store(spark, tmp_path):
    assert writers.embeddings_or_empty(spark, str(tmp_path / "none")).count() == 0


def test_misfits_and_reordered_columns(spark, tmp_path):
    """An unreadable field is null and its line is kept aside; columns in another order are an error."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a int, b string")
    path = str(tmp_path / "t.csv")
    with open(path, "w") as file:
        file.write("a,b\n1,x\ntwo,y\n")
    got = readers.read_csv(spark, path, readers.with_corrupt_column(schema)).collect()
    assert [(r.a, r.b, r[readers.CORRUPT]) for r in got] == [(1, "x", None), (None, "y", "two,y")]
    with open(path, "w") as file:
        file.write("b,a\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, path, schema).collect()
