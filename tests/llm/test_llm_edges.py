"""Every operator and stage on odd rows: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, langid, licenses, mixing, pieces, secret_scan, simhash, spotsigs, toxicity, trie_dedup
from tidemark.llm.queries import PIECE_MODEL

LONG = " ".join(f"the word{i % 977} runs" for i in range(60_000)) + " " + "x" * 5000
ROWS = [
    (1, "Hello the World of one two three four five", "en", "a", 1),
    (2, "hello THE world of one two three four five", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "a text without any id is here for the test", "en", None, 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, "!!! ... 123   \U0001f600 á", "fr", "a", 9),
    (7, "Le chat est dans la maison avec les enfants", "fr", "c", 9),
    (7, "Le chat est dans la maison avec les enfants", "fr", "c", 9),
    (8, "   \t\n ", None, "c", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns with names that the operators use themselves
CLASHING = ["group_size", "size", "fingerprint", "score", "range", "closing", "features", "token_ids", "decoded", "_key", "_mix_id",
            "held_out", "probability", "word", "candidate", "taken", "rank", "fp", "id", "label", "_copy"]


def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return docs.withColumns({name: F.lit("clash") for name in CLASHING})


def none(spark):
    return odd(spark).filter("doc_id = -1")


@pytest.fixture(scope="module")
def table():
    return pieces.load(PIECE_MODEL)


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0), (7, 1), (99, 1)], "doc_id long, toxic int")


def no_labels(spark):
    return labels(spark).filter("doc_id = -1")


OPERATORS = {
    "spotsigs": lambda s, d, t: spotsigs.edit_probe(d),
    "spotsigs_pairs": lambda s, d, t: spotsigs.alike_classes(spotsigs.fingerprints(d))[0],
    "exact_dedup": lambda s, d, t: trie_dedup.copy_groups(d),
    "toxicity": lambda s, d, t: toxicity.score(d, toxicity.fit(d, labels(s))),
    "toxicity_no_labels": lambda s, d, t: toxicity.score(d, toxicity.fit(d, no_labels(s))),
    "licenses": lambda s, d, t: licenses.scan(d),
    "mixing": lambda s, d, t: mixing.mix(d),
    "pieces": lambda s, d, t: pieces.encoded_documents(d, t),
    "simhash": lambda s, d, t: simhash.near_groups(d),
    "simhash_wide": lambda s, d, t: simhash.near_groups(d, 5, 44, width=4),
    "language": lambda s, d, t: langid.predict(d, langid.fit(d)),
    "html": lambda s, d, t: html_text.extract(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, table, name):
    assert OPERATORS[name](spark, odd(spark), table).count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, table, name):
    assert OPERATORS[name](spark, none(spark), table).count() == 0


def test_secrets_of_odd_rows(spark):
    found = secret_scan.scan(odd(spark)).collect()
    assert {r.doc_id for r in found} == {5} and all(r.length == 5000 for r in found)
    assert secret_scan.scan(none(spark)).count() == 0


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES)
def test_stages_keep_columns(spark, name, function):
    docs = odd(spark).drop("token_ids")
    for rows in (docs, docs.filter("doc_id = -1")):
        out = function(spark, rows, "")
        assert out.columns[: len(rows.columns)] == rows.columns
        assert name == "tokens" or len(out.columns) == len(rows.columns)
        kept = out.count()
        assert kept == 0 if rows is not docs else kept > 0


def test_defined_results_for_null_and_empty(spark, table):
    docs = odd(spark).filter("doc_id in (3, 4)")
    assert {(r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()} == {("0" * 16, 3)}
    assert {(r.keep_id, r.group_size) for r in trie_dedup.copy_groups(docs).collect()} == {(4, 2)}
    assert {(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in licenses.scan(docs).collect()} == {(0, 0, None, "", 0.0)}
    assert {(r.size, r.taken) for r in mixing.mix(docs).collect()} == {(0, 0)}
    assert {(r.n_tokens, r.round_trip) for r in pieces.encoded_documents(docs, table).collect()} == {(0, True)}
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(odd(spark))).collect()} == {("und", 0.0)}
    assert {(r.fingerprint, r.near_next) for r in spotsigs.edit_probe(docs).collect()} == {("", 1.0)}


def test_a_null_id_is_below_all_others(spark):
    docs = spark.createDataFrame([(None, "same"), (None, "SAME"), (-5, "Same")], "doc_id long, text string")
    assert {(r.keep_id, r.group_size) for r in trie_dedup.copy_groups(docs).collect()} == {(-5, 3)}
    assert {r.component_id for r in simhash.near_groups(docs).collect()} == {-5}
