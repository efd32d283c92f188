import pytest
from pyspark.sql import functions as F

from tidemark.config import ENGLISH_STOP_WORDS
from tidemark.functions import dates, numbers
from tidemark.functions import text as tx

DOSES = {
    "6-12": 9.0,
    "2,500 units": 2500.0,
    "<0.25": 0.25,
    "  > 4": 4.0,
    "8": 8.0,
    ".75": 0.75,
    None: 0.0,
    "3-": None,
    "-1-4": None,
    "1.5/2": None,
    "20%": None,
    "ten": None,
    "as needed": None,
    "~ 7": None,
    "": None,
}

#: text: (cleaned, distinct words without numbers and stop words, ready for a tokenizer)
TEXTS = {
    "Hello,  World_1 (a b2)\nnext line\r\nlast": (
        "hello world 1 a b2 next line last", ["hello", "world", "next", "line", "last"], "Hello, World 1 (a b2). next line. last"),
    "\u00c9a_u \u00e7\u00e0 12 x \u00c9": ("\u00e9a u \u00e7\u00e0 12 x \u00e9", ["\u00e9a", "\u00e7\u00e0", "\u00e9"], "\u00c9a u \u00e7\u00e0 12 x \u00c9"),
    "": ("", [], ""),
    "one\n": ("one ", ["one"], "one"),
    "one\r\n": ("one ", ["one"], "one"),
    "one\n\n": ("one ", ["one"], "one. "),
    "[**Name**] # 3: yes! no?  . . end ..": (" name 3 yes no end ", ["name", "yes", "end"], " Name 3 yes no. end."),
    "tabs\tand\x0bvertical breaks": ("tabs and vertical breaks", ["tabs", "vertical", "breaks"], "tabs\tand. vertical breaks"),
    "...a . . .b . ": (" a b ", [], ".a.b. "),
}


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_mean_dose(spark):
    assert column(spark, list(DOSES), numbers.mean_dose) == list(DOSES.values())


def test_number_or_null(spark):
    given = {" 5 ": 5.0, "1e3": 1000.0, "-2.5": -2.5, "not done": None, "nan": None, "inf": None, "5d": None, "": None, None: None}
    assert column(spark, list(given), numbers.number_or_null) == list(given.values())


@pytest.mark.parametrize("text", TEXTS)
def test_cleaned_forms(spark, text):
    cleaned, words, sentences = TEXTS[text]
    assert column(spark, [text], tx.clean_text) == [cleaned]
    assert column(spark, [text], lambda c: tx.clean_tokens(c, ENGLISH_STOP_WORDS)) == [words]
    assert column(spark, [text], tx.tokenizer_text) == [sentences]


def test_a_bad_date_is_null(spark):
    df = spark.createDataFrame([("2101-10-20",), ("2101-1x-20",), ("",), (None,)], "a string")
    assert [str(r[0]) for r in df.select(dates.day(df, "a")).collect()] == ["2101-10-20", "None", "None", "None"]


def test_sections(spark):
    text = "Past History: none. Family history: long"
    assert column(spark, [text, "nothing"], lambda c: tx.section_after_first(c, "history")) == [
        "  none  family history  long",
        "none",
    ]
    assert column(spark, [text, "Nothing"], lambda c: tx.section_after_last(c, "history")) == [": long", "nothing"]


def test_regex_tokens(spark):
    assert column(spark, ["Ab, c_1 É!"], tx.regex_retokenised) == ["ab c_1"]


def test_day_of_text_and_timestamp(spark):
    df = spark.sql("SELECT '2101-10-20 19:08:00' AS a, TIMESTAMP_NTZ '2101-10-20 23:59:59' AS b, DATE '2101-10-20' AS c")
    row = df.select(dates.day(df, "a"), dates.day(df, "b"), dates.day(df, "c")).first()
    assert row[0] == row[1] == row[2]


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert set(ENGLISH_STOP_WORDS) == set(StopWordsRemover.loadDefaultStopWords("english"))
