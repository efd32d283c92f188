"""Registered queries: each operator run over the whole test tables.

Doubles are rounded to six decimals, since sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DATE, ENGLISH_STOP_WORDS, ENTITY, FEATURE, VALUE, StudyParams
from ..functions import numbers
from ..functions import text as tx
from ..operators import cohort, compare, evaluate, explore, features, model, normalize, notes, period, tfidf, vectors
from ..plans import modelling, raw
from ..plans.records import Records, Study
from ..plans.scaled import ScaledFeatures
from ..session import fresh_path, side_by_side, stage, tune
from ..sources import readers, writers
from ..sources.embedding_store import EmbeddingStore
from ..sources.fixtures import Fixtures

PARAMS = StudyParams()
CATEGORIES = ["Discharge summary", "Nursing", "Radiology", "ECG"]
LAB_ITEMS = [f"LAB_{50800 + i}" for i in range(40)]
MICROBIOLOGY_ITEMS = [f"MB_{90000 + i}_{letter}" for i in range(12) for letter in "IRS"]
KEYWORDS = ["deceased", "history ", "the", "de "]
SECTION_TERM = "the"
VECTOR_WIDTH = 64
ENCODER_WIDTH = 32
ENCODER_TASKS = 32
WINDOW, WINDOW_STEP = 40, 30
BUCKETS = 16
# codes of different lengths, a longer one inside a shorter one's range among them
MIXED_GROUPS = {
    "respiratory": ["46", "47", "48"],
    "pneumonia": [480, 481, 482],
    "viral": ["4800", "4801"],
    "long": ["48201", "E8051"],
    "external": ["E80"],
    "transport": ["E800", "E801", "E802"],
    "status": ["V1", "V20"],
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables(Study):
    """The study's shared tables over the fixture views, plus the views themselves."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.views = tune(spark), Fixtures(spark, folder)
        super().__init__(self.views, PARAMS)

    def path(self, name: str) -> str:
        return fresh_path(self.spark, name)

    @cached_property
    def period(self) -> DataFrame:
        """The windows, written once: a query may filter several families, or one more than once."""
        return stage(self.period_as(), "period")

    @property
    def ids(self) -> DataFrame:
        return self.views.patients.select(F.col("SUBJECT_ID").alias(ENTITY))

    @property
    def notes(self) -> DataFrame:
        return normalize.notes(self.note_scan)

    @property
    def note_scan(self) -> DataFrame:
        return self.views.notes

    @property
    def documents(self) -> DataFrame:
        """Every note as a document of its own."""
        return self.notes.withColumn(ENTITY, F.col("row_id"))

    @property
    def token_vectors(self) -> DataFrame:
        return self.views.token_vectors.select(
            F.col("SUBJECT_ID").alias(ENTITY), F.col("ARRIVAL").alias("arrival"), F.col("VEC").alias("vec")
        )

    @property
    def scores(self) -> DataFrame:
        return self.views.scores.select(
            F.col("SUBJECT_ID").alias(ENTITY),
            F.col("LABEL").alias("label"),
            F.col("SCORE_A").alias("score_a"),
            F.col("SCORE_B").alias("score_b"),
        )

    @property
    def respiratory_scores(self) -> DataFrame:
        flags = cohort.labels(self.scores.select(ENTITY), modelling.respiratory_entities(self))
        return self.scores.join(flags.withColumnRenamed("label", "respiratory"), ENTITY)

    @property
    def coded_diagnoses(self) -> DataFrame:
        return normalize.drop_null_keys(self.diagnoses)

    @property
    def lab_features(self) -> DataFrame:
        return features.build_features(self.inside(self.labs), ["mean", "max", "min"], self.train, PARAMS.lab_min)

    @property
    def med_features(self) -> DataFrame:
        return features.build_features(self.inside(self.meds), ["mean", "count"], self.train, PARAMS.med_min)

    @property
    def diag_presence(self) -> DataFrame:
        return features.build_presence(self.inside(self.diagnoses), self.train, PARAMS.diag_min)

    @property
    def baseline(self) -> DataFrame:
        """All structured features; the windows are written once for the three families."""
        _ = self.period  # written before the families, which all read it
        kinds = ("diag_presence", "lab_features", "med_features")
        return modelling.baseline_long(*side_by_side([partial(getattr, self, kind) for kind in kinds]))

    @property
    def microbiology_long(self) -> DataFrame:
        return normalize.microbiology(self.views.microbiology).select(ENTITY, FEATURE, VALUE)

    @property
    def lab_means(self) -> DataFrame:
        return self.lab_features.select(ENTITY, FEATURE, F.col("mean").alias(VALUE))


def query(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of the tables under its own name."""
    QUERIES[run.__name__] = lambda spark, folder: run(Tables(spark, folder))
    return run


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 6).alias(alias or name)


def rounded_events(df: DataFrame) -> DataFrame:
    return df.select(ENTITY, DATE, FEATURE, r6(VALUE))


def rounded_long(df: DataFrame) -> DataFrame:
    return df.select(ENTITY, FEATURE, r6(VALUE))


# --- scans, sources, sinks ---------------------------------------------------------------------


@query
def src_csv_gz(t):
    path = t.path("labevents")
    t.views.labevents.write.option("header", True).option("compression", "gzip").csv(path)
    schema = "SUBJECT_ID BIGINT, HADM_ID BIGINT, ITEMID BIGINT, VALUE STRING, VALUENUM DOUBLE, CHARTTIME STRING"
    return rounded_events(normalize.labs(readers.read_csv(t.spark, path, schema)))


@query
def src_csv_multiline(t):
    path = t.path("notes")
    writers.write_csv(t.views.notes.select("ROW_ID", "SUBJECT_ID", "HADM_ID", "TEXT"), path)
    schema = "ROW_ID BIGINT, SUBJECT_ID BIGINT, HADM_ID BIGINT, TEXT STRING"
    complete = normalize.drop_any_null(readers.read_csv(t.spark, path, schema, multi_line=True))
    return complete.select("ROW_ID", "SUBJECT_ID", "TEXT")


@query
def scan_for_entities(t):
    deceased = t.outcomes.select(F.col(ENTITY).alias("SUBJECT_ID"))
    rows = readers.for_entities(t.views.labevents, deceased, spread_by=["CHARTTIME"])
    return rows.select("SUBJECT_ID", "ITEMID", "VALUENUM", F.col("CHARTTIME").cast("date").alias("CHARTDATE"))


@query
def scan_columns(t):
    return readers.read_columns(t.views.patients, ["SUBJECT_ID", "EXPIRE_FLAG"])


@query
def scan_limit(t):
    return readers.first_rows(t.views.notes.select("ROW_ID", "SUBJECT_ID", "CATEGORY"), ["ROW_ID"], 100)


@query
def sink_json(t):
    path = t.path("deceased_to_date")
    writers.write_json(t.outcomes, path)
    return t.spark.read.schema(t.outcomes.schema).json(path)


@query
def sink_csv(t):
    path = t.path("meds_built")
    built = t.med_features.select(ENTITY, FEATURE, r6("mean", "value_mean"), F.col("count").alias("value_count"))
    writers.write_csv(built, path)
    return readers.read_csv(t.spark, path, built.schema)


@query
def sink_feature_matrix(t):
    base = t.path("matrix")
    writers.write_feature_families({"lab": rounded_long(t.lab_means), "diagnosis": rounded_long(t.diag_presence)}, base)
    return t.spark.read.parquet(base).select("family", ENTITY, FEATURE, VALUE)


@query
def cohort_freeze(t):
    return writers.freeze_ids(cohort.entity_sample(t.ids, 1000, PARAMS.seed), t.path("sample_ids"))


@query
def checkpoint(t):
    return stage(rounded_events(t.inside(t.labs)), "labs_in_window")


def _svmlight(t, **form) -> tuple[DataFrame, int]:
    """Lines with their part, and the width of the matrix; ids come from training features."""
    plan = ScaledFeatures(t)
    codes = plan.training_codes()
    return plan.lines(codes, **form), codes.count()


def _both_parts(parts: dict[str, DataFrame]) -> DataFrame:
    return normalize.union_all(*[rows.withColumn("part", F.lit(name)) for name, rows in parts.items()])


@query
def svmlight_lines(t):
    return _svmlight(t)[0]


@query
def svmlight_lines_with_id(t):
    return _svmlight(t, entity_prefix=True)[0]


@query
def svmlight_read(t):
    """Both parts written with ids from one and read again with the declared width; the reader may drop stored zeros."""
    lines, width = _svmlight(t, index_base=1)
    lines, back = stage(lines, "lines"), {}
    for name in ("train", "test"):
        path = t.path(f"features.{name}")
        writers.write_svmlight(lines.filter(F.col("part") == name), path)
        back[name] = features.vector_cells(readers.read_libsvm(t.spark, path, width))
    return _both_parts(back).filter(F.col(VALUE) != 0).groupBy("part", "label", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(VALUE), 6).alias("total")
    )


@query
def embedding_store_incremental(t):
    path = t.path("embeddings")
    first = vectors.mean_pool(t.token_vectors.filter(F.col("arrival") == 0))
    writers.append_embeddings(first, path)
    writers.append_embeddings(vectors.mean_pool(t.token_vectors), path)
    stored = writers.embeddings_or_empty(t.spark, path)
    return stored.select(ENTITY, F.posexplode("vec").alias("pos", VALUE)).select(ENTITY, "pos", r6(VALUE))


class ClusteredTables(Tables):
    """The same study over its raw tables written bucketed and sorted by entity."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        base, views = self.path("clustered"), self.views
        tables = {n: getattr(views, n) for n in ("patients", "admissions", "diagnoses", "labevents", "prescriptions")}
        raw.cluster(Records(**tables), base, BUCKETS)
        self.records = raw.load_clustered(spark, base)


def clustered_query(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[run.__name__] = lambda spark, folder: run(ClusteredTables(spark, folder))
    return run


@clustered_query
def clustered_lab_features(t):
    return lab_features(t)


@clustered_query
def clustered_med_features(t):
    return med_features(t)


@clustered_query
def clustered_diag_presence(t):
    return diag_presence(t)


@clustered_query
def clustered_window_filter(t):
    return window_filter(t)


@query
def misfit_quarantine(t):
    """Lab results with their text as the number: lines that do not read go aside, and all three counts are reported."""
    path, schema = t.path("labevents"), readers.with_corrupt_column(raw.T.StructType.fromDDL("SUBJECT_ID BIGINT, ITEMID BIGINT, VALUENUM DOUBLE"))
    t.views.labevents.select("SUBJECT_ID", "ITEMID", F.col("VALUE").alias("VALUENUM")).write.option("header", True).csv(path)
    rows, plain = readers.read_csv(t.spark, path, schema), raw.T.StructType(schema.fields[:-1])
    clean, rejected = t.path("clean"), t.path("rejected")
    raw.quarantine(rows, plain, "labevents", clean, rejected)
    kept = t.spark.read.schema(plain).parquet(clean).select(F.lit("clean").alias("kind"), F.col("ITEMID").cast("string").alias("what"))
    gone = t.spark.read.parquet(rejected).select(F.lit("rejected").alias("kind"), F.concat_ws(": ", "field", "reason").alias("what"))
    return kept.unionByName(gone).groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))


@query
def embedding_store_arrivals(t):
    """Three arrivals of notes: some, then all with some texts changed, then the same again, which adds nothing."""
    store = EmbeddingStore(t.spark, t.path("store"))
    make = partial(vectors.HashingEncoder, ENCODER_WIDTH)
    docs = t.documents.select(ENTITY, F.col("text").alias("to_tok"))
    first = docs.filter(F.col(ENTITY) % 3 != 0)
    changed = docs.withColumn("to_tok", F.when(F.col(ENTITY) % 5 == 0, F.concat(F.lit("again "), "to_tok")).otherwise(F.col("to_tok")))
    added = [store.update(arrival, make, "hashing", tasks=ENCODER_TASKS) for arrival in (first, changed, changed)]
    counted = store.read().groupBy(ENTITY, "digest", "encoder").agg(F.count(F.lit(1)).alias("copies"), F.max(F.size("vec")).alias("width"))
    return counted.withColumn("added_last", F.lit(added[-1]))


# --- projections, filters ----------------------------------------------------------------------


@query
def outcome_dates(t):
    return t.outcomes


@query
def drop_null_keys(t):
    return normalize.drop_null_keys(t.views.prescriptions, ["ENDDATE", "GSN"]).select(
        "SUBJECT_ID", "HADM_ID", "GSN", F.col("ENDDATE").cast("date").alias("ENDDATE")
    )


@query
def dropna_any(t):
    return normalize.drop_any_null(t.views.microbiology)


@query
def fillna_zero(t):
    filled = normalize.fill_null(t.views.labevents, 0.0, ["VALUENUM"])
    return filled.select("SUBJECT_ID", "ITEMID", "VALUENUM")


@query
def mb_events(t):
    return rounded_events(normalize.microbiology(t.views.microbiology))


@query
def membership_semi_anti(t):
    known = cohort.members(t.labs, t.outcomes, [DATE]).withColumn("side", F.lit("deceased"))
    other = cohort.non_members(t.labs, t.outcomes, [DATE]).withColumn("side", F.lit("alive"))
    return known.unionByName(other).groupBy("side", FEATURE).agg(F.count(F.lit(1)).alias("n"))


@query
def window_filter(t):
    return rounded_events(t.inside(t.labs))


@query
def window_filter_closed(t):
    return rounded_events(t.inside(t.labs, "closed"))


@query
def window_filter_open(t):
    return rounded_events(t.inside(t.coded_diagnoses, "open"))


@query
def code_group_events(t):
    return cohort.code_group_events(t.inside(t.coded_diagnoses, "open")).select(ENTITY, DATE, FEATURE, "code_group")


@query
def code_groups_any_length(t):
    return cohort.code_group_events(t.coded_diagnoses, MIXED_GROUPS).select(ENTITY, DATE, FEATURE, "code_group")


@query
def code_group_entities(t):
    return modelling.respiratory_entities(t)


@query
def keyword_counts(t):
    return notes.keyword_counts(t.notes, KEYWORDS)


@query
def numeric_only(t):
    return normalize.numeric_only(t.views.labevents, "VALUE").select("SUBJECT_ID", "ITEMID", "VALUE")


@query
def notes_by_category(t):
    everyone = notes.by_category(t.notes, CATEGORIES[0]).withColumn("who", F.lit("all"))
    deceased = notes.by_category(t.notes, CATEGORIES[0], t.outcomes).withColumn("who", F.lit("deceased"))
    return everyone.unionByName(deceased).select("who", "row_id", ENTITY, DATE)


# --- normalisers -------------------------------------------------------------------------------


@query
def norm_diagnoses(t):
    return rounded_events(t.coded_diagnoses)


@query
def norm_labs(t):
    return rounded_events(t.labs)


@query
def norm_meds(t):
    return rounded_events(normalize.drop_null_keys(t.meds))


@query
def norm_diag_rollup(t):
    return rounded_events(normalize.rolled_up_diagnoses(t.views.diagnoses, t.views.admissions))


@query
def norm_labs_text(t):
    return rounded_events(normalize.labs_from_text(t.views.labevents))


@query
def norm_admissions(t):
    return rounded_events(normalize.admissions(t.views.admissions))


@query
def norm_procedures(t):
    return rounded_events(normalize.procedures(t.views.procedure_orders))


@query
def norm_notes(t):
    return t.notes.select("row_id", ENTITY, DATE, "category", "clean_text")


# --- joins -------------------------------------------------------------------------------------


@query
def join_inner_single(t):
    joined = normalize.join_admission_date(t.views.diagnoses, t.views.admissions)
    return joined.select("SUBJECT_ID", "HADM_ID", "ICD9_CODE", F.col("ADMITTIME").cast("date").alias("ADMITDATE"))


@query
def train_features_only(t):
    return rounded_events(features.train_features_only(t.inside(t.coded_diagnoses), t.train))


@query
def popular_features(t):
    return features.popular_features(t.inside(t.coded_diagnoses), PARAMS.diag_min, t.train)


@query
def train_period(t):
    return t.period


@query
def feature_matrix_outer(t):
    labs = t.lab_means
    matrix = features.feature_matrix([labs, t.microbiology_long], LAB_ITEMS + MICROBIOLOGY_ITEMS)
    return matrix.select(ENTITY, *[r6(c) for c in LAB_ITEMS + MICROBIOLOGY_ITEMS])


@query
def feature_matrix_left(t):
    labs = features.feature_matrix([t.lab_means], LAB_ITEMS)
    extra = features.feature_matrix([t.microbiology_long], MICROBIOLOGY_ITEMS)
    matrix = features.join_left_features(labs, extra)
    return matrix.select(ENTITY, *[r6(c) for c in LAB_ITEMS + MICROBIOLOGY_ITEMS])


@query
def max_scale(t):
    return rounded_long(ScaledFeatures(t).scaled())


@query
def note_labels(t):
    known = cohort.labels(t.ids, t.outcomes)
    labelled = notes.with_labels(t.notes.select(ENTITY, "row_id", DATE, "text"), known)
    words = tx.clean_tokens(tx.section_after_first(F.col("text"), SECTION_TERM), ENGLISH_STOP_WORDS)
    return labelled.select("row_id", "label", F.concat_ws(" ", words).alias("words"))


@query
def index_date(t):
    return ScaledFeatures(t).index


# --- aggregations ------------------------------------------------------------------------------


@query
def last_event_date(t):
    return period.last_event_date(t.diagnoses, t.labs, t.meds)


@query
def diag_presence(t):
    return t.diag_presence.select(ENTITY, FEATURE)


@query
def diag_count(t):
    built = features.build_features(t.inside(t.diagnoses), ["count"], t.train, PARAMS.diag_min)
    return built.select(ENTITY, FEATURE, F.col("count").alias("value_count"))


@query
def lab_features(t):
    return t.lab_features.select(
        ENTITY, FEATURE, r6("mean", "value_mean"), r6("max", "value_max"), r6("min", "value_min")
    )


@query
def med_features(t):
    return t.med_features.select(ENTITY, FEATURE, r6("mean", "value_mean"), F.col("count").alias("value_count"))


@query
def popular_features_train_rows(t):
    plan = ScaledFeatures(t)
    inside = period.window_filter(plan.families["lab"], plan.period, "closed")
    return features.popular_features_by_train_rows(inside, PARAMS.lab_min, t.train)


@query
def multi_agg_long(t):
    functions = ["mean", "max", "min"]
    built = features.build_features(t.inside(t.labs), functions)
    return rounded_long(features.to_long(built, functions))


@query
def process_family(t):
    return rounded_long(ScaledFeatures(t).combined())


@query
def value_counts(t):
    return explore.value_counts(t.notes, "category")


@query
def cohort_label_counts(t):
    return explore.value_counts(t.respiratory_scores, "respiratory", "label")


@query
def category_presence(t):
    wide = explore.category_presence(t.notes, CATEGORIES)
    return wide.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in CATEGORIES})


@query
def category_prevalence(t):
    wide = explore.category_presence(t.notes, CATEGORIES)
    return explore.category_prevalence(wide).select("category", r6("share"))


@query
def presence_corr(t):
    wide = explore.category_presence(t.notes, CATEGORIES)
    return explore.presence_correlation(wide, t.outcomes).select("a", "b", r6("r"))


@query
def presence_gram(t):
    return explore.flag_correlation(t.diag_presence, t.ids).select("a", "b", "n", r6("r"))


@query
def uniqueness_check(t):
    return explore.uniqueness(t.views.patients, "SUBJECT_ID")


@query
def pruning_report(t):
    return features.pruning_report(t.inside(t.coded_diagnoses), PARAMS.diag_min, t.train)


@query
def embedding_mean_pool(t):
    return vectors.mean_by_position(t.token_vectors).select(ENTITY, "pos", r6("mean"))


# --- windows, sampling, ids --------------------------------------------------------------------


@query
def last_note(t):
    return notes.last_note(t.notes, t.period, t.ids)


@query
def last_note_tokenized(t):
    return notes.last_note_for_tokenizer(t.notes, t.period, t.ids)


@query
def notes_per_day(t):
    return notes.one_per_day(t.notes, CATEGORIES[0])


@query
def codemap(t):
    return features.codemap(t.inside(t.coded_diagnoses).filter(t.train))


@query
def entity_sample(t):
    return cohort.entity_sample(t.ids, 1000, PARAMS.seed)


@query
def train_test_split(t):
    train, test = cohort.train_test_split(t.ids, PARAMS.train_fraction, PARAMS.seed)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# --- set operations, reshape -------------------------------------------------------------------


@query
def all_features_long(t):
    return rounded_events(ScaledFeatures(t).all_features)


@query
def period_parity(t):
    return period.period_parity(t.period, t.period_as(anchor="last_event", keep_without_events=False))


@query
def multiset_difference(t):
    half, closed = (rounded_events(t.inside(t.labs, bounds)) for bounds in ("half_open", "closed"))
    return compare.multiset_difference(half.drop(FEATURE), closed.drop(FEATURE))


@query
def frame_parity(t):
    """Labs as numbers against labs as text: other values and fewer rows, of the same items on the same days."""
    left = rounded_events(t.labs)
    right = rounded_events(normalize.labs_from_text(t.views.labevents)).withColumn(VALUE, F.col(VALUE) + (F.col(ENTITY) % 7 == 0).cast("int"))
    return compare.frame_parity(left, right, [ENTITY])


@query
def pivot_features(t):
    wide = features.pivot_features(t.lab_features, LAB_ITEMS, ["mean", "max", "min"])
    return wide.select(ENTITY, *[r6(c) for c in wide.columns if c != ENTITY])


@query
def sparse_matrix(t):
    matrix = model.training_matrix(t.baseline, t.outcomes)
    return _vector_cells(matrix.rows.drop("label"))


def _vector_cells(rows: DataFrame) -> DataFrame:
    """Stored cells of a vector column as rows."""
    return features.vector_cells(rows).filter(F.col(VALUE) != 0).withColumn(VALUE, F.round(VALUE, 6))


@query
def embedding_columns(t):
    wide = features.wide_columns(vectors.mean_pool(t.token_vectors), VECTOR_WIDTH, "EMBED_")
    return wide.select(ENTITY, *[r6(f"EMBED_{i}") for i in range(VECTOR_WIDTH)])


# --- scalar and text functions -----------------------------------------------------------------


@query
def mean_dose(t):
    return t.views.prescriptions.select(
        "SUBJECT_ID", "HADM_ID", "DOSE_VAL_RX", F.round(numbers.mean_dose(F.col("DOSE_VAL_RX")), 6).alias("dose")
    )


def _per_note(t, name: str, column: Column) -> DataFrame:
    return t.note_scan.select("ROW_ID", column.alias(name))


@query
def clean_text(t):
    return _per_note(t, "clean_text", tx.clean_text(F.col("TEXT")))


@query
def clean_tokens(t):
    return _per_note(t, "tokens", F.concat_ws(" ", tx.clean_tokens(F.col("TEXT"), ENGLISH_STOP_WORDS)))


@query
def tokenizer_text(t):
    return _per_note(t, "to_tok", tx.tokenizer_text(F.col("TEXT")))


@query
def section_after_first(t):
    return _per_note(t, "section", tx.section_after_first(F.col("TEXT"), SECTION_TERM))


@query
def section_after_last(t):
    return _per_note(t, "section", tx.section_after_last(tx.tokenizer_text(F.col("TEXT")), SECTION_TERM))


@query
def regex_tokenize(t):
    return _per_note(t, "retokenised", tx.regex_retokenised(F.col("TEXT")))


# --- text and vector features ------------------------------------------------------------------


@query
def tfidf_topk(t):
    return rounded_long(tfidf.tfidf(t.documents, PARAMS.tfidf_terms))


@query
def tfidf_topk_stop(t):
    return rounded_long(tfidf.tfidf(t.documents, PARAMS.tfidf_terms, stop_words=ENGLISH_STOP_WORDS))


@query
def tfidf_last_note(t):
    chosen = stage(notes.last_note(t.notes, t.period, t.ids), "last_note")
    return rounded_long(tfidf.tfidf(chosen, PARAMS.tfidf_terms))


@query
def hashing_tfidf(t):
    words = t.documents.select(ENTITY, tx.clean_tokens(F.col("text"), ENGLISH_STOP_WORDS).alias("words"))
    return _vector_cells(tfidf.hashing_tfidf(words).select(ENTITY, "features"))


@query
def hashing_tfidf_mass(t):
    """Terms of a document over all its buckets, a number that no hash function changes."""
    words = t.documents.select(ENTITY, tx.clean_tokens(F.col("text"), ENGLISH_STOP_WORDS).alias("words"))
    total = F.aggregate(vector_to_array("raw_features"), F.lit(0.0), lambda x, y: x + y).cast("bigint")
    return tfidf.hashing_tfidf(words).select(ENTITY, total.alias("n_terms"))


@query
def hashing_tfidf_cells(t):
    words = t.documents.select(ENTITY, tx.clean_tokens(F.col("text"), ENGLISH_STOP_WORDS).alias("words"))
    return tfidf.portable_hashing_tfidf(words).select(ENTITY, "bucket", "tf", "df", r6("weight"))


@query
def embed_windows(t):
    docs = t.documents.select(ENTITY, tx.clean_text(F.col("text")).alias("to_tok"))
    make = partial(vectors.HashingEncoder, ENCODER_WIDTH)
    encoded = vectors.embed_windows(docs, make, size=WINDOW, step=WINDOW_STEP, tasks=ENCODER_TASKS)
    return encoded.select(ENTITY, F.posexplode("vec").alias("pos", VALUE)).select(ENTITY, "pos", r6(VALUE))


@query
def embed_text(t):
    docs = t.documents.select(ENTITY, tx.tokenizer_text(F.col("text")).alias("to_tok"))
    encoded = vectors.embed_text(docs, partial(vectors.HashingEncoder, ENCODER_WIDTH), tasks=ENCODER_TASKS)
    cells = encoded.select(ENTITY, F.posexplode("vec").alias("pos", VALUE)).filter(F.col(VALUE) != 0)
    return cells.select(ENTITY, "pos", r6(VALUE))


# --- labels, models, evaluation ----------------------------------------------------------------


@query
def labels(t):
    return cohort.labels(t.lab_features.select(ENTITY).distinct(), t.outcomes)


@query
def labels_alt(t):
    return cohort.labels_from_column(t.views.patients)


@query
def training_matrix(t):
    extra = vectors.as_long(vectors.mean_pool(t.token_vectors))
    matrix = model.training_matrix(model.training_long("Embeddings", stage(t.baseline, "baseline"), extra), t.outcomes)
    return _vector_cells(matrix.rows)


@query
def training_matrix_tfidf(t):
    chosen = stage(notes.last_note(t.notes, t.period, t.ids), "last_note")
    extra = modelling.tfidf_long(chosen, PARAMS.tfidf_terms)
    matrix = model.training_matrix(model.training_long("TF_IDF", stage(t.baseline, "baseline"), extra), t.outcomes)
    return _vector_cells(matrix.rows)


def _forest(t):
    matrix = model.training_matrix(t.baseline, t.outcomes)
    fitted, scores = model.fit_and_score(matrix.rows, model.random_forest(), t.train)
    return matrix, fitted, scores


@query
def rf_scores(t):
    return _forest(t)[2]


@query
def lr_scores(t):
    matrix = model.training_matrix(ScaledFeatures(t).scaled(), t.outcomes)
    return model.fit_and_score(matrix.rows, model.logistic_regression(), t.train)[1]


@query
def model_roundtrip(t):
    matrix, fitted, scores = _forest(t)
    path = t.path("model")
    model.save_model(fitted, path)
    again = model.score(model.ForestModel.load(t.spark, path), matrix.rows.filter(~t.train))
    both = scores.join(again.select(ENTITY, F.col("score").alias("score_again")), ENTITY)
    return both.select(ENTITY, "label", (F.col("score") == F.col("score_again")).cast("int").alias("same_score"))


@query
def feature_importance(t):
    matrix, fitted, _ = _forest(t)
    return model.top_importances(fitted, matrix.codes, PARAMS.top_features)


@query
def select_and_retrain(t):
    matrix, fitted, _ = _forest(t)
    _, scores, _ = model.select_and_retrain(
        matrix.rows, fitted, matrix.width, model.random_forest(), t.train, PARAMS.select_features
    )
    return scores


@query
def select_by_mean_importance(t):
    matrix, fitted, _ = _forest(t)
    return model.select_and_retrain(matrix.rows, fitted, matrix.width, model.random_forest(), t.train)[1]


@query
def model_score_rows(t):
    """Who is scored by each kind of model, with the label and whether the score is a probability."""
    matrix, fitted, forest = _forest(t)

    def again(size):
        return model.select_and_retrain(matrix.rows, fitted, matrix.width, model.random_forest(), t.train, size)[1]

    scored = {
        "forest": forest,
        "logistic": lr_scores(t),
        "mean_importance": again(None),
        "top_importance": again(PARAMS.select_features),
    }
    in_range = F.col("score").between(0, 1).cast("int").alias("in_range")
    rows = [df.select(F.lit(name).alias("model"), ENTITY, "label", in_range) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def importance_check(t):
    """Importances add up to one over all features, and the list of the highest is sorted and full."""
    matrix, fitted, _ = _forest(t)
    top = model.top_importances(fitted, matrix.codes, PARAMS.top_features)
    above = top.select("importance", F.lag("importance").over(Window.orderBy(F.desc("importance"), FEATURE)).alias("above"))
    listed = above.agg(
        F.count(F.lit(1)).alias("n_top"), F.min(F.coalesce(F.col("above") >= F.col("importance"), F.lit(True)).cast("int")).alias("descending")
    )
    total = model.importances(fitted, matrix.codes).agg(F.sum("importance").alias("total")).select(r6("total"))
    return listed.select("n_top", "descending", total.scalar().alias("total"))


@query
def roc_auc(t):
    long = evaluate.model_scores(t.scores, ["score_a", "score_b"], ["label"])
    return evaluate.roc_auc(long, group=["model"]).select("model", r6("auc"), "n_pos", "n_neg")


@query
def cohort_auc(t):
    result = evaluate.cohort_auc(t.respiratory_scores, ["score_a", "score_b"], "respiratory")
    return result.select("model", "respiratory", r6("auc"), "n_pos", "n_neg")
