"""Secret scan with a random forest that removes false positives, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Words that announce a secret and words that announce something else, looked for before a candidate.
_SECRET_WORDS = r"(?i)(token|secret(?!ar)|passw|passphrase|pwd|api.?key|access.?key|private.?key|credential|bearer|auth(?!or(?!i)))"
_OTHER_WORDS = r"(?i)(example|sample|dummy|placeholder|fake|todo|checksum|digest|commit|sha1|sha256|md5|uuid|http)"
_NAME = rf"{_SECRET_WORDS}(?-i)[\w.-]{{0,40}}[\"'`]?"
_SIGN = r"(?:=>|:=|={1,3}|:)(?![=:>])"
#: The value of an assignment: any signs but white space and quotes, without what closes a sentence or bracket after it.
_VALUE = r"[^\s\"'`]*[^\s\"'`,;.)\]}]"
#: What may be a secret by itself: a web token with its dots, or an unbroken run of the characters keys are written in, padding
#: at its end included.
_TOKEN = r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?"
_RUN = r"[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
#: A name and its sign in one word (groups 1 and 3), a user name in a web address (4 and 5), or a run (6).
_IN_WORD = (
    rf"([\w.-]{{0,40}}{_NAME}{_SIGN}[\"'`]?)({_VALUE})"
    rf"|(://[^\s/:@\"'`]{{0,64}}:)([^\s/@\"'`]+)(?=@)|({_TOKEN}|{_RUN})"
)
#: The words ahead end with a name and its sign, or with a name whose sign begins the next word.
_ANNOUNCED = rf"{_NAME}\s*{_SIGN}\s*[\"'`]?(?:\s*(?i:bearer|basic|token))?$"
_NAMED = rf"{_NAME}$"
_SIGNED = rf"^({_SIGN}[\"'`]?)({_VALUE})"
_IN_WORD_NAMED = rf"{_NAME}{_SIGN}[\"'`]?[^\s\"'`]|://[^\s/:@\"'`]{{0,64}}:[^\s/@\"'`]+@"
#: Whether a text can hold any of them.
_ANY = rf"{_RUN}|{_TOKEN}|{_NAME}\s{{0,8}}{_SIGN}|://[^\s/:@\"'`]{{0,64}}:[^\s/@\"'`]+@"
_MARK = "\x01"
_CODE_PATH = r"(?i)(\.env|\.pem|\.key|config|settings|secret|deploy|\.ya?ml|\.json|\.tf)"
_TEST_PATH = r"(?i)(test|spec|mock|fixture|example|sample|docs?/)"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "length", "digit_share", "upper_share", "sign_share", "class_changes", "rare_pairs", "distinct_share", "hex_only",
    "dictionary_share", "secret_word", "other_word", "assigned", "quoted", "in_address", "code_path", "test_path",
)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """``doc_id, word, part, candidate, before, after, path`` of everything in a whole text that may be a secret.

    That is the value after an assignment (``=``, ``:``, ``:=``, ``=>``) to a name that tells of a secret, quoted or not, of any
    length and with any signs but white space and quotes; the password in a web address; a dotted web token; and any run
    of 16 or more key characters. ``word`` counts words between white space from 0, ``part`` tells candidates of one word
    apart; ``before`` holds the three words ahead of it and the word's own beginning, ``after`` the word's end and the next
    word. Only texts with a candidate are cut into words. The control character 1 counts as 2.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(path_column).cast("string").alias("path"),
        F.split(F.regexp_replace(F.translate(text_column, _MARK, "\x02"), r"^\s+", ""), r"\s+").alias("words"),
        F.col(text_column).alias("_text"),
    ).filter(F.col("_text").rlike(_ANY))
    words = F.col("words")
    near = F.transform(
        words,
        lambda w, i: F.struct(
            i.alias("word"),
            w.alias("own"),
            F.concat_ws(" ", F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))).alias("ahead"),
            F.coalesce(F.get(words, i + 1), F.lit("")).alias("behind"),
        ),
    )
    announced, named = F.col("ahead").rlike(_ANNOUNCED), F.col("ahead").rlike(_NAMED)
    own, whole = F.col("own"), rf"^([\"'`(]*)({_VALUE})"
    marked = (
        F.when(named & own.rlike(_SIGNED), F.regexp_replace(own, _SIGNED, f"$1{_MARK}$2{_MARK}"))
        .when(announced & ~own.rlike(_IN_WORD_NAMED), F.regexp_replace(own, whole, f"$1{_MARK}$2{_MARK}"))
        .otherwise(F.regexp_replace(own, _IN_WORD, f"$1$4{_MARK}$3$5$6{_MARK}"))
    )
    cut = rows.select("doc_id", "path", F.inline(near)).select("*", F.split(marked, _MARK).alias("pieces")).filter(F.size("pieces") > 1)
    parts = cut.select("*", F.posexplode("pieces").alias("at", "candidate")).filter((F.col("at") % 2 == 1) & (F.col("candidate") != ""))
    ahead_of_it = F.array_join(F.slice("pieces", F.lit(1), F.col("at")), "")
    beyond = F.array_join(F.slice("pieces", F.col("at") + 2, F.lit(2)), "")
    return parts.select(
        "doc_id",
        "word",
        ((F.col("at") - 1) / 2).cast("int").alias("part"),
        "candidate",
        F.concat_ws(" ", "ahead", F.right(ahead_of_it, F.lit(200))).alias("before"),
        F.concat_ws(" ", F.substring(beyond, 1, 40), F.substring("behind", 1, 40)).alias("after"),
        "path",
    )


def dictionary(docs: DataFrame, size: int = 300, text_column: str = "text") -> list[str]:
    """The ``size`` most frequent words of three to seven small letters, counted over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(text_column, F.lit(r"(?<![A-Za-z])([a-z]{3,7})(?![A-Za-z])"), 1)).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").limit(size)
    return sorted(r["w"] for r in top.collect())


def letter_pairs(words: list[str]) -> list[float]:
    """For each ordered pair of letters 1 where no dictionary word has it, else 0."""
    known = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
    return [0.0 if a + b in known else 1.0 for a in _LETTERS for b in _LETTERS]


def _share(pattern: str, of: str = "candidate") -> Column:
    return F.regexp_count(F.col(of), F.lit(pattern)) / F.length(of)


def _flag(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).rlike(pattern).cast("double")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Add ``features`` (array of double, in the order of :data:`FEATURES`) to candidates."""
    pairs = F.array(*[F.lit(x) for x in letter_pairs(words)])
    lower, length = F.lower("candidate"), F.length("candidate")
    changes = [*(f"(?<=[{c}])(?=[^{c}])" for c in ("a-z", "A-Z", "0-9")), "(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"]
    # letters next to each other, as numbers 1 to 26 (0: no letter)
    places = F.transform(F.split(lower, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(_LETTERS), c)))
    following = F.slice(F.col("_places"), F.lit(2), F.greatest(length - 1, F.lit(1)))
    rare = F.aggregate(
        F.zip_with(
            F.slice(F.col("_places"), F.lit(1), F.greatest(length - 1, F.lit(1))),
            following,
            lambda a, b: F.when((a > 0) & (b > 0), F.element_at(F.col("_pairs"), ((a - 1) * 26 + b).cast("int"))).otherwise(0.5),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    known = "(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")" if words else "(?!)"
    values = {
        "length": F.log1p(length.cast("double")),
        "digit_share": _share("[0-9]"),
        "upper_share": _share("[A-Z]"),
        "sign_share": _share("[^A-Za-z0-9]"),
        "class_changes": sum((F.regexp_count("candidate", F.lit(c)) for c in changes[1:]), F.regexp_count("candidate", F.lit(changes[0]))) / length,
        "rare_pairs": rare / length,
        "distinct_share": F.size(F.array_distinct(F.split(lower, ""))) / F.least(length, F.lit(36)),
        "hex_only": _flag("candidate", "^([0-9a-f]+|[0-9A-F]+)$"),
        "dictionary_share": 1 - F.length(F.regexp_replace(lower, known, "")) / length,
        "secret_word": _flag("before", _SECRET_WORDS),
        "other_word": _flag("before", _OTHER_WORDS),
        "assigned": _flag("before", r"[=:]\s*[\"'`]?$"),
        "quoted": _flag("before", "[\"'`]$"),
        "in_address": _flag("before", "://[^/]*:$"),
        "code_path": _flag("path", _CODE_PATH),
        "test_path": _flag("path", _TEST_PATH),
    }
    ready = found.select("*", places.alias("_places"), pairs.alias("_pairs"))
    listed = F.array(*[values[name].cast("double") for name in FEATURES])
    return ready.withColumn("features", listed).drop("_places", "_pairs")


@dataclass
class SecretModel:
    words: list[str]
    forest: RandomForestClassificationModel | None
    rate: float  # what every candidate scores when there was nothing to learn


def fit(labelled: DataFrame, words: list[str], most_rows: int = 20_000, trees: int = 30, depth: int = 6) -> SecretModel:
    """A forest on findings with a column ``label`` (1 secret, 0 false positive, null not used).

    ``most_rows`` bounds the sample: findings are drawn by a hash of candidate and place, from either label
    half at most. Without both labels there is no forest and every candidate scores the sample's rate.
    """
    known = labelled.filter(F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        return SecretModel(words, None, 1.0 if set(counts) == {1} else 0.0)
    share = F.when(F.col("label") == 1, min(1.0, most_rows / 2 / counts[1])).otherwise(min(1.0, most_rows / 2 / counts[0]))
    drawn = F.pmod(F.xxhash64("candidate", "doc_id", "word", "part"), F.lit(1_000_003)) / 1_000_003.0
    sample = with_features(known.filter(drawn <= share), words).select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), "doc_id", "word", "part"
    )
    rows = stage(sample.repartitionByRange(4, "doc_id", "word", "part").sortWithinPartitions("doc_id", "word", "part"), "findings")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, minInstancesPerNode=3).fit(rows)
    return SecretModel(words, forest, counts[1] / sum(counts.values()))


def classify(found: DataFrame, model: SecretModel) -> DataFrame:
    """Candidates with ``features``, ``score`` (0 to 1) and ``is_secret`` (score of at least one half)."""
    ready = with_features(found, model.words)
    if model.forest is None:
        scored = ready.withColumn("score", F.lit(float(model.rate)))
    else:
        vectors = ready.withColumnRenamed("features", "_listed").withColumn("features", array_to_vector("_listed"))
        graded = model.forest.transform(vectors).withColumn("score", vector_to_array("probability")[1])
        scored = graded.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_listed", "features")
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels for a corpus without any: known forms are secrets, plain words, links and placeholders are not.

    A secret is a value with letters and with digits or signs, of six or more different characters, that an assignment to a
    secret's name precedes, a password in a web address, or a run in a published key format; a false positive is a run of
    letters and signs only, one behind a word such as checksum, one with few different characters, or a reference that
    stands for a value. What is neither gets no label.
    """
    own = F.col("candidate")
    mixed = own.rlike("[A-Za-z]") & own.rlike("[^A-Za-z._/-]")
    kinds = F.size(F.array_distinct(F.split(own, "")))
    varied = kinds >= F.when(F.length(own) < 16, 6).otherwise(8)
    reference = own.rlike(r"(?i)^[$<{%]|environ|getenv|your|example|change.?me|placeholder|^https?:|\($|^[a-z_.]+\(")
    assigned = F.col("before").rlike(_SECRET_WORDS + r"\S*\s*[=:>]\s*[\"'`(]*((?i:bearer|basic|token)\s+)?$")
    address = F.col("before").rlike("://[^/]*:$") & (F.length(own) >= 6) & own.rlike("[^A-Za-z]")
    published = own.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})$")
    token = own.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.")
    plain = ~own.rlike("[0-9]") & (~mixed | (F.length(own) >= 16))
    harmless = plain | (~varied & ~(assigned & mixed)) | reference | F.col("before").rlike(_OTHER_WORDS + r"\S*\s*[=:]?\s*[\"'`]?$")
    label = F.when((published | token | address | (assigned & mixed & varied)) & ~reference, 1).when(harmless, 0)
    return found.withColumn("label", label.cast("int"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path_column: str = "source") -> DataFrame:
    """Every candidate of every whole text with its score and verdict; the secret itself only as a digest.

    Columns ``doc_id, word, part, length, candidate_sha256, features, score, is_secret``. The dictionary is counted over
    all texts, the forest fitted on a bounded sample of weakly labelled findings. Null and empty texts
    have no candidates, a null path has no path features, repeated rows repeat their findings, and
    an empty table gives an empty result. Candidates are written once, since both the fit and the verdict need them.
    """
    found = stage(candidates(docs, id_column, text_column, path_column), "candidates")
    model = fit(weak_labels(found), dictionary(docs, text_column=text_column))
    return classify(found, model).select(
        "doc_id",
        "word",
        "part",
        F.length("candidate").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "features",
        "score",
        "is_secret",
    )
