"""The registered queries as plain SQL, for an independent engine.

``@name`` stands for a view or a derived table; ``oracle_sql`` puts the needed ones in front.
"""

from __future__ import annotations

import re

from ..config import ENGLISH_STOP_WORDS, RESPIRATORY_GROUPS
from ..sources.fixtures import VIEWS
from .queries import (
    CATEGORIES, ENCODER_WIDTH, KEYWORDS, LAB_ITEMS, MICROBIOLOGY_ITEMS, MIXED_GROUPS, PARAMS, SECTION_TERM, VECTOR_WIDTH, WINDOW,
    WINDOW_STEP,
)

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRAIN = "substr(md5(CAST({0} AS VARCHAR) || ':1'), 1, 8) < 'cccccccc'"
_STOP = ", ".join("('" + w.replace("'", "''") + "')" for w in ENGLISH_STOP_WORDS)
_GROUPS = ", ".join(f"('{code}', '{group}')" for group, codes in RESPIRATORY_GROUPS.items() for code in codes)
_MIXED = ", ".join(f"('{code}', '{group}')" for group, codes in MIXED_GROUPS.items() for code in codes)
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def train(column: str = "entity_id") -> str:
    return _TRAIN.format(column)


def words_only(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '_', ' ', 'g')"


def clean(text: str) -> str:
    return f"lower(regexp_replace({words_only(text)}, ' +', ' ', 'g'))"


def to_tok(text: str) -> str:
    """Lines become sentences, symbols and blanks one blank, dots with a blank before them one dot."""
    sentences = f"regexp_replace(regexp_replace({text}, '({_BREAK})\\z', ''), '{_BREAK}', '. ', 'g')"
    return f"regexp_replace(regexp_replace({sentences}, '[ \\[\\]*_#:?!]+', ' ', 'g'), '( ?\\.)+', '.', 'g')"


def section_first(text: str) -> str:
    w, n = f"lower({words_only(text)})", len(SECTION_TERM)
    return f"CASE WHEN strpos({w}, '{SECTION_TERM}') > 0 THEN substr({w}, strpos({w}, '{SECTION_TERM}') + {n}) ELSE 'none' END"


def dose(text: str) -> str:
    parts = f"string_split(regexp_replace({text}, '[A-Za-z,>< ]', '', 'g'), '-')"
    numbers = f"[TRY_CAST(x AS DOUBLE) FOR x IN {parts}]"
    return (
        f"CASE WHEN {text} IS NULL THEN 0.0 WHEN list_bool_or([y IS NULL FOR y IN {numbers}]) THEN NULL "
        f"ELSE list_sum({numbers}) / len({parts}) END"
    )


def rounded_events(source: str) -> str:
    return f"SELECT entity_id, date, feature, round(value, 6) AS value FROM @{source}"


def window(source: str, period: str = "period", lower: str = ">=", upper: str = "<") -> str:
    return (
        f"SELECT e.* FROM @{source} e JOIN @{period} p ON p.entity_id = e.entity_id "
        f"WHERE e.date {lower} p.earliest AND e.date {upper} p.last"
    )


def kept(source: str, low: int) -> str:
    """Features seen in training and held by more than ``low`` entities."""
    return (
        f"SELECT feature, count(DISTINCT entity_id) AS n_entities FROM @{source} WHERE feature IS NOT NULL "
        f"GROUP BY feature HAVING count(DISTINCT entity_id) > {low} AND bool_or({train()})"
    )


def family(source: str, aggregates: list[str], low: int) -> str:
    """Closed window, rarity by training rows, aggregates as numbered long rows."""
    inside = f"w AS ({window(source, 'index_period', '>=', '<=')})"
    popular = f"k AS (SELECT feature FROM w WHERE {train()} GROUP BY feature HAVING count(value) > {low})"
    parts = " UNION ALL ".join(
        f"SELECT entity_id, feature || '_{i}' AS feature, CAST({a}(value) AS DOUBLE) AS value FROM w "
        "WHERE feature IN (SELECT feature FROM k) GROUP BY entity_id, feature"
        for i, a in enumerate(aggregates)
    )
    return f"WITH {inside}, {popular} {parts}"


def wide(source: str, features: list[str], cells: dict[str, str]) -> str:
    """Conditional aggregates, nulls filled with 0; ``cells`` maps a column suffix to a value column."""
    columns = ", ".join(
        f"round(COALESCE(MAX(CASE WHEN feature = '{f}' THEN {column} END), 0), 6) AS \"{f}{suffix}\""
        for f in features
        for suffix, column in cells.items()
    )
    return f"SELECT entity_id, {columns} FROM {source} GROUP BY entity_id"


def token_rows(text: str) -> str:
    """Words in order of appearance, without digits, single letters, stop words and repeats."""
    tokens = rf"string_split(regexp_replace(regexp_replace(lower({words_only(text)}), '\p{{Nd}}+', '', 'g'), ' +', ' ', 'g'), ' ')"
    return f"""
SELECT row_id, token, MIN(pos) AS pos FROM (
  SELECT ROW_ID AS row_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT ROW_ID, {tokens} AS w FROM @notes))
WHERE token <> '' AND NOT regexp_matches(token, '^[a-zA-Z]$') AND token NOT IN (SELECT w FROM @stop_words)
GROUP BY row_id, token"""


def tfidf(docs: str, stop: bool = False) -> str:
    """``docs`` has columns entity_id, text."""
    unwanted = "AND term NOT IN (SELECT w FROM @stop_words)" if stop else ""
    return f"""
WITH d AS ({docs}), t AS (SELECT entity_id, unnest(string_split(text, ' ')) AS term FROM d),
tf AS (SELECT entity_id, term, count(*) AS tf FROM t WHERE length(term) >= 2 {unwanted} GROUP BY entity_id, term),
v AS (SELECT term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 200),
w AS (SELECT entity_id, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term)),
l AS (SELECT entity_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY entity_id)
SELECT entity_id, 'TFIDF_' || term AS feature, round(w / norm, 6) AS value FROM w JOIN l USING (entity_id)"""


def auc(source: str, models: list[str], group: str = "") -> str:
    by = ", ".join(["model", *([group] if group else [])])
    carried = f"{group}, " if group else ""
    long = " UNION ALL ".join(f"SELECT '{m}' AS model, {carried}label, {m} AS score FROM @{source}" for m in models)
    return f"""
WITH s AS ({long}),
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT {by}, sum(CASE WHEN label = 1 THEN rk END) AS won, sum(label) AS p, sum(1 - label) AS n FROM r GROUP BY {by})
SELECT {by}, round((won - p * (p + 1) / 2.0) / (p * n), 6) AS auc, CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg FROM a"""


_EVENT = "CAST(SUBJECT_ID AS BIGINT) AS entity_id"

DERIVED: dict[str, str] = {
    **{name: sql.replace("{", "@").replace("}", "") for name, sql in VIEWS.items()},
    "stop_words": f"SELECT * FROM (VALUES {_STOP}) AS s(w)",
    "code_groups": f"SELECT * FROM (VALUES {_GROUPS}) AS g(code, code_group)",
    "ids": "SELECT SUBJECT_ID AS entity_id FROM @patients",
    "outcomes": f"SELECT {_EVENT}, CAST(DOD AS DATE) AS outcome_date FROM @patients WHERE EXPIRE_FLAG = 1",
    "diag_all": """SELECT CAST(d.SUBJECT_ID AS BIGINT) AS entity_id, CAST(a.ADMITTIME AS DATE) AS date, 'ICD9_' || d.ICD9_CODE AS feature,
  CAST(1 AS DOUBLE) AS value FROM @diagnoses d JOIN @admissions a ON a.SUBJECT_ID = d.SUBJECT_ID AND a.HADM_ID = d.HADM_ID""",
    "diag": "SELECT * FROM @diag_all WHERE feature IS NOT NULL",
    "labs": f"SELECT {_EVENT}, CAST(CHARTTIME AS DATE) AS date, 'LAB_' || CAST(ITEMID AS VARCHAR) AS feature, VALUENUM AS value FROM @labevents",
    "meds_all": f"SELECT {_EVENT}, CAST(ENDDATE AS DATE) AS date, 'MED_' || GSN AS feature, {dose('DOSE_VAL_RX')} AS value FROM @prescriptions WHERE ENDDATE IS NOT NULL",
    "meds": "SELECT * FROM @meds_all WHERE feature IS NOT NULL",
    "rollup": f"""SELECT DISTINCT CAST(d.SUBJECT_ID AS BIGINT) AS entity_id, CAST(a.ADMITTIME AS DATE) AS date,
  'DIAG_' || substr(ICD9_CODE, 1, CASE WHEN ICD9_CODE LIKE 'E%' THEN 4 ELSE 3 END) AS feature, CAST(1 AS DOUBLE) AS value
  FROM @diagnoses d JOIN @admissions a ON a.HADM_ID = d.HADM_ID WHERE ICD9_CODE IS NOT NULL""",
    "labs_text": f"""SELECT {_EVENT}, CAST(CHARTTIME AS DATE) AS date, 'LAB_' || CAST(ITEMID AS VARCHAR) AS feature,
  TRY_CAST(trim(VALUE) AS DOUBLE) AS value FROM (SELECT * FROM @labevents WHERE regexp_matches(trim(VALUE), '{_NUMBER}'))
  WHERE SUBJECT_ID IS NOT NULL AND CHARTTIME IS NOT NULL AND ITEMID IS NOT NULL""",
    "mb": f"""SELECT {_EVENT}, CAST(CHARTTIME AS DATE) AS date, 'MB_' || CAST(AB_ITEMID AS VARCHAR) || '_' || INTERPRETATION AS feature,
  CAST(1 AS DOUBLE) AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY SUBJECT_ID, AB_ITEMID ORDER BY ROW_ID DESC) AS rn FROM @microbiology
    WHERE AB_ITEMID IS NOT NULL AND INTERPRETATION IS NOT NULL AND INTERPRETATION <> 'P' AND CHARTTIME IS NOT NULL) WHERE rn = 1""",
    "adm": f"""SELECT {_EVENT}, CAST(ADMITTIME AS DATE) AS date, 'ADM_' || substr(ADMISSION_TYPE, 1, 4) AS feature,
  (epoch(CAST(DISCHTIME AS TIMESTAMP)) - epoch(CAST(ADMITTIME AS TIMESTAMP))) / 3600.0 AS value FROM @admissions""",
    "proc": f"""SELECT {_EVENT}, CAST(STARTDATE AS DATE) AS date, 'PROC_' || GSN AS feature, TRY_CAST(trim(DOSE_VAL_RX) AS DOUBLE) AS value
  FROM @procedure_orders WHERE GSN IS NOT NULL AND regexp_matches(trim(DOSE_VAL_RX), '{_NUMBER}')""",
    "note_rows": f"""SELECT ROW_ID AS row_id, {_EVENT}, HADM_ID AS admission_id, CAST(CHARTDATE AS DATE) AS date, CATEGORY AS category,
  TEXT AS text, {clean('TEXT')} AS clean_text FROM @notes""",
    "event_dates": """SELECT entity_id, date FROM @diag_all UNION ALL SELECT entity_id, date FROM @labs
  UNION ALL SELECT entity_id, date FROM @meds_all""",
    "last_event": "SELECT entity_id, MAX(date) AS last_event FROM @event_dates GROUP BY entity_id",
    "period": """SELECT entity_id, last - 730 AS earliest, last FROM (
  SELECT COALESCE(e.entity_id, o.entity_id) AS entity_id, COALESCE(o.outcome_date - 50, e.last_event) AS last
  FROM @last_event e FULL OUTER JOIN @outcomes o ON o.entity_id = e.entity_id)""",
    "period_b": """SELECT e.entity_id, e.last_event - 730 AS earliest, COALESCE(o.outcome_date - 50, e.last_event) AS last
  FROM @last_event e LEFT JOIN @outcomes o ON o.entity_id = e.entity_id""",
    "labs_in": window("labs"),
    "diag_in": window("diag"),
    "diag_open": window("diag", "period", ">", "<"),
    "meds_in": window("meds"),
    "lab_kept": kept("labs_in", 50),
    "diag_kept": kept("diag_in", 30),
    "med_kept": kept("meds_in", 50),
    "lab_built": """SELECT entity_id, feature, avg(value) AS value_mean, max(value) AS value_max, min(value) AS value_min FROM @labs_in
  WHERE feature IN (SELECT feature FROM @lab_kept) GROUP BY entity_id, feature""",
    "med_built": """SELECT entity_id, feature, avg(value) AS value_mean, count(value) AS value_count FROM @meds_in
  WHERE feature IN (SELECT feature FROM @med_kept) GROUP BY entity_id, feature""",
    "diag_built": """SELECT entity_id, feature, count(value) AS value_count FROM @diag_in
  WHERE feature IN (SELECT feature FROM @diag_kept) GROUP BY entity_id, feature""",
    "lab_means": "SELECT entity_id, feature, value_mean AS value FROM @lab_built",
    "baseline": """SELECT entity_id, feature || '_present' AS feature, CAST(1 AS DOUBLE) AS value FROM @diag_built
  UNION ALL SELECT entity_id, feature || '_mean', value_mean FROM @lab_built
  UNION ALL SELECT entity_id, feature || '_max', value_max FROM @lab_built
  UNION ALL SELECT entity_id, feature || '_min', value_min FROM @lab_built
  UNION ALL SELECT entity_id, feature || '_mean', value_mean FROM @med_built
  UNION ALL SELECT entity_id, feature || '_count', CAST(value_count AS DOUBLE) FROM @med_built""",
    "respiratory": """SELECT DISTINCT entity_id FROM @diag_open e JOIN @code_groups g ON g.code = substr(split_part(e.feature, '_', -1), 1, 3)""",
    "score_rows": """SELECT s.SUBJECT_ID AS entity_id, LABEL AS label, SCORE_A AS score_a, SCORE_B AS score_b,
  CASE WHEN r.entity_id IS NULL THEN 0 ELSE 1 END AS respiratory FROM @scores s LEFT JOIN @respiratory r ON r.entity_id = s.SUBJECT_ID""",
    "all_features": """SELECT * FROM @labs_text UNION ALL SELECT * FROM @rollup UNION ALL SELECT * FROM @mb UNION ALL SELECT * FROM @adm
  UNION ALL SELECT * FROM @meds""",
    "index_dates": """SELECT f.entity_id, COALESCE(CAST(p.DOD AS DATE) - 50, f.d) AS index_date FROM (
  SELECT entity_id, MAX(date) AS d FROM @all_features WHERE entity_id IS NOT NULL AND date IS NOT NULL AND feature IS NOT NULL
    AND value IS NOT NULL GROUP BY entity_id) f JOIN @patients p ON p.SUBJECT_ID = f.entity_id""",
    "index_period": "SELECT entity_id, index_date - 730 AS earliest, index_date AS last FROM @index_dates",
    "f_lab": family("labs_text", ["avg", "max", "min"], 50),
    "f_diag": family("rollup", ["avg", "max"], 30),
    "f_mb": family("mb", ["avg"], 10),
    "f_adm": family("adm", ["sum"], 0),
    "f_med": family("meds", ["avg", "count"], 50),
    "f_proc": family("proc", ["avg", "sum"], 50),
    "combined": " UNION ALL ".join(f"SELECT * FROM @f_{f}" for f in ("lab", "diag", "mb", "adm", "med", "proc")),
    "scaled": """SELECT entity_id, c.feature, value / m AS value FROM @combined c
  JOIN (SELECT feature, max(value) AS m FROM @combined GROUP BY feature) x ON x.feature = c.feature
  WHERE m <> 0 AND value IS NOT NULL""",
    "scaled_train": f"SELECT * FROM @scaled WHERE {train()}",
    "codes": """SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (
  SELECT DISTINCT feature FROM @scaled_train)""",
    "svm_cells": f"""SELECT entity_id, CASE WHEN {train()} THEN 'train' ELSE 'test' END AS part,
  CASE WHEN p.DOD_SSN IS NULL THEN 0 ELSE 1 END AS label, c.idx, round(s.value, 6) AS value
  FROM @scaled s JOIN @codes c ON c.feature = s.feature JOIN @patients p ON p.SUBJECT_ID = s.entity_id""",
    "vector_cells": """SELECT SUBJECT_ID AS entity_id, ARRIVAL AS arrival, unnest(VEC) AS x, generate_subscripts(VEC, 1) - 1 AS pos
  FROM @token_vectors""",
    "pooled": "SELECT entity_id, CAST(pos AS INT) AS pos, avg(CAST(x AS DOUBLE)) AS mean FROM @vector_cells GROUP BY entity_id, pos",
    "presence": "SELECT entity_id, "
    + ", ".join(
        f"CASE WHEN count(CASE WHEN category = '{c}' THEN admission_id END) > 0 THEN 1 ELSE 0 END AS \"{c}\"" for c in CATEGORIES
    )
    + " FROM @note_rows GROUP BY entity_id",
    "last_notes": """SELECT entity_id, date, clean_text FROM (
  SELECT n.*, row_number() OVER (PARTITION BY n.entity_id ORDER BY n.date DESC, n.clean_text DESC) AS rn
  FROM @note_rows n JOIN @period p ON p.entity_id = n.entity_id WHERE n.date >= p.earliest AND n.date < p.last
    AND n.entity_id IN (SELECT entity_id FROM @ids)) WHERE rn = 1""",
    "token_rows": token_rows("TEXT"),
}

def matrix_cells(long: str, label: bool) -> str:
    """Non-zero cells of a training matrix with ids from the sorted feature names."""
    shown = "CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS label, " if label else ""
    return f"""
WITH long AS ({long}), names AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INT) AS idx FROM (SELECT DISTINCT feature FROM long))
SELECT l.entity_id, {shown}n.idx, round(l.value, 6) AS value FROM long l JOIN names n ON n.feature = l.feature
LEFT JOIN @outcomes o ON o.entity_id = l.entity_id WHERE l.value <> 0"""


def matrix_with_left(columns: list[str], extra: list[str]) -> str:
    base = wide("@lab_means", columns, {"": "value"})
    added = wide("@mb", extra, {"": "value"})
    filled = ", ".join(f'COALESCE(b."{c}", 0) AS "{c}"' for c in extra)
    return f"SELECT a.*, {filled} FROM ({base}) a LEFT JOIN ({added}) b ON b.entity_id = a.entity_id"


_FLAGS = [*CATEGORIES, "DECEASED"]
_PAIRS = [(a, b) for i, a in enumerate(_FLAGS) for b in _FLAGS[i:]]
_PRESENCE_LABELLED = (
    "SELECT p.*, CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS \"DECEASED\" FROM @presence p "
    "LEFT JOIN @outcomes o ON o.entity_id = p.entity_id"
)

ORACLES: dict[str, str] = {
    "src_csv_gz": rounded_events("labs"),
    "src_csv_multiline": "SELECT ROW_ID, SUBJECT_ID, TEXT FROM @notes WHERE HADM_ID IS NOT NULL AND TEXT IS NOT NULL",
    "scan_for_entities": """SELECT SUBJECT_ID, ITEMID, VALUENUM, CAST(CHARTTIME AS DATE) AS CHARTDATE FROM @labevents
  WHERE SUBJECT_ID IN (SELECT entity_id FROM @outcomes)""",
    "scan_columns": "SELECT SUBJECT_ID, EXPIRE_FLAG FROM @patients",
    "scan_limit": "SELECT ROW_ID, SUBJECT_ID, CATEGORY FROM @notes ORDER BY ROW_ID LIMIT 100",
    "sink_json": "SELECT * FROM @outcomes",
    "sink_csv": "SELECT entity_id, feature, round(value_mean, 6) AS value_mean, value_count FROM @med_built",
    "sink_feature_matrix": """SELECT 'lab' AS family, entity_id, feature, round(value, 6) AS value FROM @lab_means
  UNION ALL SELECT 'diagnosis', entity_id, feature, CAST(1 AS DOUBLE) FROM @diag_built""",
    "cohort_freeze": "SELECT entity_id FROM @ids ORDER BY md5(CAST(entity_id AS VARCHAR) || ':1'), entity_id LIMIT 1000",
    "checkpoint": rounded_events("labs_in"),
    "svmlight_lines": """SELECT part, entity_id, CAST(label AS VARCHAR) || ' ' || string_agg(CAST(idx AS VARCHAR) || ':' || printf('%.6f', value), ' ' ORDER BY idx)
  || ' ' AS line FROM @svm_cells GROUP BY part, entity_id, label""",
    "svmlight_lines_with_id": """SELECT part, entity_id, CAST(entity_id AS VARCHAR) || ' ' || CAST(label AS VARCHAR) || ' '
  || string_agg(CAST(idx AS VARCHAR) || ':' || printf('%.6f', value), ' ' ORDER BY idx) || ' ' AS line
  FROM @svm_cells GROUP BY part, entity_id, label""",
    "svmlight_read": """SELECT part, CAST(label AS DOUBLE) AS label, CAST(idx AS INT) AS idx, count(*) AS n, round(sum(value), 6) AS total
  FROM @svm_cells WHERE value <> 0 GROUP BY part, label, idx""",
    "misfit_quarantine": """SELECT 'clean' AS kind, CAST(ITEMID AS VARCHAR) AS what, count(*) AS n FROM @labevents
  WHERE TRY_CAST(VALUE AS DOUBLE) IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'rejected', 'VALUENUM: not a double', count(*) FROM @labevents WHERE TRY_CAST(VALUE AS DOUBLE) IS NULL HAVING count(*) > 0""",
    "embedding_store_arrivals": f"""SELECT DISTINCT entity_id, sha256(text) AS digest, 'hashing' AS encoder, CAST(1 AS BIGINT) AS copies,
  {ENCODER_WIDTH} AS width, 0 AS added_last FROM (
  SELECT ROW_ID AS entity_id, TEXT AS text FROM @notes WHERE ROW_ID % 3 <> 0
  UNION ALL SELECT ROW_ID, CASE WHEN ROW_ID % 5 = 0 THEN 'again ' || TEXT ELSE TEXT END FROM @notes)""",
    "embedding_store_incremental": """
WITH first AS (SELECT entity_id, CAST(pos AS INT) AS pos, avg(CAST(x AS DOUBLE)) AS mean FROM @vector_cells WHERE arrival = 0 GROUP BY entity_id, pos)
SELECT entity_id, pos, round(mean, 6) AS value FROM first
UNION ALL SELECT entity_id, pos, round(mean, 6) FROM @pooled WHERE entity_id NOT IN (SELECT entity_id FROM first)""",
    "outcome_dates": "SELECT * FROM @outcomes",
    "drop_null_keys": """SELECT SUBJECT_ID, HADM_ID, GSN, CAST(ENDDATE AS DATE) AS ENDDATE FROM @prescriptions
  WHERE ENDDATE IS NOT NULL AND GSN IS NOT NULL""",
    "dropna_any": """SELECT * FROM @microbiology WHERE ROW_ID IS NOT NULL AND SUBJECT_ID IS NOT NULL AND AB_ITEMID IS NOT NULL
  AND INTERPRETATION IS NOT NULL AND CHARTTIME IS NOT NULL""",
    "fillna_zero": "SELECT SUBJECT_ID, ITEMID, COALESCE(VALUENUM, 0) AS VALUENUM FROM @labevents",
    "mb_events": rounded_events("mb"),
    "membership_semi_anti": """SELECT CASE WHEN o.entity_id IS NULL THEN 'alive' ELSE 'deceased' END AS side, feature, count(*) AS n
  FROM @labs l LEFT JOIN @outcomes o ON o.entity_id = l.entity_id GROUP BY 1, 2""",
    "window_filter": rounded_events("labs_in"),
    "window_filter_closed": f"SELECT entity_id, date, feature, round(value, 6) AS value FROM ({window('labs', 'period', '>=', '<=')})",
    "window_filter_open": rounded_events("diag_open"),
    "code_group_events": """SELECT entity_id, date, feature, code_group FROM @diag_open e
  JOIN @code_groups g ON g.code = substr(split_part(e.feature, '_', -1), 1, 3)""",
    "code_groups_any_length": f"""SELECT entity_id, date, feature, code_group FROM (
  SELECT e.*, g.code_group, len(g.code) AS size, max(len(g.code)) OVER (PARTITION BY e.r) AS longest
  FROM (SELECT *, row_number() OVER () AS r FROM @diag) e
  JOIN (VALUES {_MIXED}) AS g(code, code_group) ON starts_with(split_part(e.feature, '_', -1), g.code)) WHERE size = longest""",
    "code_group_entities": "SELECT entity_id FROM @respiratory",
    "keyword_counts": " UNION ALL ".join(
        f"SELECT '{w}' AS keyword, contains(lower(text), '{w}') AS present, count(*) AS n FROM @note_rows GROUP BY 2" for w in KEYWORDS
    ),
    "numeric_only": f"""SELECT SUBJECT_ID, ITEMID, TRY_CAST(trim(VALUE) AS DOUBLE) AS VALUE FROM @labevents
  WHERE regexp_matches(trim(VALUE), '{_NUMBER}')""",
    "notes_by_category": """SELECT 'all' AS who, row_id, entity_id, date FROM @note_rows WHERE category = 'Discharge summary'
  UNION ALL SELECT 'deceased', row_id, entity_id, date FROM @note_rows WHERE category = 'Discharge summary'
    AND entity_id IN (SELECT entity_id FROM @outcomes)""",
    "norm_diagnoses": rounded_events("diag"),
    "norm_labs": rounded_events("labs"),
    "norm_meds": rounded_events("meds"),
    "norm_diag_rollup": rounded_events("rollup"),
    "norm_labs_text": rounded_events("labs_text"),
    "norm_admissions": rounded_events("adm"),
    "norm_procedures": rounded_events("proc"),
    "norm_notes": "SELECT row_id, entity_id, date, category, clean_text FROM @note_rows",
    "join_inner_single": """SELECT d.SUBJECT_ID, d.HADM_ID, ICD9_CODE, CAST(a.ADMITTIME AS DATE) AS ADMITDATE
  FROM @diagnoses d JOIN @admissions a ON a.HADM_ID = d.HADM_ID""",
    "train_features_only": f"""SELECT entity_id, date, feature, round(value, 6) AS value FROM @diag_in
  WHERE feature IN (SELECT feature FROM @diag_in WHERE {train()})""",
    "popular_features": "SELECT * FROM @diag_kept",
    "train_period": "SELECT * FROM @period",
    "feature_matrix_outer": wide(
        "(SELECT entity_id, feature, value FROM @lab_means UNION ALL SELECT entity_id, feature, value FROM @mb)",
        LAB_ITEMS + MICROBIOLOGY_ITEMS,
        {"": "value"},
    ),
    "feature_matrix_left": matrix_with_left(LAB_ITEMS, MICROBIOLOGY_ITEMS),
    "max_scale": "SELECT entity_id, feature, round(value, 6) AS value FROM @scaled",
    "note_labels": f"""
WITH tokens AS ({token_rows('SECTION').replace('@notes', f'(SELECT ROW_ID, {section_first("TEXT")} AS SECTION FROM @notes)')}),
joined AS (SELECT row_id, string_agg(token, ' ' ORDER BY pos) AS words FROM tokens GROUP BY row_id)
SELECT n.row_id, CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS label, COALESCE(j.words, '') AS words FROM @note_rows n
JOIN @ids i ON i.entity_id = n.entity_id LEFT JOIN @outcomes o ON o.entity_id = n.entity_id LEFT JOIN joined j ON j.row_id = n.row_id""",
    "index_date": "SELECT * FROM @index_dates",
    "last_event_date": "SELECT * FROM @last_event",
    "diag_presence": "SELECT entity_id, feature FROM @diag_built WHERE value_count > 0",
    "diag_count": "SELECT entity_id, feature, value_count FROM @diag_built",
    "lab_features": """SELECT entity_id, feature, round(value_mean, 6) AS value_mean, round(value_max, 6) AS value_max,
  round(value_min, 6) AS value_min FROM @lab_built""",
    "med_features": "SELECT entity_id, feature, round(value_mean, 6) AS value_mean, value_count FROM @med_built",
    "popular_features_train_rows": f"""SELECT feature, CAST(count(value) AS BIGINT) AS n_train_rows FROM ({window('labs_text', 'index_period', '>=', '<=')})
  WHERE {train()} GROUP BY feature HAVING count(value) > 50""",
    "multi_agg_long": " UNION ALL ".join(
        f"SELECT entity_id, feature || '_{i}' AS feature, round({a}(value), 6) AS value FROM @labs_in GROUP BY entity_id, feature"
        for i, a in enumerate(["avg", "max", "min"])
    ),
    "process_family": "SELECT entity_id, feature, round(value, 6) AS value FROM @combined",
    "value_counts": "SELECT category, count(*) AS n FROM @note_rows GROUP BY category",
    "cohort_label_counts": "SELECT respiratory, label, count(*) AS n FROM @score_rows GROUP BY 1, 2",
    "category_presence": "SELECT entity_id, " + ", ".join(f'"{c}" AS {c.lower().replace(" ", "_")}' for c in CATEGORIES) + " FROM @presence",
    "category_prevalence": " UNION ALL ".join(
        f"SELECT '{c}' AS category, round(avg(CAST(\"{c}\" AS DOUBLE)), 6) AS share FROM @presence" for c in CATEGORIES
    ),
    "presence_corr": f"WITH t AS ({_PRESENCE_LABELLED}) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS r FROM t" for a, b in _PAIRS),
    "uniqueness_check": "SELECT count(DISTINCT SUBJECT_ID) AS n_distinct, count(*) AS n_rows FROM @patients",
    "pruning_report": f"""SELECT count(*) AS features_total, count(CASE WHEN seen THEN 1 END) AS features_in_train,
  count(CASE WHEN seen AND n > 30 THEN 1 END) AS features_kept
  FROM (SELECT feature, count(DISTINCT entity_id) AS n, bool_or({train()}) AS seen FROM @diag_in GROUP BY feature)""",
    "embedding_mean_pool": "SELECT entity_id, pos, round(mean, 6) AS mean FROM @pooled",
    "last_note": "SELECT * FROM @last_notes",
    "last_note_tokenized": f"""SELECT entity_id, date, {to_tok('text')} AS to_tok FROM (
  SELECT n.*, row_number() OVER (PARTITION BY n.entity_id ORDER BY n.date DESC, n.text DESC) AS rn
  FROM @note_rows n JOIN @period p ON p.entity_id = n.entity_id WHERE n.date >= p.earliest AND n.date < p.last
    AND n.entity_id IN (SELECT entity_id FROM @ids)) WHERE rn = 1""",
    "notes_per_day": """SELECT entity_id, date, row_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, date ORDER BY row_id) AS rn FROM @note_rows WHERE category = 'Discharge summary') WHERE rn = 1""",
    "codemap": f"""SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM @diag_in WHERE {train()})""",
    "entity_sample": "SELECT entity_id FROM @ids ORDER BY md5(CAST(entity_id AS VARCHAR) || ':1'), entity_id LIMIT 1000",
    "train_test_split": f"SELECT entity_id, CASE WHEN {train()} THEN 'train' ELSE 'test' END AS part FROM @ids",
    "all_features_long": rounded_events("all_features"),
    "period_parity": """SELECT COALESCE(a.entity_id, b.entity_id) AS entity_id, a.earliest AS earliest_a, a.last AS last_a,
  b.earliest AS earliest_b, b.last AS last_b FROM @period a FULL OUTER JOIN @period_b b ON b.entity_id = a.entity_id
  WHERE a.earliest IS DISTINCT FROM b.earliest OR a.last IS DISTINCT FROM b.last""",
    "multiset_difference": f"""SELECT entity_id, date, value, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right FROM (
  SELECT entity_id, date, round(value, 6) AS value, 1 AS l, 0 AS r FROM @labs_in
  UNION ALL SELECT entity_id, date, round(value, 6), 0, 1 FROM ({window('labs', 'period', '>=', '<=')}))
  GROUP BY entity_id, date, value HAVING sum(l) <> sum(r)""",
    "frame_parity": f"""WITH a AS (SELECT entity_id, date, feature, round(value, 6) AS value FROM @labs),
b AS (SELECT entity_id, date, feature, round(value, 6) + CASE WHEN entity_id % 7 = 0 THEN 1 ELSE 0 END AS value FROM @labs_text)
"""
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", (SELECT count(*) FROM (SELECT {cells} FROM a EXCEPT ALL SELECT {cells} FROM b)) AS only_left,
  (SELECT count(*) FROM (SELECT {cells} FROM b EXCEPT ALL SELECT {cells} FROM a)) AS only_right"""
        for name, cells in (("entity_id", "entity_id"), ("date", "entity_id, date"), ("feature", "entity_id, feature"),
                            ("value", "entity_id, value"), ("*", "entity_id, date, feature, value"))
    ),
    "presence_gram": """WITH p AS (SELECT entity_id, feature FROM @diag_built WHERE value_count > 0),
t AS (SELECT count(*)::DOUBLE AS n FROM @ids), c AS (SELECT feature, count(*)::DOUBLE AS n FROM p GROUP BY feature),
g AS (SELECT x.feature AS a, y.feature AS b, count(*) AS n FROM p x JOIN p y ON y.entity_id = x.entity_id AND x.feature <= y.feature GROUP BY 1, 2)
SELECT g.a, g.b, g.n, round((t.n * g.n - ca.n * cb.n) / nullif(sqrt(ca.n * (t.n - ca.n)) * sqrt(cb.n * (t.n - cb.n)), 0), 6) AS r
FROM g JOIN c ca ON ca.feature = g.a JOIN c cb ON cb.feature = g.b, t""",
    "pivot_features": wide("@lab_built", LAB_ITEMS, {"_mean": "value_mean", "_max": "value_max", "_min": "value_min"}),
    "sparse_matrix": matrix_cells("SELECT * FROM @baseline", label=False),
    "embedding_columns": "SELECT entity_id, "
    + ", ".join(f'round(MAX(CASE WHEN pos = {i} THEN mean END), 6) AS "EMBED_{i}"' for i in range(VECTOR_WIDTH))
    + " FROM @pooled GROUP BY entity_id",
    "mean_dose": f"SELECT SUBJECT_ID, HADM_ID, DOSE_VAL_RX, round({dose('DOSE_VAL_RX')}, 6) AS dose FROM @prescriptions",
    "clean_text": "SELECT row_id AS ROW_ID, clean_text FROM @note_rows",
    "clean_tokens": """SELECT n.row_id AS ROW_ID, COALESCE(j.tokens, '') AS tokens FROM @note_rows n
  LEFT JOIN (SELECT row_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM @token_rows GROUP BY row_id) j ON j.row_id = n.row_id""",
    "tokenizer_text": f"SELECT ROW_ID, {to_tok('TEXT')} AS to_tok FROM @notes",
    "section_after_first": f"SELECT ROW_ID, {section_first('TEXT')} AS section FROM @notes",
    "section_after_last": f"""SELECT ROW_ID, list_extract(string_split(lower({to_tok('TEXT')}), '{SECTION_TERM}'), -1) AS section FROM @notes""",
    "regex_tokenize": r"SELECT ROW_ID, array_to_string(regexp_extract_all(lower(TEXT), '\w+'), ' ') AS retokenised FROM @notes",
    "tfidf_topk": tfidf("SELECT row_id AS entity_id, clean_text AS text FROM @note_rows"),
    "tfidf_topk_stop": tfidf("SELECT row_id AS entity_id, clean_text AS text FROM @note_rows", stop=True),
    "tfidf_last_note": tfidf("SELECT entity_id, clean_text AS text FROM @last_notes"),
    "hashing_tfidf_cells": """WITH c AS (
  SELECT row_id AS entity_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 100 AS bucket, count(*) AS tf FROM @token_rows GROUP BY 1, 2),
d AS (SELECT bucket, count(*) AS df FROM c GROUP BY bucket), n AS (SELECT count(*) AS n FROM @note_rows)
SELECT entity_id, c.bucket, tf, df, round(tf * CASE WHEN df >= 3 THEN ln((n + 1)::DOUBLE / (df + 1)) ELSE 0.0 END, 6) AS weight
FROM c JOIN d ON d.bucket = c.bucket, n""",
    "embed_windows": rf"""WITH t AS (SELECT row_id AS entity_id, list_filter(string_split(clean_text, ' '), lambda w: w <> '') AS ws FROM @note_rows),
x AS (SELECT entity_id, ws, unnest(range(greatest(ceil((len(ws) - {WINDOW}) / {WINDOW_STEP}::DOUBLE), 0)::BIGINT + 1)) AS i FROM t),
v AS (SELECT entity_id, i, list_slice(ws, i * {WINDOW_STEP} + 1, i * {WINDOW_STEP} + {WINDOW}) AS own FROM x),
w AS (SELECT entity_id, i, greatest(len(own), 1) AS weight, unnest(regexp_extract_all(array_to_string(own, ' '), '\w+')) AS w FROM v),
s AS (SELECT entity_id, i, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {ENCODER_WIDTH} AS pos, any_value(weight) AS weight,
  sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS net FROM w GROUP BY 1, 2, 3),
k AS (SELECT entity_id, i, count(*) AS n FROM w GROUP BY 1, 2),
total AS (SELECT entity_id, sum(greatest(len(own), 1)) AS total FROM v GROUP BY 1),
p AS (SELECT s.entity_id, s.pos, sum(weight * net / n::DOUBLE) AS value FROM s JOIN k ON k.entity_id = s.entity_id AND k.i = s.i GROUP BY 1, 2)
SELECT t.entity_id, g.pos::INT AS pos, round(coalesce(p.value, 0) / t.total, 6) + 0.0 AS value
FROM total t CROSS JOIN range({ENCODER_WIDTH}) AS g(pos) LEFT JOIN p ON p.entity_id = t.entity_id AND p.pos = g.pos""",
    "embed_text": rf"""
WITH w AS (SELECT ROW_ID AS entity_id, unnest(regexp_extract_all(lower({to_tok('TEXT')}), '\w+')) AS w FROM @notes),
s AS (SELECT entity_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {ENCODER_WIDTH} AS pos,
  CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM w),
n AS (SELECT entity_id, count(*) AS n FROM w GROUP BY entity_id)
SELECT s.entity_id, CAST(pos AS INT) AS pos, round(sum(sign) / CAST(any_value(n) AS DOUBLE), 6) AS value
FROM s JOIN n ON n.entity_id = s.entity_id GROUP BY s.entity_id, pos HAVING sum(sign) <> 0""",
    "labels": """SELECT m.entity_id, CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT entity_id FROM @lab_built) m
  LEFT JOIN @outcomes o ON o.entity_id = m.entity_id""",
    "labels_alt": "SELECT SUBJECT_ID AS entity_id, CASE WHEN DOD_SSN IS NULL THEN 0 ELSE 1 END AS label FROM @patients",
    "training_matrix": matrix_cells(
        """SELECT * FROM @baseline UNION ALL SELECT entity_id, 'EMBED_' || CAST(pos AS VARCHAR), mean FROM @pooled
  WHERE entity_id IN (SELECT entity_id FROM @baseline)""",
        label=True,
    ),
    "training_matrix_tfidf": matrix_cells(
        f"""SELECT * FROM @baseline UNION ALL SELECT entity_id, feature, value FROM (
  {tfidf("SELECT entity_id, clean_text AS text FROM @last_notes")}) WHERE entity_id IN (SELECT entity_id FROM @baseline)""",
        label=True,
    ),
    "model_roundtrip": f"""SELECT b.entity_id, CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS label, 1 AS same_score
  FROM (SELECT DISTINCT entity_id FROM @baseline) b LEFT JOIN @outcomes o ON o.entity_id = b.entity_id WHERE NOT ({train('b.entity_id')})""",
    "hashing_tfidf_mass": """SELECT n.row_id AS entity_id, COALESCE(j.n_terms, 0) AS n_terms FROM @note_rows n
  LEFT JOIN (SELECT row_id, count(*) AS n_terms FROM @token_rows GROUP BY row_id) j ON j.row_id = n.row_id""",
    "model_score_rows": f"""SELECT b.model, b.entity_id, CASE WHEN o.entity_id IS NULL THEN 0 ELSE 1 END AS label, 1 AS in_range
  FROM (SELECT DISTINCT m.model, entity_id FROM @baseline, (VALUES ('forest'), ('mean_importance'), ('top_importance')) m(model)
    UNION ALL SELECT DISTINCT 'logistic', entity_id FROM @scaled) b
  LEFT JOIN @outcomes o ON o.entity_id = b.entity_id WHERE NOT ({train('b.entity_id')})""",
    "importance_check": f"""SELECT least({PARAMS.top_features}, count(DISTINCT feature)) AS n_top, 1 AS descending,
  CAST(1 AS DOUBLE) AS total FROM @baseline""",
    "roc_auc": auc("score_rows", ["score_a", "score_b"]),
    "cohort_auc": auc("score_rows", ["score_a", "score_b"], "respiratory"),
}

# storage changes no result
ORACLES |= {f"clustered_{name}": ORACLES[name] for name in ("lab_features", "med_features", "diag_presence", "window_filter")}


def _needed(sql: str, found: dict[str, str]) -> None:
    for name in re.findall(r"@(\w+)", sql):
        if name in DERIVED and name not in found:
            _needed(DERIVED[name], found)
            found[name] = DERIVED[name]


def oracle(name: str) -> str:
    """Stand-alone SQL for one query."""
    body, tables = ORACLES[name].strip(), {}
    _needed(body, tables)
    head = ", ".join(f"{t} AS ({sql.strip()})" for t, sql in tables.items())
    if tables:
        # a body that opens with its own WITH continues the list
        body = f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
    return re.sub(r"@(\w+)", r"\1", body)


def all_oracles() -> dict[str, str]:
    return {name: oracle(name) for name in ORACLES}
