"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_text, langid, licenses, merkle, mixing, packing, pieces, secret_scan, simhash, spotsigs, toxicity, trie_dedup

#: a public SentencePiece model; any BPE model with byte fallback will do
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: a public byte-level tokenizer
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: fixed values of the licence query: its base phrases and their labels
LICENSE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edit_probe(_documents(spark, folder).select("doc_id", "text"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return trie_dedup.copy_groups(_documents(spark, folder).select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, folder).select("doc_id", "text", "source"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder).select("doc_id", "text"), phrases=LICENSE_PHRASES)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, folder).select("doc_id", "text"), words=4, distance=4)


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded_documents(_documents(spark, folder).select("doc_id", "text"), pieces.load(PIECE_MODEL))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    return html_text.extract(pages)


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_audit(_documents(spark, folder).select("lang", "source", "text"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.audit(_documents(spark, folder).select(*merkle.FIELDS), tampered)


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(_documents(spark, folder).select("doc_id", "text"), BYTE_MODEL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
             AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS stop,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
opened AS (SELECT arg_min(level, (stop, rnk)) AS level FROM levels WHERE stop >= level),
targets AS (SELECT l.source, l.source_size, coalesce(least(cap, w * o.level), cap) AS target FROM levels l, opened o),
keyed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source
      ORDER BY md5('mix:' || s.doc_id::VARCHAR), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken, source
FROM keyed
""",
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r FROM documents),
per_doc AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 10),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cnt GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.n + 2)) // (s.total + 2 * s.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN cnt c USING (lang, source, term)
  LEFT JOIN tot t USING (lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE docs AS (SELECT doc_id, source, text, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    replace(text, chr(10), '') AS cut,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
        lambda i: list_concat([ord(substr(doc_id::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS crc
  FROM documents),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295::BIGINT) % 2 = 0
      THEN sha256(head || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) END AS other FROM docs),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM low WHERE n > 1 GROUP BY tree, level, pos // 3),
roots AS (SELECT tree, digest AS subroot FROM low WHERE n = 1),
top(level, pos, digest, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM roots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (SELECT tree, level, pos, digest FROM low WHERE n > 1 UNION ALL SELECT -1, 100 + level, pos, digest FROM top WHERE n > 1),
runs AS (SELECT tree, level, pos // 3 AS run, list(struct_pack(pos := pos, digest := digest) ORDER BY pos) AS members
  FROM nodes GROUP BY tree, level, pos // 3),
walk(doc_id, tree, pos, leaf, digest, seen, level) AS (
  SELECT doc_id, tree, pos, leaf, coalesce(other, leaf), '', 0 FROM placed
  UNION ALL
  SELECT w.doc_id, CASE WHEN r.tree IS NULL THEN -1 ELSE w.tree END, CASE WHEN r.tree IS NULL THEN w.tree ELSE w.pos // 3 END, w.leaf,
    CASE WHEN r.tree IS NULL THEN w.digest ELSE sha256(array_to_string(list_transform(r.members,
      lambda m: CASE WHEN m.pos = w.pos THEN w.digest ELSE m.digest END), '')) END,
    w.seen || coalesce(array_to_string(list_transform(list_filter(r.members, lambda m: m.pos <> w.pos), lambda m: m.digest), ''), ''),
    CASE WHEN r.tree IS NULL THEN 100 ELSE w.level + 1 END
  FROM walk w LEFT JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // 3
  WHERE w.tree >= 0 OR r.tree IS NOT NULL),
ends AS (SELECT w.doc_id, w.leaf, w.digest, w.seen FROM walk w
  WHERE w.tree = -1 AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.tree = -1 AND r.level = w.level))
SELECT e.doc_id, e.leaf, s.subroot, t.digest AS root, sha256(e.seen) AS proof_sha256, e.digest AS folded_root,
  e.digest = t.digest AS verified
FROM ends e JOIN placed p ON p.doc_id IS NOT DISTINCT FROM e.doc_id AND p.leaf = e.leaf JOIN roots s ON s.tree = p.tree
  JOIN (SELECT digest FROM top WHERE n = 1) t ON true
""",
}
