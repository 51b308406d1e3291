"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm import bpe, decontaminate
from girder.llm.features import remainder
from girder.llm.jaccard_join import jaccard_components
from girder.llm.language_id import identify_language
from girder.llm.quality_classifier import classify_quality
from girder.llm.quality_rules import apply_quality_rules
from girder.llm.suffix_dedup import removed_report
from girder.llm.toxicity import classify_toxicity
from girder.llm.url_filter import filter_urls
from girder.llm.warc import plan_records, read_records, write_archives
from girder.scratch import Scratch, read

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
LISTED_HOSTS = tuple(
    f"{site}.example.{top}"
    for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(read(spark, sf_dir, "pages"), RULES, LISTED_HOSTS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: A public vocabulary; the path is resolved where the file is read.
TOKENIZER = "byte_bpe_50k.json"


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), TOKENIZER)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_report(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    index = scratch.save(write_archives(plan_records(read(spark, sf_dir, "pages")), folder), "index")
    records = read_records(index, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    return classify_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0)


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


OP1_SQL = rf"""
WITH rules(verdict, rule_host, rule_path, rule) AS (
  SELECT v, split_part(k, '/', 1), substr(k, strpos(k, '/')), k FROM (VALUES {_sql_values(RULES)}) t(v, k)
), listed(site) AS (SELECT * FROM (VALUES {_sql_values((h,) for h in LISTED_HOSTS)}) t(h)),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path
  FROM rest
), fitted AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE p.host = l.site OR ends_with(p.host, '.' || l.site)) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fitted f USING (page_id)
"""

_SHINGLES_SQL = r"""
{name}_words AS (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table} WHERE text IS NOT NULL),
{name}_sets AS (
  SELECT DISTINCT {id}, unnest([array_to_string(w[k:k + {width} - 1], ' ') FOR k IN range(1, len(w) - {width} + 2)]) AS shingle
  FROM {name}_words WHERE len(w) >= {width}
)"""

OP2_SQL = f"""
WITH {_SHINGLES_SQL.format(name="i", id="item_id", table="benchmark", width=5)}, {_SHINGLES_SQL.format(name="d", id="doc_id", table="documents", width=5)},
sizes AS (SELECT item_id, count(*) AS n_item_shingles FROM i_sets GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d_sets JOIN i_sets USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared FROM met JOIN sizes USING (item_id) WHERE 100 * n_shared >= 75 * n_item_shingles
"""

OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] END) AS shingle FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * n_both >= 75 * (s.n + t.n - n_both)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(k.n, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reached GROUP BY a) c USING (doc_id)
  LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) k USING (doc_id)
"""

OP7_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, substr(h, 2 * k - 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS k FROM d)),
least AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT doc_id, k, lag(k) OVER o AS before, lead(k) OVER o AS after FROM w JOIN least USING (win) WHERE least < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
spans AS (
  SELECT doc_id, min(k) AS first, max(k) + 49 AS last FROM (
    SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM cut
  ) GROUP BY doc_id, span
),
edges AS (SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS before FROM spans),
gone AS (
  SELECT e.doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS last, string_agg(substr(h, 2 * before + 1, 2 * (first - before - 1)), '' ORDER BY first) AS kept
  FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, n AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1) FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM w
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_benchmark_decontamination": OP2_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
}
