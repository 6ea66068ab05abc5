"""The opN_ queries: each applies its operator to its whole table and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .decontaminate import contamination
from .langid import identify
from .licenses import license_scan
from .linededup import line_dedup
from .neardup import near_duplicates
from .packing import pack_along_curve, pack_best_fit
from .quality import quality
from .runtime import documents
from .spans import remove_spans
from .tokens import token_counts

#: Words of a text (fixed pattern of the contract), for DuckDB.
SPACE_WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 3-word shingles at a similarity of 0.85."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, percent=85)


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SPACE_WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT id, b FROM reach JOIN both_ways ON r = a)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = n.doc_id
"""

def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts by the byte-level vocabulary."""
    return token_counts(documents(spark, sf_dir, "doc_id", "text"), limit=1024)


def op4_packed_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids by best-fit-decreasing; a checksum stands for the id matrix's row."""
    packed = pack_best_fit(documents(spark, sf_dir, "doc_id", "text"), length=2048)
    return packed.select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "cu_seqlens", "position_resets", "doc_ids", "starts")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points in at least 5 documents stay in the largest doc_id alone."""
    out = line_dedup(documents(spark, sf_dir, "doc_id", "text"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, i, line, {LOWER_SQL.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM x),
hot AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key) FILTER (WHERE doc_id <> holder)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY doc_id
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan(documents(spark, sf_dir, "doc_id", "text"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids along a Hilbert curve."""
    return pack_along_curve(documents(spark, sf_dir, "doc_id", "text"), length=2048, ids=False).drop("ids")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three of four folds."""
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and the verdict by thresholds of the row's language and source."""
    return quality(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that also start in a smaller doc_id lose their words."""
    return remove_spans(documents(spark, sf_dir, "doc_id", "text"), span=50, digest=True).withColumnRenamed("kept", "kept_sha256")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {SPACE_WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (h) WHERE doc_id > least),
r AS (SELECT doc_id, list_sort(list(DISTINCT p)) AS ps FROM g GROUP BY doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
gone AS (SELECT DISTINCT doc_id, p FROM g),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in windows of 10 benchmark words."""
    return contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


OP3_SQL = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS ws FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS_SQL.format(LOWER_SQL.format("coalesce(text, '')"))} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, w FROM (
  SELECT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS w FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
s AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT doc_id, i, s.n, item_id FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM s) s JOIN win ON win.n = s.n AND win.w = s.w),
p AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_packed_binary": op4_packed_binary,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_curve_packing": op7_curve_packing,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_substring_dedup": OP10_SQL,
}
