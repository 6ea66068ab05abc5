"""Registered queries over URLs, fetching, citations, chunks and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import pytext as P, urls
from ..operators import assemble, citations, cleaner, retrieval, validate
from ..registry import register
from ..session import table
from ..sources import fetch_replay
from . import sql
from .cleaning import STATS_SQL, _long, dirty_units

lit = F.lit


# --- URLs ---------------------------------------------------------------------------------------

# URLs and addresses with what becomes of them.
URL_CASES = [
    ("http://Example.COM./a?q=1#f", None, "http://example.com/a?q=1"),
    ("https://example.com:443/x", None, "https://example.com/x"),
    ("https://user:pw@example.com/", "userinfo_not_allowed", None),
    ("ftp://example.com/", "unsupported_scheme", None),
    ("http://localhost/", "blocked_destination", None),
    ("http://a.localhost/", "blocked_destination", None),
    ("http://example.com:8080/", "disallowed_port", None),
    ("http://example.com:99999/", "disallowed_port", None),
    ("http:///path", "invalid_url", None),
    ("/relative", "invalid_url", None),
    ("http://two words.example/", "invalid_url", None),
    ("   ", "invalid_url", None),
    ("http://[bad", "invalid_url", None),
    ("http://[2001:4860:4860::8888]/", None, "http://[2001:4860:4860::8888]/"),
    ("https://bücher.example/", None, "https://xn--bcher-kva.example/"),
]
ADDRESS_CASES = [("8.8.8.8", True), ("1.1.1.1", True), ("127.0.0.1", False), ("10.0.0.1", False), ("172.16.0.1", False), ("192.168.1.1", False), ("169.254.169.254", False), ("100.64.0.1", False), ("224.0.0.1", False), ("0.0.0.0", False), ("240.0.0.1", False), ("::1", False), ("fe80::1", False), ("fc00::1", False), ("2001:4860:4860::8888", True), ("::ffff:10.0.0.1", False), ("nonsense", False)]


def _text(value: object) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(x) for x in row) + ")" for row in rows)


@register("url_cases", f"SELECT * FROM (VALUES {_values(URL_CASES)}) t(url, error_code, request_url)")
def url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that are refused, and those that change."""
    df = spark.createDataFrame([(u,) for u, _, _ in URL_CASES], "url string").withColumn("n", urls.normalize_url(F.col("url")))
    return df.select("url", "n.error_code", "n.request_url")


@register("address_cases", f"SELECT * FROM (VALUES {_values(ADDRESS_CASES)}) t(address, is_public)")
def address_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that may be fetched from."""
    df = spark.createDataFrame([(a,) for a, _ in ADDRESS_CASES], "address string")
    return df.select("address", urls.all_public(F.array("address")).alias("is_public"))


@register(
    "page_urls",
    r"""SELECT page_id::BIGINT AS page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?)://([^/?]*)', lower(regexp_extract(url, '^https?://[^/?#]*'))) AS request_url,
    lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS hostname, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?)://([^/?]*)', lower(regexp_extract(url, '^https?://[^/?#]*'))) AS diagnostic_url FROM pages""",
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized URLs of all web pages."""
    df = table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("n"))
    return df.select("page_id", "n.request_url", "n.hostname", "n.scheme", "n.diagnostic_url")


# --- fetching -----------------------------------------------------------------------------------


def exchanges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, exchanges and DNS made from the pages: each page is behind 0 to 6 redirects."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    k = F.col("page_id").cast("string")
    hops = (F.col("page_id") % 7).cast("int")
    at = lambda h: F.concat(lit("https://h.example/"), k, lit("/"), h.cast("string"))
    requests = pages.select(F.col("page_id").alias("request_id"), at(lit(0)).alias("url"))
    steps = pages.select("page_id", "html", F.explode(F.sequence(lit(0), hops)).alias("h"), hops.alias("n"))
    last = F.col("h") == F.col("n")
    kind = F.col("page_id") % 11
    header = lambda n, v: F.struct(lit(n).alias("name"), v.alias("value"))
    target = F.when(kind == 1, "").when(kind == 2, F.concat(lit("http://h.example/"), k, lit("/"), (F.col("h") + 1).cast("string"))).when(kind == 3, at(lit(0))).otherwise(at(F.col("h") + 1))
    media = F.when(kind == 4, "image/png").when(kind == 5, 'text/html; charset="utf-8"').otherwise("text/html")
    length = F.when(kind == 10, " ").when(kind == 6, "12, 13").when(kind == 7, "9999999").otherwise(F.octet_length("html").cast("string"))
    status = F.when(~last, 302).when(kind == 8, 204).when(kind == 9, 404).otherwise(200)
    headers = F.when(last, F.array(header("Content-Type", media), header("content-length", length))).otherwise(F.array(header("Location", target)))
    answers = steps.select(at(F.col("h")).alias("url"), status.alias("status"), headers.alias("headers"), F.encode("html", "utf-8").alias("body"))
    dns = spark.createDataFrame([("h.example", ["8.8.8.8"])], "hostname string, addresses array<string>")
    return requests, answers, dns


@register(
    "fetch_replay",
    """WITH p AS (SELECT page_id, page_id % 7 AS h, page_id % 11 AS k, octet_length(encode(html)) AS n FROM pages),
    e AS (SELECT *, CASE WHEN h > 0 AND k = 1 THEN 'invalid_redirect' WHEN h > 0 AND k = 2 THEN 'https_downgrade_redirect' WHEN h > 0 AND k = 3 THEN 'redirect_loop' WHEN h > 5 THEN 'redirect_limit_exceeded'
      WHEN k = 8 THEN 'empty_response' WHEN k = 9 THEN 'http_status_error' WHEN k = 6 THEN 'invalid_content_length' WHEN k = 7 THEN 'response_too_large' WHEN k = 4 THEN 'unsupported_content_type' END AS error_code FROM p)
    SELECT page_id::BIGINT AS request_id, error_code, CASE WHEN error_code IS NULL THEN 'https://h.example/' || page_id || '/' || h END AS final_url, CASE WHEN error_code IS NULL THEN n END::BIGINT AS downloaded_bytes,
      CASE WHEN error_code IS NULL THEN h END::BIGINT AS redirects, CASE WHEN error_code IS NULL AND k = 5 THEN 'utf-8' END AS charset FROM e""",
)
def fetch_replay_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetching each page gives: redirects followed, responses checked."""
    out = fetch_replay.replay(*exchanges(spark, sf_dir))
    return out.select("request_id", "error_code", "final_url", "downloaded_bytes", F.when(F.col("error_code").isNull(), F.col("redirect_count")).cast("long").alias("redirects"), "charset")


@register(
    "fetch_limits",
    """SELECT page_id::BIGINT AS request_id, CASE WHEN page_id % 7 > 1 AND page_id % 11 NOT IN (1, 2, 3) THEN 'redirect_limit_exceeded' WHEN octet_length(encode(html)) > 1500 THEN 'response_too_large' END AS error_code
    FROM pages WHERE page_id % 11 IN (0, 10) OR page_id % 77 = 7""",
)
def fetch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tight bounds on redirects and on bodies, with a declared length and without one."""
    requests, answers, dns = exchanges(spark, sf_dir)
    k = F.col("request_id")
    some = requests.where((k % 11).isin(0, 10) | (k % 77 == 7))
    real = F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.when(h["value"] == "9999999", " ").otherwise(h["value"]).alias("value")))
    out = fetch_replay.replay(some, answers.withColumn("headers", real), dns, {"max_redirects": 1, "max_body_bytes": 1500})
    return out.select("request_id", "error_code")


@register(
    "fetched_sources",
    """SELECT page_id::VARCHAR AS document_id, 'https://h.example/' || page_id || '/0' AS original_url, 'https://h.example/' || page_id || '/' || page_id % 7 AS source_uri, (page_id % 7)::VARCHAR AS original_filename, 200::BIGINT AS status_code,
    (page_id % 7)::BIGINT AS redirect_count, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE page_id % 7 < 6 AND page_id % 11 IN (0, 5, 10)""",
)
def fetched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages as sources, with what is known of their fetch."""
    out = fetch_replay.fetched_as_sources(fetch_replay.replay(*exchanges(spark, sf_dir)))
    some = out.where((F.col("document_id").cast("long") % 11).isin(0, 5, 10))
    return some.select("document_id", "fetch.original_url", "source_uri", "original_filename", F.col("fetch.status_code").cast("long").alias("status_code"), F.col("fetch.redirect_count").cast("long").alias("redirect_count"), F.length("content_bytes").cast("long").alias("bytes"))


@register(
    "fetch_headers",
    """SELECT page_id::BIGINT AS page_id, CASE page_id % 6 WHEN 0 THEN page_id WHEN 2 THEN 5 WHEN 4 THEN 1000 END::BIGINT AS content_length, page_id % 6 IN (3, 5) AS bad_length,
    CASE page_id % 5 WHEN 3 THEN 'application/xhtml+xml' ELSE 'text/html' END AS media_type, CASE page_id % 5 WHEN 0 THEN 'UTF-8' WHEN 3 THEN 'Latin-' || page_id END AS charset, CASE WHEN page_id % 5 = 1 THEN 'malformed_content_type' END AS type_error FROM pages""",
)
def fetch_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and types from headers that are split, blank, repeated, in conflict or quoted."""
    pages = table(spark, sf_dir, "pages")
    k, id_ = F.col("page_id"), F.col("page_id").cast("string")
    of = lambda name, *values: F.array(*[F.struct(lit(name).alias("name"), (v if not isinstance(v, str) else lit(v)).alias("value")) for v in values])
    length = F.when(k % 6 == 0, of("Content-Length", F.concat(id_, lit(",")))).when(k % 6 == 1, of("content-length", "  ")).when(k % 6 == 2, of("content-length", "5", " 5")).when(k % 6 == 3, of("content-length", "5", "6")).when(k % 6 == 4, of("content-length", "1_000")).otherwise(of("content-length", "-3"))
    kind = F.when(k % 5 == 0, of("Content-Type", 'Text/HTML; Charset="UTF-8"')).when(k % 5 == 1, of("content-type", "text/html", "TEXT/HTML")).when(k % 5 == 2, of("content-type", "text/html; charset= ")).when(k % 5 == 3, of("content-type", F.concat(lit("application/xhtml+xml;charset=Latin-"), id_))).otherwise(of("content-type", "text/html, "))
    found = pages.select("page_id", fetch_replay.content_length(length).alias("l"), fetch_replay.content_type(kind).alias("t"))
    return found.select("page_id", F.col("l.value").alias("content_length"), F.col("l.bad").alias("bad_length"), "t.media_type", "t.charset", F.col("t.error").alias("type_error"))


@register(
    "url_diagnostics",
    "SELECT page_id::BIGINT AS page_id, CASE page_id % 3 WHEN 0 THEN 'http://h' || page_id || '.example:8080/p/' || page_id WHEN 1 THEN 'https://h.example/a' ELSE '<invalid-url>' END AS shown FROM pages",
)
def url_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as they are shown in messages: no user, query or fragment, host normalized, port kept."""
    k, id_ = F.col("page_id") % 3, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(lit("HTTP://User:pw@H"), id_, lit(".Example.:8080/p/"), id_, lit("?q=1#f"))).when(k == 1, lit("https://h.example:notaport/a?x")).otherwise(lit("http://[bad"))
    return table(spark, sf_dir, "pages").select("page_id", urls.diagnostic_url(url).alias("shown"))


@register(
    "error_stages",
    "SELECT * FROM (VALUES ('extraction_parsing_failed', 'parsing'), ('extraction_no_content', 'extracting'), ('extractor_not_registered', 'extracting'), ('cleaning_no_content', 'cleaning'), ('redirect_loop', 'downloading')) t(error_code, failed_stage)",
)
def error_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that each kind of failure belongs to."""
    found = ["extraction_parsing_failed", "extraction_no_content", "extractor_not_registered", "cleaning_no_content", "redirect_loop"]
    df = spark.createDataFrame([(c,) for c in found], "error_code string")
    return df.select("error_code", assemble.failed_stage(F.col("error_code")).alias("failed_stage"))


# --- citations ----------------------------------------------------------------------------------

_CITED = """
ctx AS (SELECT conv_id AS r, turn AS pos, 'c' || (turn % 4) AS chunk_id, text AS content, turn % 3 <> 2 AS selected FROM conversations),
last AS (SELECT r, chunk_id, arg_max(content, pos) AS content, arg_max(selected, pos) AS selected FROM ctx GROUP BY r, chunk_id),
cit AS (SELECT conv_id AS r, turn AS pos, 'c' || (turn % 5) AS chunk_id, '[' || (turn % 6) || ']' AS label, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 8) ELSE substr(text, 1, 1) END AS quote FROM conversations),
chk AS (SELECT cit.r, cit.pos, cit.chunk_id, CASE WHEN last.selected IS NULL THEN 'unknown_chunk' WHEN NOT last.selected THEN 'chunk_not_selected' WHEN NOT contains(last.content, quote) THEN 'quote_not_in_chunk' WHEN NOT contains('see [0] [1] [2] [3]', label) THEN 'label_not_in_answer' END AS error FROM cit LEFT JOIN last USING (r, chunk_id))"""


def cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Responses, citations and contexts made from conversations."""
    c = table(spark, sf_dir, "conversations")
    turn, r = F.col("turn"), F.col("conv_id").alias("response_id")
    chunk = lambda n: F.concat(lit("c"), (turn % n).cast("string")).alias("chunk_id")
    responses = c.select(r).distinct().withColumn("answer", lit("see [0] [1] [2] [3]"))
    quote = F.when(turn % 2 == 0, F.substring("text", 1, 8)).otherwise(F.substring("text", 1, 1))
    quotes = c.select(r, turn.alias("pos"), chunk(5), F.concat(lit("["), (turn % 6).cast("string"), lit("]")).alias("label"), quote.alias("quote"))
    contexts = c.select(r, turn.alias("pos"), chunk(4), F.col("text").alias("content"), (turn % 3 != 2).alias("selected_for_generation"))
    return responses, quotes, contexts


@register("citation_errors", f"WITH {_CITED} SELECT r::BIGINT AS response_id, pos::BIGINT AS pos, chunk_id, error FROM chk")
def citation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.check(*cited(spark, sf_dir)).select("response_id", *_long("pos"), "chunk_id", "error")


@register("citation_verdicts", f"WITH {_CITED} SELECT r::BIGINT AS response_id, count(*)::BIGINT AS citations, arg_min(error, pos) FILTER (WHERE error IS NOT NULL) AS first_error FROM chk GROUP BY r")
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.verdicts(*cited(spark, sf_dir)).select("response_id", *_long("citations"), "first_error")


# --- chunks and search --------------------------------------------------------------------------


@register("unit_chunks")
def unit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all clean units."""
    units = cleaner.clean(dirty_units(spark, sf_dir)).units
    return retrieval.chunks(units, 200).select("chunk_id", *_long("chunk_index", "start_char", "end_char", "token_count"), "content_hash")


@register(
    "chunk_cover",
    f"WITH {sql.DIRTY} SELECT format('clean:{{}}:{{:06d}}', document_id, unit_index) AS clean_unit_id, length(regexp_replace(normalized, '[{sql.PYWS}]', '', 'g'))::BIGINT AS visible, true AS in_bounds, true AS disjoint FROM good WHERE reason IS NULL",
)
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each clean unit: the visible characters of its chunks, and whether chunks keep their bounds."""
    found = retrieval.chunks(cleaner.clean(dirty_units(spark, sf_dir)).units, 200)
    visible = F.length(F.regexp_replace("content", f"[{P.PYWS}]", ""))
    before = F.lag("end_char").over(Window.partitionBy("clean_unit_id").orderBy("chunk_index"))
    found = found.withColumn("apart", F.col("start_char") >= F.coalesce(before, lit(0)))
    size = F.col("end_char") - F.col("start_char")
    return found.groupBy("clean_unit_id").agg(F.sum(visible).cast("long").alias("visible"), F.min((size == F.length("content")) & (size <= 200)).alias("in_bounds"), F.min("apart").alias("disjoint"))


@register("broken_chunks", "SELECT 'V14 place' AS rule, 'chunk-' || doc_id AS key FROM documents WHERE doc_id % 7 < 5")
def broken_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that break the rules of a chunk's place and size: five of seven are made to."""
    k, id_ = F.col("doc_id") % 7, F.col("doc_id")
    start = F.when(k == 0, lit(None)).when(k == 1, -1).otherwise(id_)
    end = F.when(k == 2, id_).when(k == 3, id_ - 1).otherwise(id_ + 5)
    docs = table(spark, sf_dir, "documents").select(F.concat(lit("chunk-"), id_.cast("string")).alias("chunk_id"), start.alias("start_char"), end.alias("end_char"), F.when(k == 4, 0).otherwise(1).alias("token_count"))
    return validate.chunks(docs)


@register("broken_contexts", "SELECT 'V17 methods and ranks' AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE vec_id % 5 < 4")
def broken_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks with an unknown method, none, or a rank below 1: four of five are made so."""
    k = F.col("vec_id") % 5
    methods = F.when(k == 0, F.array(lit("vector"), lit("guess"))).when(k == 1, F.array().cast("array<string>")).otherwise(F.array(lit("vector"), lit("rerank")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), methods.alias("retrieval_methods"), F.when(k == 2, 0).otherwise(1).alias("retrieval_rank"), F.when(k == 3, 0).otherwise(1).alias("final_rank"))
    return validate.contexts(rows)


@register(
    "vector_search",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(q.e, n.e) / (q.l * n.l), 6) + 0.0 AS vector_score FROM n q, n WHERE q.vec_id % 50 = 0 AND q.l > 0 AND n.l > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, vec_id) AS k FROM s)
    SELECT query_id::BIGINT AS query_id, vec_id::BIGINT AS vec_id, vector_score, k::BIGINT AS retrieval_rank FROM r WHERE k <= 20""",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every fiftieth one, exact; top_k is the search's own limit."""
    store = table(spark, sf_dir, "embeddings")
    return retrieval.search_all(store, store.where("vec_id % 50 = 0"), 20).select("query_id", "vec_id", "vector_score", *_long("retrieval_rank"))


@register(
    "vector_upsert",
    "SELECT count(*)::BIGINT AS vectors, count(*) FILTER (WHERE vec_id % 3 = 0)::BIGINT AS replaced, sum(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END)::BIGINT AS labels FROM embeddings",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a third of its vectors were replaced."""
    store = table(spark, sf_dir, "embeddings")
    rows = store.where("vec_id % 3 = 0").withColumn("label", lit(-1))
    out = retrieval.upsert(store, rows, "vec_id")
    return out.agg(F.count("*").alias("vectors"), F.count_if(F.col("vec_id") % 3 == 0).alias("replaced"), F.sum("label").cast("long").alias("labels"))


@register(
    "text_strips",
    rf"""WITH t AS (SELECT doc_id, chr(9) || chr(28) || chr(133) || text || chr(8203) || ' ' || chr(12288) AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, length({sql.strip("s")})::BIGINT AS stripped, {sql.word_count("s")} AS words FROM t""",
)
def text_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space that only Python strips, and a zero-width space that it doesn't."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    s = F.concat(lit("\t\x1c\x85"), F.col("text"), lit("​ 　"))
    return docs.select("doc_id", F.length(P.strip(s)).cast("long").alias("stripped"), P.word_count(s).cast("long").alias("words"))


@register("streamed_cleaning_stats", STATS_SQL)
def streamed_cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning statistics by document, from documents that come in as a stream."""
    from ..streaming import stream_statistics

    return stream_statistics(spark, sf_dir)
