import pytest
from pyspark.sql import functions as F

from unitloom.operators import citations, retrieval, validate
from unitloom.sources.fetch_replay import content_length, content_type, replay


def test_citation_ladder(spark):
    responses = spark.createDataFrame([("r", "see [1]"), ("none", "x")], "response_id string, answer string")
    quotes = spark.createDataFrame([("r", 0, "[1]", "a", "new"), ("r", 1, "[2]", "a", "new"), ("r", 2, "[1]", "a", "old"), ("r", 3, "[1]", "b", "x"), ("r", 4, "[1]", "zz", "x")], "response_id string, pos int, label string, chunk_id string, quote string")
    contexts = spark.createDataFrame([("r", 0, "a", "old text", True), ("r", 1, "a", "new text", True), ("r", 2, "b", "x", False)], "response_id string, pos int, chunk_id string, content string, selected_for_generation boolean")
    got = {r.pos: r.error for r in citations.check(responses, quotes, contexts).collect()}
    assert got == {0: None, 1: "label_not_in_answer", 2: "quote_not_in_chunk", 3: "chunk_not_selected", 4: "unknown_chunk"}
    assert {r.response_id: r.first_error for r in citations.verdicts(responses, quotes, contexts).collect()} == {"r": "label_not_in_answer", "none": None}


@pytest.mark.parametrize(("question", "k"), [("", 5), ("  ", 5), ("x" * 3001, 5), ("x", 0), ("x", 21), ("x", True)])
def test_query_bounds(question, k):
    with pytest.raises(retrieval.QueryInputError):
        retrieval.check_query(question, k)


def test_query_is_stripped():
    assert retrieval.check_query(" x ") == ("x", 5)


def test_chunks_cover_the_words(spark):
    text = "one two  three\nfour " + "x" * 50 + " five six"
    units = spark.createDataFrame([("c", "d", "s", "url", text)], "clean_unit_id string, document_id string, source_id string, source_type string, content string")
    rows = retrieval.chunks(units, 12).orderBy("chunk_index").collect()
    assert "".join(r.content for r in rows).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    for r in rows:
        assert text[r.start_char : r.end_char] == r.content and 0 < len(r.content) <= 12
    assert validate.chunks(retrieval.chunks(units, 12)).count() == 0


def test_search_and_upsert(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0), (4, [0.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.retrieval_rank) for r in retrieval.search(store, [1.0, 0.1], 2).collect()] == [(1, 1), (3, 2)]
    many = retrieval.search_all(store, store.where("vec_id in (1, 4)"), 2)
    assert [tuple(r) for r in many.orderBy("retrieval_rank").collect()] == [(1, 1, 1.0, 1), (1, 3, 0.707107, 2)]
    assert retrieval.search_all(store, store.where("false"), 2).count() == 0 and retrieval.search_all(store.where("false"), store, 2).count() == 0
    after = retrieval.upsert(store, store.where("vec_id = 2").withColumn("label", F.lit(9)), "vec_id")
    assert {r.vec_id: r.label for r in after.collect()} == {1: 0, 2: 9, 3: 0, 4: 0}


def headers(*pairs):
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs])


@pytest.mark.parametrize(("values", "want"), [(["5"], (5, False)), (["5", "5"], (5, False)), (["5, 6"], (None, True)), (["x"], (None, True)), (["-1"], (None, True)), ([], (None, False))])
def test_content_length(spark, values, want):
    h = headers(*[("Content-Length", v) for v in values]) if values else F.array().cast("array<struct<name:string,value:string>>")
    assert tuple(spark.range(1).select(content_length(h).alias("x")).first().x) == want


@pytest.mark.parametrize(("value", "want"), [("text/html", ("text/html", None, None)), ('Text/HTML; charset="UTF-8"', ("text/html", "UTF-8", None)), ("image/png", ("image/png", None, "unsupported_content_type"))])
def test_content_type(spark, value, want):
    assert tuple(spark.range(1).select(content_type(headers(("content-type", value))).alias("x")).first().x) == want


def test_replay_refuses_private_targets(spark):
    requests = spark.createDataFrame([(1, "http://a.example/"), (2, "http://10.0.0.1/"), (3, "http://unknown.example/"), (4, "http://b.example/")], "request_id long, url string")
    table = spark.createDataFrame([("http://a.example/", 301, [("Location", "http://inner.example/")], b""), ("http://b.example/", 200, [("content-type", "text/html")], b"ok")], "url string, status int, headers array<struct<name:string,value:string>>, body binary")
    dns = spark.createDataFrame([("a.example", ["8.8.8.8"]), ("b.example", ["8.8.8.8"]), ("inner.example", ["8.8.8.8", "10.1.1.1"])], "hostname string, addresses array<string>")
    got = {r.request_id: (r.error_code, r.retryable, r.redirect_count) for r in replay(requests, table, dns).collect()}
    assert got == {1: ("blocked_destination", False, 1), 2: ("blocked_destination", False, 0), 3: ("dns_resolution_failed", True, 0), 4: (None, False, 0)}


def test_a_provider_embeds_a_column(spark):
    rows = spark.createDataFrame([("abc",), ("",)], "content string")
    out = retrieval.embed(rows, lambda c: F.array(F.length(c).cast("float")))
    assert sorted(r.embedding for r in out.collect()) == [[0.0], [3.0]]
