import pytest
from pyspark.sql import functions as F

from unitloom.plans.extraction import docx_bytes
from unitloom.schemas import SOURCES
from unitloom.sources import docx, html, pdf, service
from unitloom.sources.html_tree import Page


def kinds(text):
    return [(b["block_type"], b.get("cells", b.get("content"))) for b in Page(text).blocks()]


HTML = {
    "order": ("<title>T</title><body><main><h1>A</h1><p>b <b>c</b></p><pre>\n x\n  y\n</pre><div>leaf</div></main></body>", [("document_title", "T"), ("heading", "A"), ("paragraph", "b c"), ("code_block", " x\n  y"), ("container_text", "leaf")]),
    "two mains fall to body": ("<body><main><p>a</p></main><main><p>b</p></main><nav><p>n</p></nav></body>", [("paragraph", "a"), ("paragraph", "b")]),
    "boilerplate in main stays": ("<body><main><p>a</p><nav><p>n</p></nav></main></body>", [("paragraph", "a"), ("paragraph", "n")]),
    "boilerplate in body goes": ("<body><header><p>h</p></header><p>a</p><aside>x</aside></body>", [("paragraph", "a")]),
    "article root": ("<body><p>out</p><article><p>in</p></article></body>", [("paragraph", "in")]),
    "script goes": ("<body><p>a<script>var t='</p>';</script>b</p></body>", [("paragraph", "ab")]),
    "comments are text": ("<body><p>a<!--c-->b</p><pre>x<!--c-->y</pre></body>", [("paragraph", "acb"), ("code_block", "xy")]),
    "open paragraphs nest": ("<body><p>a<p>b</body>", [("paragraph", "ab")]),
    "lists": ("<ul><li>a<ul><li>b</li></ul></li><li> </li></ul>", [("list_item", "a"), ("list_item", "b"), ("list_item", "")]),
    "table": ("<table><caption>C</caption><tr><th>a</th><td>b<table><tr><td>n</td></tr></table></td></tr><tbody><tr><td>c<br>d</td></tr></tbody></table>", [("table_caption", "C"), ("table", [["a", "b"], ["c\nd"]])]),
    "blockquote": ("<blockquote>q <i>r</i></blockquote><blockquote>s<p>t</p><div>u</div></blockquote>", [("blockquote", "q r"), ("blockquote_text", "s"), ("paragraph", "t"), ("blockquote_text", "u")]),
    "mixed div loses text": ("<div>lost<p>kept</p></div>", [("paragraph", "kept")]),
    "unmatched end tags": ("<body></i><p>a</p></b></body>", [("paragraph", "a")]),
}


@pytest.mark.parametrize("name", HTML)
def test_html_blocks(name):
    text, want = HTML[name]
    assert kinds(text) == want


def test_title_references():
    text = "<title>a&amp;lt; &amp &eacute; <i>b</i></title><p>&amp</p>"
    assert kinds(text) == [("document_title", "a&lt; & é b"), ("paragraph", "&")]
    found = Page(text, {"&lt;": "<", "&amp;": "&"}).blocks()
    assert [b["content"] for b in found] == ["a&lt; &amp &eacute; <i>b</i>", "&"]


def test_list_metadata():
    found = list(Page("<ol><li>a<ul><li>b</li></ul></li></ol>").blocks())
    assert [(b["list_type"], b["list_depth"], b["list_container_global_index"], b["list_item_global_index"], b["parent_emitted_list_item_global_index"]) for b in found] == [("ordered", 0, 0, 0, None), ("unordered", 1, 1, 1, 0)]


def test_deep_nesting_is_no_limit():
    assert kinds("<div>" * 5000 + "<p>x</p>") == [("paragraph", "x")]


def sources(spark, rows):
    """rows: (document, type, media type, charset, bytes)."""
    data = [("s-" + d, d, t, None, None, m, c, b) for d, t, m, c, b in rows]
    return spark.createDataFrame(data, SOURCES)


def test_html_extraction(spark):
    page = "<h1>A</h1><p>x</p><h3>B</h3><p>y</p><h2>C</h2><p> </p><table><tr><td>a\tb</td><td>é</td></tr></table>".encode()
    rows = [("ok", "url", "Text/HTML; charset=utf-8", "utf-8", page), ("type", "pdf", None, None, b"x"), ("media", "url", "image/png", None, b"x"), ("empty", "url", None, None, b""), ("none", "url", None, None, b"<p> </p>"), ("big", "url", None, None, b"x" * 2000), ("charset", "url", None, "no-such", b"<p>\xe9</p>")]
    out = html.extract_html(sources(spark, rows), {"max_input_bytes": 1000})
    units = out.units.where("document_id = 'ok'").orderBy("unit_index").collect()
    assert [u.content for u in units] == ["A", "x", "B", "y", "C", "a\\tb\té"]
    assert [u.heading_path for u in units] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C"]]
    assert [u.section for u in units] == ["A", "A", "B", "B", "C", "C"]
    assert units[-1].extra_metadata.row_column_counts == [2] and units[-1].extra_metadata.block_index == 6
    errors = {r.document_id: (r.error_code, r.failed_stage) for r in out.errors.collect()}
    assert errors == {"type": ("extraction_source_type_mismatch", "extracting"), "media": ("extraction_parsing_failed", "parsing"), "empty": ("extraction_service_input_error", "extracting"), "none": ("extraction_no_content", "extracting"), "big": ("extraction_parsing_failed", "parsing")}
    assert [(r.document_id, r.warning_code, r.stage) for r in out.warnings.collect()] == [("charset", "invalid_declared_charset", "parsing")]
    assert out.units.where("document_id = 'charset'").first().content == "é"
    stats = {r.document_id: r for r in out.stats.collect()}
    assert (stats["ok"].total_units, stats["ok"].observed_blocks, stats["ok"].skipped_items) == (6, 7, 1)


@pytest.mark.parametrize("limit", ["max_units", "max_candidate_blocks", "max_total_extracted_characters"])
def test_html_limits(spark, limit):
    src = sources(spark, [("at", "url", None, None, b"<p>a</p><p>b</p>"), ("over", "url", None, None, b"<p>a</p><p>b</p><p>c</p>")])
    out = html.extract_html(src, {limit: 2})
    assert [(r.document_id, r.details) for r in out.errors.collect()] == [("over", limit)]
    assert {r.document_id for r in out.units.collect()} == {"at"}


def test_docx(spark):
    raw = docx_bytes(["Top", "a", "", "b", "c", "Second", "d"])
    out = docx.extract_docx(sources(spark, [("d", "docx", None, None, raw), ("bad", "docx", None, None, b"no zip")]))
    units = out.units.orderBy("unit_index").collect()
    assert [(u.content, u.section, u.extra_metadata.block_index) for u in units] == [("Top", "Top", 0), ("a", "Top", 1), ("b", "Top", 3), ("c", "Top", 4), ("Second", "Second", 5), ("d", "Second", 6)]
    assert units[-1].heading_path == ["Top", "Second"]
    assert [(r.document_id, r.error_code) for r in out.errors.collect()] == [("bad", "extraction_parsing_failed")]


def test_pdf(spark):
    box = [0.0, 0.0, 10.0, 10.0]
    rows = [("d", "s", 1, 0, *box, "second\n", 0), ("d", "s", 0, 0, *box, "first", None), ("d", "s", 0, 1, float("nan"), *box[1:], "bad", 0), ("d", "s", 0, 2, *box, "image", 1), ("d", "s", 0, 3, *box, " \n", 0), ("e", "s", 0, 0, *box, None, 0)]
    blocks = spark.createDataFrame(rows, "document_id string, source_id string, page_index int, page_block_index int, x0 double, y0 double, x1 double, y1 double, text string, block_type int")
    blocks = blocks.withColumns({"source_uri": F.lit(None).cast("string"), "block_number": F.lit(None).cast("int")})
    pages = spark.createDataFrame([("d", "s", 0, None), ("d", "s", 1, None), ("d", "s", 2, None), ("e", "s", 0, None), ("f", "s", None, "locked")], "document_id string, source_id string, page_index int, status string")
    out = pdf.extract_pdf(blocks, pages)
    assert [(u.content, u.page_start, u.extra_metadata.document_block_index, u.heading_path) for u in out.units.orderBy("unit_index").collect()] == [("first", 1, 0, []), ("second\n", 2, 4, [])]
    assert [(w.warning_code, w.item_index) for w in out.warnings.collect()] == [("malformed_pdf_block", 1)]
    assert {r.document_id: r.error_code for r in out.errors.collect()} == {"e": "extraction_no_content", "f": "extraction_parsing_failed"}
    assert out.stats.first().facts == {"page_count": "3", "pages_with_text": "2", "blank_pages": "1"}


def test_service_dispatch(spark):
    src = sources(spark, [("h", "url", None, None, b"<p>x</p>"), ("w", "docx", None, None, docx_bytes(["y"])), ("p", "pdf", None, None, b"%PDF")])
    out = service.extract(src)
    assert {u.document_id: u.content for u in out.units.collect()} == {"h": "x", "w": "y"}
    assert [(r.document_id, r.error_code) for r in out.errors.collect()] == [("p", "extractor_not_registered")]
    assert "content_bytes" not in out.units.columns
