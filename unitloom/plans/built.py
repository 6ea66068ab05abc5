"""Registered queries over pages and Word files that are built from the tables, block by block.

What such a page must give is plain from how it was built, so DuckDB can say it without a parser.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..registry import register
from ..schemas import SOURCES
from ..session import table
from ..sources import docx, html, service
from . import sql
from .cleaning import _long

lit = F.lit


# --- HTML ---------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, lit(sign), lit(name))
    return c


def _markup(line: Column, i: Column) -> Column:
    """Ten kinds of block, by the line's number."""
    x, level = _escaped(line), (F.floor(i / 10) % 3 + 1).cast("string")
    plain = F.regexp_replace(line, "[^A-Za-z0-9 ]", "")
    kinds = [
        F.concat(lit("<h"), level, lit(">"), x, lit("</h"), level, lit(">")),
        F.concat(lit("<p>"), x, lit(" <b>bold</b></p>")),
        F.concat(lit("<ul><li>"), x, lit("<ol><li>in "), x, lit("</li><li> </li></ol></li><li>two</li></ul>")),
        F.concat(lit("<table><caption>cap "), x, lit("</caption><thead><tr><th>k</th><th>v</th></tr></thead><tr><td>"), plain, lit("</td><td>a<br>b\\c<table><tr><td>in</td></tr></table></td></tr></table>")),
        F.concat(lit("<pre>\n "), x, lit("\n  x</pre>")),
        F.concat(lit("<blockquote>"), x, lit(" <i>q</i></blockquote>")),
        F.concat(lit("<section>"), x, lit("<br>end</section>")),
        F.concat(lit("<nav><p>n "), x, lit("</p></nav>")),
        F.concat(lit("<script>var a = '</p>';</script><p>"), x, lit("<style>p {}</style> after</p>")),
        F.concat(lit("<blockquote>own "), x, lit("<p>"), x, lit("</p><div>leaf</div></blockquote>")),
    ]
    out = kinds[-1]
    for k in range(len(kinds) - 1):
        out = F.when(i % 10 == k, kinds[k]).otherwise(out)
    return out


def built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each document, a block for each line; roots and character sets by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    k, name = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    body = F.array_join(F.transform(F.split("text", "\n"), _markup), "")
    open_, close = (F.when(k == 0, "").when(k == 1, f"<{e}main>").otherwise(f"<{e}article>") for e in ("", "/"))
    page = F.concat(lit("<html><head><title> Doc "), name, lit("</title></head><body>"), open_, body, close, lit("</body></html>"))
    c = F.col("doc_id") % 4
    raw = F.when(c == 1, F.encode(page, "UTF-16")).when(c == 2, F.concat(F.unhex(lit("EFBBBF")), F.encode(page, "UTF-8"))).otherwise(F.encode(page, "UTF-8"))
    charset = F.when(c == 1, "utf-16").when(c == 3, "no-such-set")
    none = lit(None).cast("string")
    return docs.select(F.concat(lit("src-"), name).alias("source_id"), F.concat(lit("doc-"), name).alias("document_id"), lit("url").alias("source_type"), none.alias("source_uri"), none.alias("original_filename"), lit("text/html").alias("media_type"), charset.alias("charset"), raw.alias("content_bytes"))


#: No limit of HTML pages counts here; the longest documents have more blocks than a page may have.
WIDE = {"max_input_bytes": 1 << 40, "max_candidate_blocks": 1 << 30, "max_units": 1 << 30, "max_total_extracted_characters": 1 << 60}


def _s(x: str) -> str:
    return sql.linewise(sql.nbsp(sql.lines(x)))


_ROW = "SELECT doc_id, i, {s} AS s, '{kind}' AS block_type, {tag} AS html_tag, '{ctype}' AS content_type, {text} AS content, {quoted} AS quoted, {item}::BIGINT AS item, {parent}::BIGINT AS parent FROM l WHERE {where}"


def _block(k: int, s: int, kind: str, tag: str, text: str, ctype: str = "paragraph", quoted: str = "NULL", item: str = "NULL", parent: str = "NULL", where: str = "true") -> str:
    return _ROW.format(s=s, kind=kind, tag=tag, ctype=ctype, text=text, quoted=quoted, item=item, parent=parent, where=f"i % 10 = {k} AND {where}")


_ITEM = _s(f"replace({_s('line')}, chr(10), ' ')")
_PRE = rf"regexp_replace({sql.nbsp(sql.lines('chr(10) || chr(32) || line || chr(10) || chr(32) || chr(32) || chr(120)'))}, '\A[{sql.PYWS}]*\n|\n[{sql.PYWS}]*\z', '', 'g')"
_PLAIN = "trim(regexp_replace(regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
_BUILT = f"""
l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
b AS (
  SELECT doc_id, -1 AS i, 0 AS s, 'document_title' AS block_type, 'title' AS html_tag, 'paragraph' AS content_type, 'Doc ' || doc_id AS content, NULL AS quoted, NULL::BIGINT AS item, NULL::BIGINT AS parent FROM documents WHERE text IS NOT NULL
  UNION ALL {_block(0, 0, "heading", "'h' || (i // 10 % 3 + 1)", _s("line"))}
  UNION ALL {_block(1, 0, "paragraph", "'p'", _s("line || ' bold'"))}
  UNION ALL {_block(2, 0, "list_item", "'li'", _ITEM, "list", item="i // 10 * 4")}
  UNION ALL {_block(2, 1, "list_item", "'li'", _s(f"replace({_s(chr(39) + 'in ' + chr(39) + ' || line')}, chr(10), ' ')"), "list", item="i // 10 * 4 + 1", parent=f"CASE WHEN {_ITEM} <> '' THEN i // 10 * 4 END")}
  UNION ALL {_block(2, 2, "list_item", "'li'", "''", "list", item="i // 10 * 4 + 2")}
  UNION ALL {_block(2, 3, "list_item", "'li'", "'two'", "list", item="i // 10 * 4 + 3")}
  UNION ALL {_block(3, 0, "table_caption", "'caption'", _s("'cap ' || line"))}
  UNION ALL {_block(3, 1, "table", "'table'", f"'k' || chr(9) || 'v' || chr(10) || {_PLAIN} || chr(9) || 'a' || chr(92) || 'nb' || chr(92) || chr(92) || 'c'", "table")}
  UNION ALL {_block(4, 0, "code_block", "'pre'", _PRE, "code")}
  UNION ALL {_block(5, 0, "blockquote", "'blockquote'", _s("line || ' q'"))}
  UNION ALL {_block(6, 0, "container_text", "'section'", _s("line || chr(10) || 'end'"))}
  UNION ALL {_block(7, 0, "paragraph", "'p'", _s("'n ' || line"), where="doc_id % 3 <> 0")}
  UNION ALL {_block(8, 0, "paragraph", "'p'", _s("line || ' after'"))}
  UNION ALL {_block(9, 0, "blockquote_text", "'blockquote'", _s("'own ' || line"), quoted="'blockquote'")}
  UNION ALL {_block(9, 1, "paragraph", "'p'", _s("line"), quoted="'blockquote'")}
  UNION ALL {_block(9, 2, "blockquote_text", "'div'", "'leaf'", quoted="'blockquote'")}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1 AS block_index, {sql.blank("content")} AS blank,
  CASE WHEN block_type IN ('heading', 'paragraph', 'code_block', 'table') THEN row_number() OVER (PARTITION BY doc_id, block_type ORDER BY i, s) - 1 WHEN block_type = 'table_caption' THEN i // 10 END AS kind_index,
  CASE WHEN block_type = 'heading' AND NOT ({sql.blank("content")}) THEN i // 10 % 3 + 1 END AS lvl FROM b),
h AS (SELECT *, {", ".join(f"max(CASE WHEN lvl = {k} THEN i END) OVER w AS h{k}, coalesce(max(CASE WHEN lvl < {k} THEN i END) OVER w, -1) AS u{k}" for k in (1, 2, 3))} FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i, s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i, h.s) - 1 AS unit_index,
  array_to_string(list_filter([{", ".join(f"CASE WHEN h{k} > u{k} THEN t{k}.content END" for k in (1, 2, 3))}], lambda x: x IS NOT NULL), ' > ') AS path
  FROM h {" ".join(f"LEFT JOIN n t{k} ON t{k}.doc_id = h.doc_id AND t{k}.i = h.h{k} AND t{k}.s = 0" for k in (1, 2, 3))} WHERE NOT h.blank)"""


@register(
    "built_page_units",
    f"""WITH {_BUILT} SELECT format('raw:doc-{{}}:{{:06d}}', doc_id, unit_index) AS raw_unit_id, block_index::BIGINT AS block_index, block_type, html_tag, content_type, sha256(content) AS content_hash, quoted AS container, kind_index::BIGINT AS kind_index,
    item AS list_item, parent AS list_parent, CASE WHEN item IS NOT NULL THEN i // 10 * 2 + (item % 4 IN (1, 2))::INT END::BIGINT AS list_container, CASE item % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END::BIGINT AS list_place,
    CASE WHEN item IS NOT NULL THEN (item % 4 IN (1, 2))::INT END::BIGINT AS list_depth, CASE WHEN item IS NOT NULL THEN CASE WHEN item % 4 IN (1, 2) THEN 'ordered' ELSE 'unordered' END END AS list_type,
    CASE WHEN block_type = 'table' THEN '2 2 2,2 tsv_escaped_v1' END AS shape, path FROM u""",
)
def built_page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the built pages: blocks, tags, containers, counters, lists, tables and headings."""
    out = html.extract_html(built_pages(spark, sf_dir), WIDE).units
    m = lambda name: F.col(f"extra_metadata.{name}")
    kind = F.coalesce(m("heading_index"), m("paragraph_index"), m("code_block_index"), m("table_index"))
    shape = F.when(m("block_type") == "table", F.concat_ws(" ", m("row_count").cast("string"), m("column_count").cast("string"), F.array_join(m("row_column_counts").cast("array<string>"), ","), m("serialization_format")))
    long = {"list_item": "list_item_global_index", "list_parent": "parent_emitted_list_item_global_index", "list_container": "list_container_global_index", "list_place": "list_item_index_in_container", "list_depth": "list_depth"}
    return out.select(
        "raw_unit_id", m("block_index").cast("long").alias("block_index"), m("block_type").alias("block_type"), m("html_tag").alias("html_tag"), "content_type", "content_hash", m("nearest_semantic_container").alias("container"),
        kind.cast("long").alias("kind_index"), *[m(c).cast("long").alias(a) for a, c in long.items()], m("list_type").alias("list_type"), shape.alias("shape"), F.array_join("heading_path", " > ").alias("path"),
    )


_KINDS = ["document_title", "heading", "paragraph", "code_block", "list_item", "table_caption", "table", "blockquote", "blockquote_text", "container_text"]


@register(
    "built_page_stats",
    f"""WITH {_BUILT}, a AS (SELECT doc_id, count(*) FILTER (WHERE i % 10 = 8) AS s, count(*) FILTER (WHERE i % 10 = 7) AS v, count(*) FILTER (WHERE i % 10 = 3) AS t FROM l GROUP BY doc_id)
    SELECT 'doc-' || doc_id AS document_id, count(*)::BIGINT AS observed_blocks, count(*) FILTER (WHERE NOT blank)::BIGINT AS total_units, count(*) FILTER (WHERE blank)::BIGINT AS skipped_items, sum(CASE WHEN blank THEN 0 ELSE length(content) END)::BIGINT AS characters,
    {", ".join(f"count(*) FILTER (WHERE NOT blank AND block_type = '{k}')::BIGINT AS emitted_{k}" for k in _KINDS)}, (doc_id % 4 = 3)::BIGINT AS warning_count,
    CASE WHEN doc_id % 3 = 0 OR count(*) FILTER (WHERE NOT blank AND block_type <> 'document_title') = 0 THEN 'body_fallback' WHEN doc_id % 3 = 1 THEN 'single_usable_main' ELSE 'single_usable_article' END AS strategy,
    (any_value(a.s) * 2)::VARCHAR AS removed, CASE WHEN doc_id % 3 = 0 THEN any_value(a.v) ELSE 0 END::VARCHAR AS ignored, any_value(a.t)::VARCHAR AS nested_tables, CASE doc_id % 4 WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, CASE doc_id % 4 WHEN 1 THEN 'True' WHEN 3 THEN 'False' END AS charset_valid FROM n JOIN a USING (doc_id) GROUP BY doc_id""",
)
def built_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and facts of the built pages: roots, removed elements, character sets."""
    out = html.extract_html(built_pages(spark, sf_dir), WIDE).stats
    fact = lambda k, name: F.col("facts")[k].alias(name)
    return out.select(
        "document_id", *_long("observed_blocks", "total_units", "skipped_items", "characters", *[f"emitted_{k}" for k in _KINDS], "warning_count"),
        fact("selected_root_strategy", "strategy"), fact("removed_non_content_tag_count", "removed"), fact("ignored_semantic_container_count", "ignored"), fact("nested_table_ignored_count", "nested_tables"),
        fact("detected_encoding", "encoding"), fact("declared_charset_valid", "charset_valid"),
    )


# --- Word tables --------------------------------------------------------------------------------

_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _cell(text: str, merge: str = "", span: int = 1) -> str:
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{merge}</w:tcPr><w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p></w:tc>'


def table_docx(name: str, brand: str, kind: str) -> bytes:
    """A Word file with a deep heading, a table of merged cells, a blank table and a drawing."""
    start, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [_cell(name, start) + _cell(brand), _cell("", on) + _cell(kind), _cell("", on) + _cell("x\\y"), _cell("wide", span=2)]
    body = [
        f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>{escape(brand)}</w:t></w:r></w:p>',
        '<w:p><w:pPr><w:pStyle w:val="D"/></w:pPr><w:r><w:t>deep</w:t></w:r></w:p>',
        f'<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:br w:type="page"/><w:t>c</w:t></w:r><w:hyperlink><w:r><w:t>{escape(kind)}</w:t></w:r></w:hyperlink><w:ins><w:r><w:t>no</w:t></w:r></w:ins></w:p>',
        f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>",
        f"<w:tbl><w:tr>{_cell(' ')}</w:tr></w:tbl>",
        "<w:sdt/>",
        "<w:sectPr/>",
    ]
    styles = '<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Body"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:styleId="D"><w:name w:val="Heading 12"/></w:style>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_SPACE}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_SPACE}>{styles}</w:styles>")
    return out.getvalue()


def table_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"part-{x}" for x in batch.column(0).to_pylist()]
            raw = [table_docx(*x) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            none = pa.nulls(len(names), pa.string())
            yield pa.record_batch([pa.array([f"src-{n}" for n in names]), pa.array(names), pa.array(["docx"] * len(names)), none, none, none, none, pa.array(raw, pa.binary())], SOURCES.fieldNames())

    return part.mapInArrow(run, SOURCES)


_PART = """SELECT 'raw:part-' || p_partkey || ':' || lpad(u::VARCHAR, 6, '0') AS raw_unit_id, u::BIGINT AS block_index, block_type, style_name, sha256(content) AS content_hash, path, section, shape FROM part, LATERAL (VALUES
  (0, 'heading', 'Heading 2', p_brand, p_brand, p_brand, NULL), (1, 'heading', 'Heading 12', 'deep', p_brand || ' > deep', 'deep', NULL),
  (2, 'paragraph', 'Body', 'a' || chr(9) || 'b' || chr(10) || 'c' || p_type, p_brand || ' > deep', 'deep', NULL),
  (3, 'table', NULL, p_name || chr(9) || p_brand || chr(10) || p_name || chr(9) || p_type || chr(10) || p_name || chr(9) || 'x' || chr(92) || chr(92) || 'y' || chr(10) || 'wide' || chr(9) || 'wide', p_brand || ' > deep', 'deep', '4 2 2,2,2,2')) v(u, block_type, style_name, content, path, section, shape)"""


@register("docx_tables", _PART)
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cells, breaks, hyperlinks, a heading of level 12 and style names of Word files."""
    out = docx.extract_docx(table_sources(spark, sf_dir)).units
    m = lambda name: F.col(f"extra_metadata.{name}")
    shape = F.when(m("block_type") == "table", F.concat_ws(" ", m("row_count").cast("string"), m("column_count").cast("string"), F.array_join(m("row_column_counts").cast("array<string>"), ",")))
    return out.select("raw_unit_id", m("block_index").cast("long").alias("block_index"), m("block_type").alias("block_type"), m("style_name").alias("style_name"), "content_hash", F.array_join("heading_path", " > ").alias("path"), "section", shape.alias("shape"))


@register("docx_stats", "SELECT 'part-' || p_partkey AS document_id, 4::BIGINT AS total_units, 6::BIGINT AS observed_blocks, 2::BIGINT AS skipped_items, 1::BIGINT AS warning_count, 2::BIGINT AS observed_heading, 1::BIGINT AS observed_paragraph, 2::BIGINT AS observed_table, 1::BIGINT AS observed_unsupported FROM part")
def docx_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of Word files: emitted, blank and unsupported blocks."""
    names = ["total_units", "observed_blocks", "skipped_items", "warning_count", "observed_heading", "observed_paragraph", "observed_table", "observed_unsupported"]
    return docx.extract_docx(table_sources(spark, sf_dir)).stats.select("document_id", *_long(*names))


@register("docx_warnings", "SELECT 'part-' || p_partkey AS document_id, 'extracting' AS stage, 'unsupported_docx_element' AS warning_code, 5::BIGINT AS item_index, 'sdt' AS details, true AS told FROM part")
def docx_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of body elements that are neither paragraph nor table."""
    out = docx.extract_docx(table_sources(spark, sf_dir)).warnings
    return out.select("document_id", "stage", "warning_code", *_long("item_index"), "details", F.col("message").isNotNull().alias("told"))


@register("service_built_units", f"WITH {_BUILT} SELECT 'url' AS source_type, count(*)::BIGINT AS units, count(DISTINCT doc_id)::BIGINT AS documents FROM u UNION ALL SELECT 'docx', 4 * count(*)::BIGINT, count(*)::BIGINT FROM part")
def service_built_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by source type when built pages and Word files come in together."""
    wide = service.Registry()
    wide.register("url", lambda sources: html.extract_html(sources, WIDE))
    both = built_pages(spark, sf_dir).unionByName(table_sources(spark, sf_dir))
    return service.extract(both, wide).units.groupBy("source_type").agg(F.count("*").alias("units"), F.countDistinct("document_id").alias("documents"))
