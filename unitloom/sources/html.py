"""HTML pages to blocks: guards as Catalyst filters, parsing in an Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import tsv
from ..operators.assemble import Extracted, OpenHeadings, assembled
from ..schemas import BLOCKS, HTML_LIMITS, METADATA
from . import html_tree

PARSER, VERSION = "html.parser", "1"
#: Media types that are taken for HTML.
MEDIA_TYPES = ["text/html", "application/xhtml+xml"]
SCHEMA = to_arrow_schema(BLOCKS)


def media_type_ok(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1)))).isin(MEDIA_TYPES)


def guard(sources: DataFrame, limits: dict[str, int]) -> Column:
    """Why a source isn't parsed at all, or null; plain comparisons that run before Python."""
    return (
        F.when(F.col("source_type") != "url", "extraction_source_type_mismatch")
        .when(~media_type_ok(F.col("media_type")), "extraction_parsing_failed:media_type")
        .when(F.length("content_bytes") > limits["max_input_bytes"], "extraction_parsing_failed:max_input_bytes")
        .when(F.col("content_bytes").isNull() | (F.length("content_bytes") == 0), "extraction_service_input_error")
    )


def parsed(sources: DataFrame, limits: dict[str, int] | None = None, title_references: Mapping[str, str] | None = None) -> DataFrame:
    """Blocks of every page, and a row for each document itself; narrow, no shuffle."""
    limits = HTML_LIMITS | (limits or {})
    most = limits["max_candidate_blocks"]
    guarded = sources.withColumn("failure", guard(sources, limits))
    rows = guarded.select("document_id", "source_id", "source_type", "source_uri", "charset", F.when(F.col("failure").isNull(), F.col("content_bytes")).alias("content_bytes"), "failure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                out += page_rows(row, most, title_references)
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, SCHEMA)
                    out = []
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return _tables(rows.mapInArrow(run, BLOCKS))


def page_rows(row: dict, most: int, title_references: Mapping[str, str] | None = None) -> list[dict]:
    """BLOCKS rows of one page; a page that can't be parsed has its failure and no blocks."""
    base = {k: row[k] for k in ("document_id", "source_id", "source_type", "source_uri")}
    if row["failure"]:
        return [base | {"failure": row["failure"]}]
    try:
        html, known, encoding = html_tree.decode(row["content_bytes"], row["charset"])
        page = html_tree.Page(html, title_references)
        found, headings = [], OpenHeadings()
        for index, block in enumerate(page.blocks()):
            if index > most:  # one more than allowed tells that there are too many
                break
            found.append(_row(base, index, block) | {"path": headings.path(block.get("heading_level"), block.get("content"))})
    except (RecursionError, ValueError, AssertionError) as error:
        return [base | {"failure": f"extraction_parsing_failed:{type(error).__name__}"}]
    facts = {"selected_root_tag": page.root.name, "selected_root_strategy": page.strategy, "removed_non_content_tag_count": page.removed, "ignored_semantic_container_count": page.ignored, "nested_table_ignored_count": page.nested_tables, "declared_charset": row["charset"], "declared_charset_valid": known, "charset_fallback_used": known is False, "detected_encoding": encoding}
    found.append(base | {"facts": [(k, str(v)) for k, v in facts.items() if v is not None]})
    if known is False:
        found.append(base | {"warning_code": "invalid_declared_charset", "warning_detail": row["charset"]})
    return found


_META = set(METADATA.fieldNames())


def _row(base: dict, index: int, block: dict) -> dict:
    meta = {k: v for k, v in block.items() if k in _META} | {"parser": PARSER, "parser_version": VERSION, "block_index": index}
    text = block.get("content")
    return base | {"block_index": index, "block_type": block["block_type"], "content_type": block["content_type"], "content": text, "blank": text is not None and not text.strip(), "heading_level": block.get("heading_level"), "cells": block.get("cells"), "extra_metadata": meta}


def _tables(blocks: DataFrame) -> DataFrame:
    """Fills in the text and the shape of tables from their cells, in the JVM."""
    table = F.col("cells").isNotNull()
    counts = tsv.column_counts(F.col("cells"))
    meta = F.col("extra_metadata")
    shaped = meta.withField("row_count", F.size("cells")).withField("column_count", F.coalesce(F.array_max(counts), F.lit(0))).withField("row_column_counts", counts).withField("serialization_format", F.lit(tsv.FORMAT))
    return blocks.withColumns({"content": F.when(table, tsv.serialize(F.col("cells"))).otherwise(F.col("content")), "blank": F.when(table, tsv.all_blank(F.col("cells"))).otherwise(F.col("blank")), "extra_metadata": F.when(table, shaped).otherwise(meta)})


def extract_html(sources: DataFrame, limits: dict[str, int] | None = None, title_references: Mapping[str, str] | None = None) -> Extracted:
    """Units of HTML sources (schemas.SOURCES); title_references as in html_tree.Page."""
    return assembled(parsed(sources, limits, title_references), HTML_LIMITS | (limits or {}))


def pages_as_sources(pages: DataFrame) -> DataFrame:
    """The pages table (page_id, url, html) in the form of sources."""
    none = F.lit(None).cast("string")
    return pages.select(F.format_string("src-%s", F.col("page_id").cast("string")).alias("source_id"), F.format_string("page-%s", F.col("page_id").cast("string")).alias("document_id"), F.lit("url").alias("source_type"), F.col("url").alias("source_uri"), none.alias("original_filename"), F.lit("text/html; charset=utf-8").alias("media_type"), F.lit("utf-8").alias("charset"), F.encode("html", "utf-8").alias("content_bytes"))
