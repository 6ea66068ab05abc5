"""PDF text blocks to units, without Python: a parser's blocks come in as a table.

``blocks``: document_id, source_id, source_uri, page_index, page_block_index, x0, y0, x1, y1,
text, block_number, block_type.  ``pages``: document_id, source_id, page_index, and status (null,
``open_failed`` or ``locked``), so pages without blocks and files that didn't open count too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pytext import is_blank
from ..operators.assemble import Extracted, assembled
from ..schemas import BLOCKS, METADATA

PARSER, VERSION = "pdf_blocks", "1"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def decisions(blocks: DataFrame) -> DataFrame:
    """blocks with document_block_index and what becomes of each, tested in order."""
    order = Window.partitionBy("document_id").orderBy("page_index", "page_block_index")
    box = reduce(Column.__and__, [_finite(F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    ladder = (
        F.when(F.col("block_type").isNotNull() & (F.col("block_type") != 0), "skip_not_text")
        .when(F.col("text").isNull(), "skip_malformed")
        .when(is_blank(F.col("text")), "skip_blank")
        .when(~box, "skip_malformed")
        .otherwise("emit")
    )
    return blocks.withColumns({"document_block_index": (F.row_number().over(order) - 1).cast("int"), "decision": ladder})


def parsed(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    known = decisions(blocks)
    none = lambda kind: F.lit(None).cast(kind)
    own = {
        "parser": F.lit(PARSER), "parser_version": F.lit(VERSION), "block_type": F.lit("text"), "block_index": F.col("document_block_index"),
        "page_index": F.col("page_index"), "page_number": F.col("page_index") + 1, "page_block_index": F.col("page_block_index"), "document_block_index": F.col("document_block_index"),
        "bbox": F.array("x0", "y0", "x1", "y1"), "block_number": F.col("block_number"), "raw_block_type": F.col("block_type"),
    }
    meta = F.struct(*[own.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in METADATA])
    bad = F.col("decision") == "skip_malformed"
    values = {
        "document_id": F.col("document_id"), "source_id": F.col("source_id"), "source_type": F.lit("pdf"), "source_uri": F.col("source_uri"),
        "block_index": F.col("document_block_index"), "block_type": F.lit("text"), "content_type": F.lit("paragraph"), "content": F.coalesce("text", F.lit("")),
        "blank": F.col("decision") != "emit", "page_start": F.col("page_index") + 1, "page_end": F.col("page_index") + 1,
        "item_index": F.when(bad, F.col("document_block_index")), "warning_code": F.when(bad, "malformed_pdf_block"), "extra_metadata": meta,
    }
    rows = known.select(*[values.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in BLOCKS])
    text = known.where("decision = 'emit'").select("document_id", "page_index").distinct()
    counted = pages.join(text.withColumn("has_text", F.lit(True)), ["document_id", "page_index"], "left")
    facts = F.create_map(F.lit("page_count"), F.count("page_index").cast("string"), F.lit("pages_with_text"), F.count("has_text").cast("string"), F.lit("blank_pages"), (F.count("page_index") - F.count("has_text")).cast("string"))
    heads = counted.groupBy("document_id").agg(F.first("source_id").alias("source_id"), F.max("status").alias("status"), facts.alias("facts"))
    head = {"document_id": F.col("document_id"), "source_id": F.col("source_id"), "source_type": F.lit("pdf"), "failure": F.when(F.col("status").isNotNull(), F.concat(F.lit("extraction_parsing_failed:"), "status")), "facts": F.col("facts")}
    return rows.unionByName(heads.select(*[head.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in BLOCKS]))


def extract_pdf(blocks: DataFrame, pages: DataFrame, limits: dict[str, int] | None = None) -> Extracted:
    """Units of PDF files from their text blocks; heading paths are always empty, and only given limits hold."""
    return assembled(parsed(blocks, pages), limits)
