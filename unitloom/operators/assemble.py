"""From observed blocks to raw units: dense indexes, heading paths, limits, and failed documents.

Parsers only say what they saw; everything that depends on order is worked out here as windows
over one dealing and one sort by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import pytext as P


@dataclass
class Extracted:
    """Tables of one extraction run."""

    units: DataFrame
    warnings: DataFrame
    stats: DataFrame
    errors: DataFrame


def heading_path(level: Column, text: Column, order: Column, levels: int, window) -> Column:
    """Texts of the headings that are open at a row, outermost first.

    A heading closes all deeper ones.  Level k is open if its last heading comes after the last
    heading of any level above it, so the stack needs no loop: two running aggregates a level.
    """
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    open_ = []
    for k in range(1, levels + 1):
        own = F.last(F.when(level == k, F.struct(order.alias("i"), text.alias("t"))), ignorenulls=True).over(running)
        above = F.max(F.when(level < k, order)).over(running)
        open_.append(F.when(own.isNotNull() & (above.isNull() | (own["i"] > above)), own["t"]))
    return F.array_compact(F.array(*open_))


class OpenHeadings:
    """The same for a parser that sees a document's blocks one after the other, at any level."""

    def __init__(self) -> None:
        self.open: dict[int, str] = {}

    def path(self, level: int | None, text: str | None) -> list[str]:
        """Texts of the headings open at a block; level and text of a heading that isn't blank."""
        if level is not None and text is not None and text.strip():
            self.open = {k: t for k, t in self.open.items() if k < level} | {level: text}
        return list(self.open.values())


def judged(blocks: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Blocks with what their document's windows say: indexes, totals and failure code.

    A limit that isn't given is none.
    """
    whole = Window.partitionBy("document_id")
    ordered = whole.orderBy(F.col("block_index").asc_nulls_first())
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    real = F.col("block_type").isNotNull()
    stays = real & ~F.coalesce(F.col("blank"), F.lit(True))
    df = blocks.withColumn("stays", stays).withColumns(
        {
            "unit_index": F.when(stays, F.count_if(stays).over(running) - 1).cast("int"),
            "observed_blocks": F.count_if(real).over(whole),
            "total_units": F.count_if(stays).over(whole),
            "characters": F.coalesce(F.sum(F.when(stays, F.length("content"))).over(whole), F.lit(0)),
            "told": F.max("failure").over(whole),
        }
    )
    over = lambda n, limit: F.col(n) > limits[limit] if limit in limits else F.lit(False)
    code = (
        F.when(F.col("told").isNotNull(), F.col("told"))
        .when(over("observed_blocks", "max_candidate_blocks"), "extraction_parsing_failed:max_candidate_blocks")
        .when(over("total_units", "max_units"), "extraction_parsing_failed:max_units")
        .when(over("characters", "max_total_extracted_characters"), "extraction_parsing_failed:max_total_extracted_characters")
        .when(F.col("total_units") == 0, "extraction_no_content")
    )
    return df.withColumn("code", code)


def raw_units(every: DataFrame) -> DataFrame:
    """Raw units of judged blocks; blank ones have kept their block index and go."""
    text = F.col("content")
    return every.where("code is null and stays").select(
        P.unit_id("raw", F.col("document_id"), F.col("unit_index")).alias("raw_unit_id"),
        "document_id",
        "source_id",
        "source_type",
        "source_uri",
        "unit_index",
        "content",
        "page_start",
        "page_end",
        F.try_element_at("path", F.lit(-1)).alias("section"),
        # Items of a path are stripped, the section is not.
        F.transform(F.coalesce("path", F.array().cast("array<string>")), lambda x: P.strip(x, P.IDWS)).alias("heading_path"),
        "content_type",
        "extra_metadata",
        P.character_count(text).alias("character_count"),
        P.word_count(text).alias("word_count"),
        P.content_hash(text).alias("content_hash"),
        F.current_timestamp().alias("extracted_at"),
    )


def assembled(blocks: DataFrame, limits: dict[str, int] | None = None) -> Extracted:
    """Units, warnings, statistics and errors of parsed blocks, over one dealing by document.

    A document that failed to parse, is over a limit or has no content gives one row of errors
    and nothing else.
    """
    every = judged(blocks, limits or {})
    parts = F.split("code", ":")
    failed = every.where("code is not null").groupBy("document_id").agg(F.first("source_id").alias("source_id"), F.first("code").alias("code"))
    errors = failed.select("document_id", "source_id", F.get(parts, F.lit(0)).alias("error_code"), message(F.get(parts, F.lit(0))).alias("message"), F.get(parts, F.lit(1)).alias("details"), failed_stage(F.get(parts, F.lit(0))).alias("failed_stage"), F.lit(False).alias("retryable"))
    good = every.where("code is null")
    stage = F.when(F.col("warning_code") == "invalid_declared_charset", "parsing").otherwise("extracting")
    warnings = good.where("warning_code is not null").select("document_id", stage.alias("stage"), "warning_code", message(F.col("warning_code")).alias("message"), "item_index", F.col("warning_detail").alias("details"))
    real = F.col("block_type").isNotNull()
    stats = good.groupBy("document_id").agg(
        F.max("total_units").alias("total_units"),
        F.max("observed_blocks").alias("observed_blocks"),
        F.count_if(real & ~F.col("stays")).alias("skipped_items"),
        F.count_if(F.col("warning_code").isNotNull()).alias("warning_count"),
        F.max("characters").alias("characters"),
        *[F.count_if(F.col("stays") & (F.col("block_type") == b)).alias(f"emitted_{b}") for b in BLOCK_TYPES],
        *[F.count_if(F.col("block_type") == b).alias(f"observed_{b}") for b in OBSERVED],
        F.first("facts", ignorenulls=True).alias("facts"),
    )
    return Extracted(raw_units(every), warnings, stats, errors)


# Block types in the order in which statistics list them.
BLOCK_TYPES = ["document_title", "heading", "paragraph", "code_block", "list_item", "table_caption", "table", "blockquote", "blockquote_text", "container_text", "text"]

#: Of these, blank ones are worth a count too.
OBSERVED = ["heading", "paragraph", "table", "unsupported"]


#: What codes of errors and warnings say.
MESSAGES = {
    "extraction_source_type_mismatch": "The source is of another type than its extractor reads.",
    "extraction_parsing_failed": "The source could not be parsed within its limits.",
    "extraction_no_content": "The source has no text to extract.",
    "extraction_service_input_error": "The source is not a valid input.",
    "extractor_not_registered": "No extractor is registered for the source's type.",
    "invalid_declared_charset": "The declared character set is not known.",
    "unsupported_docx_element": "An element of the document's body was skipped.",
    "malformed_pdf_block": "A malformed block of a page was skipped.",
}


def message(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[code]


def failed_stage(code: Column) -> Column:
    """Where a failure code belongs."""
    return F.when(code == "extraction_parsing_failed", "parsing").when(code.startswith("cleaning"), "cleaning").when(code.startswith("extract"), "extracting").otherwise("downloading")
