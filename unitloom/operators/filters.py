"""Source filters: what of a page's or file's furniture goes, and what only gets a warning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.pytext import PYWS

# Interface phrases, the reading-time pattern, and the edge bands of a page.
UI_NOISE = ["Link Copied!", "Copy Link", "Share", "Share this article"]
READING_TIME = rf"(?iu)\A\p{{Nd}}+[{PYWS}]+(?:min|minute|minutes)[{PYWS}]+read\z"
HEADER_SHARE = FOOTER_SHARE = 0.10


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def page_number_decision(text: Column) -> Column:
    """drop, a warning's geometry status, or null: what a lone page number on a PDF page gets."""
    meta = F.col("extra_metadata")
    page = F.col("page_start")
    lone = (page == F.col("page_end")) & (page == meta["page_number"]) & (text == page.cast("string"))
    width, height, box = meta["page_width"], meta["page_height"], meta["bbox"]
    sized = _finite(width) & (width > 0) & _finite(height) & (height > 0)
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    whole = (F.size(box) == 4) & _finite(x0) & _finite(y0) & _finite(x1) & _finite(y1) & (x0 < x1) & (y0 < y1)
    valid = sized & whole & (x0 >= 0) & (y0 >= 0) & (x1 <= width) & (y1 <= height)
    header = y1 <= height * HEADER_SHARE
    footer = y0 >= height * (1 - FOOTER_SHARE)
    given = width.isNotNull() & height.isNotNull()
    ladder = (
        F.when(~F.coalesce(lone, F.lit(False)), F.lit(None))
        .when(F.coalesce(valid, F.lit(False)), F.when(header, "valid_header_band").when(footer, "drop"))
        .when(box.isNotNull() & ~given, "missing_page_dimensions")
        .when(box.isNotNull() & given & ~F.coalesce(sized, F.lit(False)), "invalid_page_dimensions")
    )
    return ladder.cast("string")


def drop_reason(text: Column) -> Column:
    """Why a unit with this normalized text goes, or null."""
    html = (F.col("source_type") == "url") & (F.col("extra_metadata.block_type") == "container_text")
    pdf = F.col("source_type") == "pdf"
    return (
        F.when(html & text.rlike(READING_TIME), "html_reading_time")
        .when(html & text.isin(UI_NOISE), "html_ui_noise")
        .when(pdf & (page_number_decision(text) == "drop"), "pdf_page_number")
    )


def page_number_warning(text: Column) -> Column:
    """Geometry status of a page number that stays under suspicion, or null."""
    status = page_number_decision(text)
    return F.when((F.col("source_type") == "pdf") & (status != "drop"), status)


def safe_metadata(meta: Column) -> Column:
    """The fields of a dropped unit's metadata that may be kept."""
    # Names of the fields.
    names = ["block_type", "block_index", "page_number", "page_block_index", "document_block_index", "bbox", "page_index", "page_width", "page_height", "html_tag", "nearest_semantic_container", "serialization_format"]
    return F.struct(*[meta[n].alias(n) for n in names])
