"""Word files to blocks, on the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.assemble import Extracted, OpenHeadings, assembled
from ..schemas import BLOCKS
from .html import SCHEMA, _tables

PARSER, VERSION = "zipfile+xml", "1"
#: A compressed or unpacked main part of more bytes is refused; a bound of this engine's own, as a
#: part is parsed in memory.
MAX_BYTES = 64 << 20
# Fixed value: the main namespace of word-processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADING = re.compile(r"Heading ([1-9][0-9]*)\Z")


def _run(run: ElementTree.Element) -> str:
    """A run's own text; tabs and line breaks are characters, page and column breaks are none."""
    out = []
    for at in run:
        if at.tag == f"{W}t":
            out.append(at.text or "")
        elif at.tag in (f"{W}tab", f"{W}ptab"):
            out.append("\t")
        elif at.tag == f"{W}cr" or (at.tag == f"{W}br" and at.get(f"{W}type", "textWrapping") == "textWrapping"):
            out.append("\n")
        elif at.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def _text(paragraph: ElementTree.Element) -> str:
    """Text of a paragraph's runs and of those in its hyperlinks; nothing that is nested otherwise."""
    out = []
    for at in paragraph:
        if at.tag == f"{W}r":
            out.append(_run(at))
        elif at.tag == f"{W}hyperlink":
            out += map(_run, at.findall(f"{W}r"))
    return "".join(out)


def _styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of the paragraph styles by id, and the default one's."""
    if "word/styles.xml" not in archive.namelist():
        return {}, "Normal"
    names, default = {}, "Normal"
    for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{W}style"):
        name = style.find(f"{W}name")
        if name is not None and style.get(f"{W}type", "paragraph") == "paragraph":
            # Built-in headings are stored in lower case.
            own = names[style.get(f"{W}styleId", "")] = re.sub(r"\Aheading (?=[1-9]\Z)", "Heading ", name.get(f"{W}val", ""))
            if style.get(f"{W}default") in ("1", "true", "on"):
                default = own
    return names, default


def _number(cell: ElementTree.Element, path: str, without: int) -> int:
    found = cell.find(path)
    return int(found.get(f"{W}val", without)) if found is not None else without


def _cells(table: ElementTree.Element) -> list[list[str]]:
    """Texts of all grid columns: a merged cell stands in each column and row that it covers."""
    rows, above = [], {}
    for row in table.findall(f"{W}tr"):
        cells, own = [], {}
        at = _number(row, f"{W}trPr/{W}gridBefore", 0)
        for cell in row.findall(f"{W}tc"):
            span = _number(cell, f"{W}tcPr/{W}gridSpan", 1)
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            if goes_on and at in above:
                text, width = above[at]
            else:
                text, width = "\n".join(_text(p) for p in cell.findall(f"{W}p")), span
            cells += [text] * width
            own[at] = text, width
            at += span
        rows.append(cells)
        above = own
    return rows


def blocks(raw: bytes) -> Iterator[dict]:
    """Blocks of a file's body, in order; section properties are no block."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        part = archive.getinfo("word/document.xml")
        if part.file_size > MAX_BYTES:
            raise ValueError("the main part is too large")
        styles, default = _styles(archive)
        body = ElementTree.fromstring(archive.read(part)).find(f"{W}body")
    if body is None:
        raise ValueError("the document has no body")
    paragraphs = tables = 0
    headings = OpenHeadings()
    for index, node in enumerate(n for n in body if n.tag != f"{W}sectPr"):
        meta = {"parser": PARSER, "parser_version": VERSION, "block_index": index}
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            name = styles.get(style.get(f"{W}val", ""), default) if style is not None else default
            found = HEADING.match(name)
            level = int(found[1]) if found else None
            kind = "heading" if level else "paragraph"
            text = _text(node)
            yield {"block_index": index, "block_type": kind, "content_type": "paragraph", "content": text, "blank": not text.strip(), "heading_level": level, "path": headings.path(level, text), "extra_metadata": meta | {"block_type": kind, "paragraph_index": paragraphs, "style_name": name, "heading_level": level}}
            paragraphs += 1
        elif node.tag == f"{W}tbl":
            yield {"block_index": index, "block_type": "table", "content_type": "table", "cells": _cells(node), "path": headings.path(None, None), "extra_metadata": meta | {"block_type": "table", "table_index": tables}}
            tables += 1
        else:
            yield {"block_index": index, "block_type": "unsupported", "content_type": "unknown", "content": "", "blank": True, "warning_code": "unsupported_docx_element", "warning_detail": node.tag.rpartition("}")[2], "item_index": index, "extra_metadata": meta | {"block_type": "unsupported"}}


def parsed(sources: DataFrame) -> DataFrame:
    failure = F.when(F.col("source_type") != "docx", "extraction_source_type_mismatch").when(F.col("content_bytes").isNull() | (F.length("content_bytes") == 0), "extraction_service_input_error").when(F.length("content_bytes") > MAX_BYTES, "extraction_parsing_failed:max_input_bytes")
    guarded = sources.withColumn("failure", failure)
    rows = guarded.select("document_id", "source_id", "source_type", "source_uri", F.when(F.col("failure").isNull(), F.col("content_bytes")).alias("content_bytes"), "failure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base = {k: row[k] for k in ("document_id", "source_id", "source_type", "source_uri")}
                try:
                    found = [base | {"failure": row["failure"]}] if row["failure"] else [base, *(base | b for b in blocks(row["content_bytes"]))]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError) as error:
                    found = [base | {"failure": f"extraction_parsing_failed:{type(error).__name__}"}]
                yield pa.RecordBatch.from_pylist(found, SCHEMA)

    return _tables(rows.mapInArrow(run, BLOCKS))


def extract_docx(sources: DataFrame, limits: dict[str, int] | None = None) -> Extracted:
    """Units of Word sources (schemas.SOURCES); only given limits hold."""
    return assembled(parsed(sources), limits)
