"""Text functions with Python's idea of white space, as Catalyst expressions.

Spark's and DuckDB's own ``\\s`` and ``trim`` know fewer characters than Python does, so the class
is spelled out once and used everywhere.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

# Python's white space, as the body of a regex character class.
PYWS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same without the line feed.
PYWS_H = r"\x09\x0B-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: What the id validators strip: Python's class without U+001C-001F.
IDWS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

REPLACEMENT = "\ufffd"
NBSP = "\xa0"


def strip(c: Column, body: str = PYWS) -> Column:
    return F.regexp_replace(c, rf"\A[{body}]+|[{body}]+\z", "")


def is_blank(c: Column) -> Column:
    """Empty, or white space alone; null is blank."""
    return ~F.coalesce(c.rlike(f"[^{PYWS}]"), F.lit(False))


def character_count(c: Column) -> Column:
    return F.length(c)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"[^{PYWS}]+"), F.lit(0)))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def unit_id(kind: str, document_id: Column, index: Column) -> Column:
    """kind:document:index, zero-padded to six digits and longer if need be; null if there is none."""
    name = strip(document_id, IDWS)
    ok = (F.length(name) > 0) & (index >= 0)
    return F.when(ok, F.format_string(f"{kind}:%s:%06d", name, index))


def _composed(texts: pa.Array) -> pa.Array:
    """NFC of each string; the array itself if all are composed already, as most are."""
    values = texts.to_pylist()
    if all(x is None or unicodedata.is_normalized("NFC", x) for x in values):
        return texts
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in values], texts.type)


@arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _composed(texts)


@arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def nfc_cells(tables: pa.Array) -> pa.Array:
    """NFC of every cell of an array of rows."""
    rows = tables.flatten()
    inner = pa.ListArray.from_arrays(_offsets(rows), _composed(rows.flatten()))
    return pa.ListArray.from_arrays(_offsets(tables), inner, mask=pc.is_null(tables))


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])


def nfc(c: Column) -> Column:
    return _nfc(c)


def line_endings(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def nbsp(c: Column) -> Column:
    return F.replace(c, F.lit(NBSP), F.lit(" "))


def linewise(c: Column) -> Column:
    """Runs of horizontal white space to one space, lines and text stripped, blank runs to one."""
    c = F.regexp_replace(c, f"[{PYWS_H}]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A[ \n]+|[ \n]+\z", "")


def controls(c: Column, keep_tab: bool) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]" if keep_tab else r"[\x00-\x09\x0B-\x1F\x7F]", "")


def changed(before: Column, after: Column, code: str) -> Column:
    return F.when(before != after, F.lit(code))


def codes(*found: Column) -> Column:
    """Codes that apply, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*found)))
