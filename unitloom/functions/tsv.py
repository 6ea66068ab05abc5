"""Table cells as escaped tab-separated text, in both directions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FORMAT = "tsv_escaped_v1"
#: Stands for an escaped backslash while other escapes are undone; a noncharacter.
MARK = "\ufffe"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    """Undoes escapes from left to right; unknown ones and a last backslash stay as they are.

    A cell that holds the mark itself is taken apart by its marks first, so that none is lost.
    """

    def plain(x: Column) -> Column:
        x = F.replace(x, F.lit("\\\\"), F.lit(MARK))
        x = F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
        return F.replace(x, F.lit(MARK), F.lit("\\"))

    # No escape contains the mark, so the parts between marks can be undone one by one.
    return F.when(~F.contains(c, F.lit(MARK)), plain(c)).otherwise(F.array_join(F.transform(F.split(c, MARK), plain), MARK))


def parse(c: Column) -> Column:
    """Text to an array of rows of cells."""
    return F.transform(F.split(c, "\n"), lambda row: F.transform(F.split(row, "\t"), unescape))


def serialize(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda row: F.array_join(F.transform(row, escape), "\t")), "\n")


def all_blank(rows: Column) -> Column:
    """Whether every cell is blank; a table without cells is."""
    from .pytext import is_blank

    return F.forall(F.flatten(rows), is_blank)


def column_counts(rows: Column) -> Column:
    return F.transform(rows, lambda row: F.size(row))
