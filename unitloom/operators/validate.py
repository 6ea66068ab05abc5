"""Invariants of the tables as queries: each gives the rows that break it, so none is expected."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.pytext import is_blank
from ..schemas import CONTENT_TYPES, RETRIEVAL_METHODS, SOURCE_TYPES


def _broken(df: DataFrame, rule: str, where: Column, key: str) -> DataFrame:
    return df.where(F.coalesce(where, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def pages_broken() -> Column:
    """V2: both pages or neither, from 1, in order."""
    a, b = F.col("page_start"), F.col("page_end")
    return (a.isNull() != b.isNull()) | (a < 1) | (b < 1) | (b < a)


def raw_units(units: DataFrame) -> DataFrame:
    """V1-V4 on raw units."""
    place = Window.partitionBy("document_id").orderBy("unit_index")
    same = Window.partitionBy("document_id", "raw_unit_id")
    df = units.withColumns({"__place": F.row_number().over(place) - 1, "__same": F.count("*").over(same)})
    rules = {
        "V1 content is not blank": is_blank(F.col("content")),
        "V2 pages": pages_broken(),
        "V3 raw_unit_id is unique": F.col("__same") > 1,
        "V3 unit_index is the position": F.col("unit_index") != F.col("__place"),
        "V3 ids are there": F.col("raw_unit_id").isNull() | is_blank(F.col("document_id")) | is_blank(F.col("source_id")),
        "enumerations": ~F.col("source_type").isin(SOURCE_TYPES) | ~F.col("content_type").isin(CONTENT_TYPES),
    }
    return _union(_broken(df, rule, where, "raw_unit_id") for rule, where in rules.items())


def lineage(units: DataFrame, headers: DataFrame, key: str = "raw_unit_id") -> DataFrame:
    """V4: units carry the ids and the type of their document's header."""
    own = headers.select("document_id", F.col("source_id").alias("__s"), F.col("source_type").alias("__t"))
    joined = units.join(own, "document_id", "left")
    wrong = F.col("__s").isNull() | (F.col("source_id") != F.col("__s")) | (F.col("source_type") != F.col("__t"))
    return _broken(joined, "V4 lineage", wrong, key)


def cleaned(units: DataFrame, dropped: DataFrame, warnings: DataFrame, stats: DataFrame) -> DataFrame:
    """V6-V13 on the tables of a cleaning run."""
    place = Window.partitionBy("document_id").orderBy("unit_index")
    same = Window.partitionBy("clean_unit_id")
    df = units.withColumns({"__place": F.row_number().over(place) - 1, "__same": F.count("*").over(same)})
    gone = dropped.withColumn("__before", F.lag("unit_index").over(Window.partitionBy("document_id").orderBy("unit_index")))
    times = units.groupBy("document_id").agg(F.countDistinct("cleaned_at").alias("n"))
    count = lambda t, name: t.groupBy("document_id").agg(F.count("*").alias(name))
    told = stats
    for table, name in ((units, "__u"), (dropped, "__d"), (warnings, "__w")):
        told = told.join(count(table, name), "document_id", "left")
    got = lambda name: F.coalesce(F.col(name), F.lit(0))
    return _union(
        [
            _broken(df, "V1 content is not blank", is_blank(F.col("content")), "clean_unit_id"),
            _broken(df, "V6 clean_unit_id is unique", F.col("__same") > 1, "clean_unit_id"),
            _broken(df, "V6 clean_unit_index is continuous", F.col("clean_unit_index") != F.col("__place"), "clean_unit_id"),
            _broken(gone, "V7 dropped units are unique", F.col("__before") == F.col("unit_index"), "raw_unit_id"),
            _broken(units.join(dropped.select("raw_unit_id"), "raw_unit_id", "left_semi"), "V8 no unit is both", F.lit(True), "raw_unit_id"),
            _broken(times, "V10 one timestamp", F.col("n") > 1, "document_id"),
            _broken(told, "V11 counts", (F.col("output_units") != got("__u")) | (F.col("dropped_units") != got("__d")) | (F.col("warning_count") != got("__w")), "document_id"),
            _broken(told, "V12 sums", (F.col("input_units") != F.col("output_units") + F.col("dropped_units")) | (F.col("output_units") != F.col("modified_units") + F.col("unchanged_units")), "document_id"),
            _broken(warnings, "V13 stage", F.col("stage") != "cleaning", "raw_unit_id"),
        ]
    )


def extraction_stats(stats: DataFrame, units: DataFrame) -> DataFrame:
    """V5, V18 and V19 on an extraction run."""
    own = stats.join(units.groupBy("document_id").agg(F.count("*").alias("__n")), "document_id", "left")
    n = F.coalesce("__n", F.lit(0))
    return _union(
        [
            _broken(own, "V5 total_units", F.col("total_units") != n, "document_id"),
            _broken(own, "V18 at least one unit", F.col("total_units") < 1, "document_id"),
            _broken(own, "V19 observed = emitted + skipped", F.col("observed_blocks") != F.col("total_units") + F.col("skipped_items"), "document_id"),
        ]
    )


def pdf_pages(stats: DataFrame) -> DataFrame:
    """V20: pages with text and blank pages are all pages."""
    n = lambda k: F.col("facts")[k].cast("long")
    return _broken(stats, "V20 pages", n("pages_with_text") + n("blank_pages") != n("page_count"), "document_id")


def chunks(table: DataFrame) -> DataFrame:
    """V14: a chunk's place and size."""
    a, b = F.col("start_char"), F.col("end_char")
    return _broken(table, "V14 place", (b.isNotNull() & a.isNull()) | (a < 0) | (b <= a) | (F.col("token_count") < 1), "chunk_id")


def contexts(table: DataFrame) -> DataFrame:
    """V17: methods and ranks of retrieved chunks."""
    methods = F.array(*[F.lit(m) for m in RETRIEVAL_METHODS])
    wrong = (F.size("retrieval_methods") < 1) | (F.size(F.array_except("retrieval_methods", methods)) > 0) | (F.col("retrieval_rank") < 1) | (F.col("final_rank") < 1)
    return _broken(table, "V17 methods and ranks", wrong, "chunk_id")
