"""Extraction of mixed sources: guards, dispatch by type, one set of tables, bytes never emitted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.assemble import Extracted, message
from ..schemas import SOURCES
from .docx import extract_docx
from .html import extract_html

Extractor = Callable[[DataFrame], Extracted]

#: Keys that callers may not use in their own metadata.
RESERVED = ["fetch", "service"]


class Registry:
    """Extractors by source type; PDF needs a parser, so it is only there if registered."""

    def __init__(self) -> None:
        self.by_type: dict[str, Extractor] = {"url": extract_html, "docx": extract_docx}

    def register(self, source_type: str, extractor: Extractor) -> None:
        self.by_type[source_type] = extractor


def reserved_keys(keys: Column) -> Column:
    """Reserved keys that a caller's metadata uses, sorted and joined; null if none."""
    used = F.array_sort(F.array_intersect(keys, F.array(*[F.lit(k) for k in RESERVED])))
    return F.when(F.size(used) > 0, F.array_join(used, ", "))


def extract(sources: DataFrame, registry: Registry | None = None, metadata_keys: Column | None = None) -> Extracted:
    """Units, warnings, statistics and errors of all sources.

    ``metadata_keys``: keys of the caller's metadata, where there are any.  A source of an unknown
    type, or with reserved keys, gives one error and nothing else.
    """
    registry = registry or Registry()
    keys = F.lit(None).cast("string") if metadata_keys is None else reserved_keys(metadata_keys)
    df = sources.withColumn("__used", keys)
    known = F.col("source_type").isin(list(registry.by_type))
    refused = df.where(F.col("__used").isNotNull() | ~F.coalesce(known, F.lit(False)))
    code = F.when(F.col("__used").isNotNull(), "extraction_service_input_error").otherwise("extractor_not_registered")
    errors = refused.select("document_id", "source_id", code.alias("error_code"), message(code).alias("message"), F.coalesce("__used", "source_type").alias("details"), F.lit("extracting").alias("failed_stage"), F.lit(False).alias("retryable"))
    good = df.where(F.col("__used").isNull()).select(*SOURCES.fieldNames())
    parts = [f(good.where(F.col("source_type") == t)) for t, f in registry.by_type.items()]
    union = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    return Extracted(union("units"), union("warnings"), union("stats"), union("errors").unionByName(errors))
