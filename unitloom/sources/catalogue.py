"""The source catalogue: one row for each source with its state, its error, and typed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import normalize_url
from ..operators.assemble import Extracted
from ..schemas import SOURCE_STATUSES, SOURCE_TYPES, STAGES


def catalogue(sources: DataFrame, found: Extracted, created_at: Column | None = None) -> DataFrame:
    """State and metadata of sources after an extraction.

    The metadata of the three types share one struct, told apart by metadata_type; what doesn't
    apply is null.
    """
    stats = found.stats.select("document_id", "total_units", "emitted_table", "emitted_paragraph", "emitted_heading", "facts")
    errors = found.errors.select("document_id", F.struct("error_code", "details", "failed_stage", "retryable").alias("error"))
    df = sources.withColumn("checksum_sha256", F.sha2("content_bytes", 256)).drop("content_bytes")
    df = df.join(stats, "document_id", "left").join(errors, "document_id", "left")
    url, word, pdf = (F.col("source_type") == t for t in ("url", "docx", "pdf"))
    df = df.withColumn("n", normalize_url(F.when(url, F.col("source_uri"))))
    metadata = F.struct(
        F.col("source_type").alias("metadata_type"),
        F.col("original_filename"),
        F.col("checksum_sha256"),
        F.col("media_type").alias("mime_type"),
        F.when(pdf, F.col("facts")["page_count"].cast("int")).alias("total_pages"),
        F.when(word, F.col("emitted_paragraph") + F.col("emitted_heading")).cast("int").alias("paragraph_count"),
        F.when(word, F.col("emitted_table")).cast("int").alias("table_count"),
        F.when(url, F.col("source_uri")).alias("original_url"),
        F.when(url, F.col("n.request_url")).alias("canonical_url"),
        F.when(url, F.col("n.hostname")).alias("domain"),
    )
    failed = F.col("error").isNotNull()
    return df.select(
        "source_id",
        "document_id",
        "source_type",
        F.when(failed, "failed").when(F.col("total_units").isNotNull(), "completed").otherwise("pending").alias("status"),
        F.when(failed, F.col("error.failed_stage")).when(F.col("total_units").isNotNull(), "completed").otherwise("queued").alias("current_stage"),
        F.coalesce("original_filename", "source_uri").alias("display_name"),
        "source_uri",
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "error",
        metadata.alias("metadata"),
    )


def broken(table: DataFrame) -> DataFrame:
    """Rows of a catalogue that break its rules: enumerations, ids, errors of failed sources alone."""
    blank = F.length(F.coalesce(F.trim("source_id"), F.lit(""))) == 0
    wrong = blank | ~F.col("source_type").isin(SOURCE_TYPES) | ~F.col("status").isin(SOURCE_STATUSES) | ~F.col("current_stage").isin(STAGES) | ((F.col("status") == "failed") != F.col("error").isNotNull())
    return table.where(F.coalesce(wrong, F.lit(True))).select(F.lit("catalogue").alias("rule"), F.col("source_id").alias("key"))
