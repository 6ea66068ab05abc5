"""The document cleaner: normalized units, what was dropped, warnings, statistics, and failures.

All decisions about a unit are made in its row.  What concerns a whole document (limits, clean
indexes, whether anything is left) is a set of windows over one dealing by document_id, which the
statistics share, so cleaning costs a single exchange.  A document that breaks a rule gives one
row of errors and no row of anything else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import pytext as P
from ..schemas import CLEANING_LIMITS
from .filters import drop_reason, page_number_warning, safe_metadata
from .normalize import normalize

# Name and version that clean units carry, and messages.
CLEANER, VERSION = "unitloom_cleaner", "1.0"
MESSAGES = {
    "empty_after_normalization": "Nothing is left of the unit after normalization.",
    "html_reading_time": "Reading time of a web page.",
    "html_ui_noise": "Interface phrase of a web page.",
    "pdf_page_number": "Page number in the footer of a PDF page.",
}


class CleaningInputError(ValueError):
    """A limit that is unknown or not a positive whole number."""


def policy(config: dict[str, object] | None = None) -> dict[str, int]:
    """Default limits with the caller's; unknown names and bad values are refused."""
    config = config or {}
    if unknown := sorted(set(config) - set(CLEANING_LIMITS)):
        raise CleaningInputError(f"unknown limits: {', '.join(unknown)}")
    for name, value in config.items():
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise CleaningInputError(f"{name} must be a whole number above 0")
    return CLEANING_LIMITS | config


@dataclass
class Cleaned:
    """Tables of one cleaning run; all derive from ``candidates``."""

    candidates: DataFrame
    units: DataFrame
    dropped: DataFrame
    warnings: DataFrame
    stats: DataFrame
    errors: DataFrame


def candidates(units: DataFrame, limits: dict[str, int], reserved: Column | None = None) -> DataFrame:
    """units with their normalized text, drop reason, document totals and error code.

    ``reserved``: true where a unit's own metadata uses the cleaner's key, which fails its document.
    """
    df = normalize(units)
    text = F.col("normalized")
    df = df.withColumn("reason", F.when(P.is_blank(text), "empty_after_normalization").otherwise(drop_reason(text)))
    status = F.when(F.col("reason").isNull() | (F.col("reason") != "empty_after_normalization"), page_number_warning(text))
    page = F.struct(
        F.lit("possible_page_number").alias("code"),
        F.lit("source_filter").alias("origin"),
        F.lit(None).cast("int").alias("removed_count"),
        status.alias("details"),
    )
    df = df.withColumn("found", F.concat("normalization_warnings", F.array_compact(F.array(F.when(status.isNotNull(), page)))))
    df = df.withColumn("reserved", F.lit(False) if reserved is None else reserved)
    whole = Window.partitionBy("document_id")
    stays = F.col("reason").isNull()
    totals = {
        "n_in": F.count("*").over(whole),
        "chars_in": F.sum(F.length("content")).over(whole),
        "n_out": F.count_if(stays).over(whole),
        "chars_out": F.coalesce(F.sum(F.when(stays, F.length("normalized"))).over(whole), F.lit(0)),
        "any_reserved": F.max("reserved").over(whole),
        "clean_unit_index": F.when(stays, F.count_if(stays).over(whole.orderBy("unit_index").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"),
        "reasons": F.collect_set("reason").over(whole),
    }
    df = df.withColumns(totals)
    over = lambda n, limit: F.col(n) > limits[limit]
    # In the order in which a document would meet them.
    ladder = (
        F.when(F.col("any_reserved"), "cleaning_input_error")
        .when(over("n_in", "max_input_units"), "cleaning_limit_exceeded:max_input_units")
        .when(over("chars_in", "max_input_characters"), "cleaning_limit_exceeded:max_input_characters")
        .when(F.col("n_out") == 0, F.concat(F.lit("cleaning_no_content:"), F.when(F.size("reasons") == 1, F.get("reasons", F.lit(0))).otherwise("all_units_dropped")))
        .when(over("n_out", "max_output_units"), "cleaning_limit_exceeded:max_output_units")
        .when(over("chars_out", "max_output_characters"), "cleaning_limit_exceeded:max_output_characters")
    )
    return df.withColumn("failure", ladder)


def clean(units: DataFrame, config: dict[str, object] | None = None, cleaned_at: Column | None = None, reserved: Column | None = None) -> Cleaned:
    """Cleans raw units (schemas.RAW_UNITS); cleaned_at is one timestamp for the whole run."""
    every = candidates(units, policy(config), reserved)
    good = every.where("failure is null")
    lineage = ["document_id", "source_id", "source_type", "source_uri", "raw_unit_id"]
    own = F.col("extra_metadata").withField("cleaning", F.struct(F.lit(CLEANER).alias("cleaner"), F.lit(VERSION).alias("cleaner_version"), (F.col("content") != F.col("normalized")).alias("modified")))
    text = F.col("normalized")
    clean_units = good.where("reason is null").select(
        P.unit_id("clean", F.col("document_id"), F.col("unit_index")).alias("clean_unit_id"),
        *lineage,
        "unit_index",
        "clean_unit_index",
        text.alias("content"),
        *[c for c in ("page_start", "page_end", "section", "heading_path", "content_type")],
        own.alias("extra_metadata"),
        "transformations",
        P.character_count(text).alias("character_count"),
        P.word_count(text).alias("word_count"),
        P.content_hash(text).alias("content_hash"),
        (F.current_timestamp() if cleaned_at is None else cleaned_at).alias("cleaned_at"),
    )
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("reason")]
    dropped = good.where("reason is not null").select(
        *lineage, "unit_index", "page_start", "page_end", "content_type", F.col("reason").alias("reason_code"), message.alias("message"), P.content_hash(F.col("content")).alias("content_hash"), safe_metadata(F.col("extra_metadata")).alias("extra_metadata")
    )
    warned = good.select("document_id", "raw_unit_id", "unit_index", "clean_unit_index", F.posexplode("found").alias("position", "w"))
    warnings = warned.select("document_id", "raw_unit_id", "unit_index", "clean_unit_index", "position", F.col("w.code").alias("warning_code"), F.col("w.origin").alias("origin"), F.lit("cleaning").alias("stage"), "w.removed_count", "w.details")
    errors = every.where("failure is not null").groupBy("document_id").agg(F.first("source_id").alias("source_id"), F.first("failure").alias("failure"))
    parts = F.split("failure", ":")
    errors = errors.select("document_id", "source_id", F.get(parts, F.lit(0)).alias("error_code"), F.get(parts, F.lit(1)).alias("details"), F.lit("cleaning").alias("failed_stage"), F.lit(False).alias("retryable"))
    return Cleaned(every, clean_units, dropped, warnings, statistics(good), errors)


def statistics(good: DataFrame) -> DataFrame:
    """One row of counts for each document; candidates are dealt by document already."""
    stays, changed = F.col("reason").isNull(), F.col("content") != F.col("normalized")
    of = lambda code: F.size(F.filter("found", lambda w: w["code"] == code))
    origin = lambda o: F.sum(F.size(F.filter("found", lambda w: w["origin"] == o))).alias(f"{o}_warning_count")
    after = F.coalesce(F.sum(F.when(stays, F.length("normalized"))), F.lit(0))
    return good.groupBy("document_id").agg(
        F.count("*").alias("input_units"),
        F.count_if(stays).alias("output_units"),
        F.count_if(~stays).alias("dropped_units"),
        F.count_if(stays & changed).alias("modified_units"),
        F.count_if(stays & ~changed).alias("unchanged_units"),
        F.sum(F.length("content")).alias("characters_before"),
        after.alias("characters_after"),
        (F.sum(F.length("content")) - after).alias("character_delta"),
        *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in MESSAGES],
        F.sum(F.size("found")).alias("warning_count"),
        origin("normalization"),
        origin("source_filter"),
        F.sum(of("possible_page_number")).alias("possible_page_number_count"),
    )
