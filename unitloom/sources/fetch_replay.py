"""Fetching as data: redirects and response checks over a table of recorded exchanges.

``exchanges``: url (a normalized request URL), status, headers array<struct<name,value>>, body.
``dns``: hostname, addresses.  Each round joins all open requests with their exchanges at once,
so a million fetches with five redirects are six joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pytext import strip
from ..functions.urls import all_public, file_name, normalize_url
from ..schemas import FETCH_LIMITS
from .html import MEDIA_TYPES

# Statuses that redirect, and error codes that are worth another try.
REDIRECTS = [301, 302, 303, 307, 308]
RETRYABLE = ["dns_resolution_failed", "network_error", "request_timeout", "request_deadline_exceeded"]


def header_values(headers: Column, name: str) -> Column:
    """All values of a header that are not blank, in order; a single one with commas is several."""
    own = F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"])
    every = F.when(F.size(own) == 1, F.split(F.get(own, F.lit(0)), ",")).otherwise(own)
    return F.filter(F.transform(every, lambda x: strip(x)), lambda x: F.length(x) > 0)


def status_error(status: Column) -> Column:
    return F.when(status.isin(204, 205), "empty_response").when((status == 206) | (status < 200) | (status >= 300), "http_status_error")


def content_length(headers: Column) -> Column:
    """struct(value, bad): the declared length, and whether it is no length."""
    values = F.array_distinct(header_values(headers, "content-length"))
    one = F.get(values, F.lit(0))
    digits = F.replace(one, F.lit("_"), F.lit(""))
    number = F.when(one.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), digits.try_cast("decimal(38,0)"))
    bad = (F.size(values) > 1) | ((F.size(values) == 1) & (number.isNull() | (number < 0)))
    return F.struct(F.when(~bad, number).try_cast("long").alias("value"), bad.alias("bad"))


def content_type(headers: Column) -> Column:
    """struct(media_type, charset, error)."""
    values = F.array_distinct(header_values(headers, "content-type"))
    one = F.get(values, F.lit(0))
    media = F.lower(strip(F.split_part(one, F.lit(";"), F.lit(1))))
    # A parameter keeps its case and loses double quotes or angle brackets around it.
    given = strip(F.regexp_extract(one, r"""(?i);\s*charset\s*=\s*("[^"]*"|[^;]*)""", 1))
    charset = strip(F.when(given.rlike(r"""\A(".*"|<.*>)\z"""), F.substr(given, F.lit(2), F.length(given) - 2)).otherwise(given))
    error = F.when(F.size(values) > 1, "malformed_content_type").when((F.size(values) == 0) | ~media.isin(MEDIA_TYPES), "unsupported_content_type")
    return F.struct(media.alias("media_type"), F.when(F.length(charset) > 0, charset).alias("charset"), error.alias("error"))


def _key(c: Column) -> Column:
    """A join key; rows without one get one each that nothing has, so they don't land in one task."""
    return F.coalesce(c, F.concat(F.lit("\0"), F.col("request_id").cast("string")))


def _followed(state: DataFrame, exchanges: DataFrame, dns: DataFrame, last: bool) -> DataFrame:
    """All open requests one exchange further; ended ones pass through as they are.

    The state is one table, so the plan has one join with each side for a hop and nothing twice.
    """
    df = state.withColumn("n", normalize_url(F.col("next_url"), F.col("base_url")))
    df = df.join(dns.select(F.col("hostname").alias("h"), "addresses"), _key(F.when(F.col("open"), F.col("n.hostname"))) == F.col("h"), "left").drop("h")
    found = F.when(F.col("n.is_ip_literal"), F.array("n.hostname")).otherwise(F.coalesce("addresses", F.array().cast("array<string>")))
    df = df.withColumn("public", all_public(found))
    code = (
        F.when(~F.col("open"), F.col("error_code"))
        .when(F.col("n.error_code").isNotNull(), F.col("n.error_code"))
        .when(F.col("base_url").startswith("https:") & (F.col("n.scheme") == "http"), "https_downgrade_redirect")
        .when(F.size(found) == 0, "dns_resolution_failed")
        .when(~F.col("public"), "blocked_destination")
        .when(F.array_contains("visited", F.col("n.request_url")), "redirect_loop")
    )
    df = df.withColumn("error_code", code).withColumn("probe", F.when(F.col("open") & F.col("error_code").isNull(), F.col("n.request_url"))).drop("n", "addresses", "public")
    seen = exchanges.select(F.col("url").alias("x"), F.col("status").alias("s"), F.col("headers").alias("hs"))
    df = df.join(seen, _key(F.col("probe")) == F.col("x"), "left")
    asked = F.col("probe").isNotNull()
    moved = asked & F.coalesce(F.col("s").isin(REDIRECTS), F.lit(False))
    target = F.trim(F.get(F.transform(F.filter("hs", lambda h: F.lower(h["name"]) == "location"), lambda h: h["value"]), F.lit(0)))
    broken = F.lit("redirect_limit_exceeded") if last else F.when(F.coalesce(F.length("target"), F.lit(0)) == 0, "invalid_redirect")
    df = df.withColumns({"moved": moved, "target": F.when(moved, target)}).withColumn("error_code", F.when(F.col("moved"), broken).otherwise(F.col("error_code")))
    goes_on = F.col("moved") & F.col("error_code").isNull()
    return df.select(
        "request_id",
        "original_url",
        F.coalesce("probe", "url").alias("url"),
        F.when(goes_on, F.col("target")).alias("next_url"),
        F.when(goes_on, F.col("probe")).alias("base_url"),
        F.when(goes_on, F.array_append("visited", F.col("probe"))).otherwise(F.col("visited")).alias("visited"),
        (F.col("redirect_count") + goes_on.cast("int")).alias("redirect_count"),
        "error_code",
        goes_on.alias("open"),
        F.when(asked, F.col("s")).otherwise(F.col("status")).alias("status"),
        F.when(asked, F.col("hs")).otherwise(F.col("headers")).alias("headers"),
        F.when(asked & ~F.col("moved"), F.col("probe")).otherwise(F.col("answer")).alias("answer"),
    )


def replay(requests: DataFrame, exchanges: DataFrame, dns: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row for each request (request_id, url): what fetching it gives, or an error code."""
    limits = FETCH_LIMITS | (limits or {})
    kinds = {f.name: f.dataType for f in exchanges.schema}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    state = requests.select(
        "request_id", F.col("url").alias("original_url"), F.lit(None).cast("string").alias("url"), F.col("url").alias("next_url"), F.lit(None).cast("string").alias("base_url"),
        F.array().cast("array<string>").alias("visited"), F.lit(0).alias("redirect_count"), F.lit(None).cast("string").alias("error_code"), F.lit(True).alias("open"), none("status"), none("headers"), F.lit(None).cast("string").alias("answer"),
    )
    for hop in range(limits["max_redirects"] + 1):
        state = _followed(state, exchanges, dns, hop == limits["max_redirects"])
    # Bodies are read once, by the exchange that ended each request, and not carried along.
    bodies = exchanges.select(F.col("url").alias("x"), "body")
    return _result(state.join(bodies, _key(F.col("answer")) == F.col("x"), "left"), limits)


def _result(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    most = limits["max_body_bytes"]
    rows = rows.withColumns({"size": content_length(F.col("headers")), "kind": content_type(F.col("headers"))})
    # In the order in which a response is looked at.
    code = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("status").isNull(), "network_error")
        .when(status_error(F.col("status")).isNotNull(), status_error(F.col("status")))
        .when(F.col("size.bad"), "invalid_content_length")
        .when(F.col("size.value") > most, "response_too_large")
        .when(F.col("kind.error").isNotNull(), F.col("kind.error"))
        .when(F.length("body") > most, "response_too_large")
        .when(F.coalesce(F.length("body"), F.lit(0)) == 0, "empty_response")
    )
    rows = rows.withColumn("error_code", code)
    fine = F.col("error_code").isNull()
    return rows.select(
        "request_id",
        "original_url",
        F.when(fine, F.col("url")).alias("final_url"),
        F.when(fine, F.col("status")).cast("int").alias("status_code"),
        F.when(fine, F.col("kind.media_type")).alias("media_type"),
        F.when(fine, F.col("kind.charset")).alias("charset"),
        F.when(fine, F.col("size.value")).alias("content_length_header"),
        F.when(fine, F.length("body")).cast("long").alias("downloaded_bytes"),
        F.when(fine, F.col("body")).alias("content_bytes"),
        F.col("redirect_count").cast("int").alias("redirect_count"),
        "error_code",
        F.when(~fine, "downloading").alias("failed_stage"),
        F.coalesce(F.col("error_code").isin(RETRYABLE), F.lit(False)).alias("retryable"),
    )


def fetched_as_sources(fetched: DataFrame) -> DataFrame:
    """Successful fetches in the form of sources, with what is known of the fetch as ``fetch``."""
    own = ["original_url", "final_url", "status_code", "media_type", "charset", "content_length_header", "downloaded_bytes", "redirect_count"]
    return fetched.where("error_code is null").select(
        F.col("request_id").cast("string").alias("source_id"), F.col("request_id").cast("string").alias("document_id"), F.lit("url").alias("source_type"),
        F.col("final_url").alias("source_uri"), file_name(F.col("final_url")).alias("original_filename"), "media_type", "charset", "content_bytes", F.struct(*own).alias("fetch"),
    )
