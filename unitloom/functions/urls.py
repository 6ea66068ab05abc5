"""URL normalization, diagnostics and the address policy, as Arrow functions that never raise."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

NORMALIZED = T.StructType([T.StructField(n, T.StringType()) for n in ("request_url", "diagnostic_url", "scheme", "hostname")] + [T.StructField("port", T.IntegerType()), T.StructField("is_ip_literal", T.BooleanType()), T.StructField("error_code", T.StringType())])
_ARROW = pa.struct([("request_url", pa.string()), ("diagnostic_url", pa.string()), ("scheme", pa.string()), ("hostname", pa.string()), ("port", pa.int32()), ("is_ip_literal", pa.bool_()), ("error_code", pa.string())])

# Schemes with their only ports, and addresses that are refused beyond the
# library's own classes.
PORTS = {"http": 80, "https": 443}
SHARED = ipaddress.ip_network("100.64.0.0/10")
METADATA_SERVICE = ipaddress.ip_address("169.254.169.254")
_BAD = re.compile(r"[\s\x00-\x1f\x7f]")


INVALID = "<invalid-url>"


def _host(host: str) -> str:
    """The host in lower case, without a last dot, in its ASCII form; '' if it has none."""
    host = host.lower().removesuffix(".")
    try:
        return str(ipaddress.ip_address(host)) if is_literal(host) else host.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return ""


def diagnostic(url: str) -> str:
    """The URL with its host normalized and its port, without query, fragment and user."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return INVALID
    host = _host(host) or host.lower().rstrip(".")
    try:
        port = parts.port
    except ValueError:
        port = None
    netloc = (f"[{host}]" if ":" in host else host) + ("" if port is None else f":{port}")
    return urlunsplit((parts.scheme.lower(), netloc, parts.path, "", ""))


def normalize_one(url: str | None, base: str | None = None) -> dict:
    """The normalized URL, or an error code."""
    if url is None or not url.strip():
        return {"error_code": "invalid_url"}
    if _BAD.search(url):
        return {"error_code": "invalid_url", "diagnostic_url": INVALID}
    try:
        parts = urlsplit(urljoin(base, url) if base else url)
        host = parts.hostname
    except ValueError:
        return {"error_code": "invalid_url", "diagnostic_url": INVALID}
    shown = {"diagnostic_url": diagnostic(urlunsplit(parts))}
    scheme = parts.scheme.lower()
    if not scheme:
        return shown | {"error_code": "invalid_url"}
    if scheme not in PORTS:
        return shown | {"error_code": "unsupported_scheme"}
    if not host:
        return shown | {"error_code": "invalid_url"}
    if parts.username is not None or parts.password is not None:
        return shown | {"error_code": "userinfo_not_allowed"}
    host = _host(host)
    literal = is_literal(host)
    if not host:
        return shown | {"error_code": "invalid_url"}
    if host == "localhost" or host.endswith(".localhost"):
        return shown | {"error_code": "blocked_destination"}
    try:
        allowed = parts.port in (None, PORTS[scheme])
    except ValueError:
        allowed = False
    if not allowed:
        return shown | {"error_code": "disallowed_port"}
    netloc = f"[{host}]" if ":" in host else host
    request = urlunsplit((scheme, netloc, parts.path, parts.query, ""))
    return {"request_url": request, "diagnostic_url": diagnostic(request), "scheme": scheme, "hostname": host, "port": PORTS[scheme], "is_ip_literal": literal}


def is_literal(host: str) -> bool:
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return False
    return True


def is_public(address: str | None) -> bool:
    """Whether an address may be fetched from."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return False
    if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped is not None:
        ip = ip.ipv4_mapped
    # Some multicast and reserved addresses count as global; the other classes never do.
    return ip.is_global and not (ip.is_multicast or ip.is_reserved or ip == METADATA_SERVICE or (ip.version == 4 and ip in SHARED))


@arrow_udf(NORMALIZED)
def _normalize(urls: pa.Array, bases: pa.Array) -> pa.Array:
    return pa.array([normalize_one(u, b) for u, b in zip(urls.to_pylist(), bases.to_pylist(), strict=True)], _ARROW)


@arrow_udf(T.StringType())
def _diagnostic(urls: pa.Array) -> pa.Array:
    return pa.array([None if u is None else diagnostic(u) for u in urls.to_pylist()], pa.string())


@arrow_udf(T.BooleanType())
def _public(addresses: pa.Array) -> pa.Array:
    """True for each list of addresses that is not empty and public throughout."""
    return pa.array([bool(a) and all(is_public(x) for x in a) for a in addresses.to_pylist()], pa.bool_())


def normalize_url(url: Column, base: Column | None = None) -> Column:
    return _normalize(url, F.lit(None).cast("string") if base is None else base)


def diagnostic_url(url: Column) -> Column:
    return _diagnostic(url)


def all_public(addresses: Column) -> Column:
    return _public(addresses)


def file_name(url: Column) -> Column:
    """Last part of a URL's path, decoded; null if the path ends in a slash."""
    name = F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1)
    return F.when(F.length(name) > 0, F.try_url_decode(name))
