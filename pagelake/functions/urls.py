"""URL functions: Catalyst expressions for URLs in normal form, Arrow functions for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import url as urls

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.nullif(F.lower(_part(url, 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def port(url: Column) -> Column:
    """The port written, else the scheme's default."""
    return F.coalesce(F.nullif(_part(url, 3), F.lit("")).cast("int"), F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80))


def path(url: Column) -> Column:
    return F.when(scheme(url).isNotNull(), F.coalesce(F.nullif(_part(url, 4), F.lit("")), F.lit("/")))


def path_prefix(p: Column) -> Column:
    """The path up to its last slash; ``/`` without one."""
    return F.when(p.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(p, r"^(.*/)", 1), F.lit("")), F.lit("/")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce((scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b)), F.lit(False))


def content_type(p: Column) -> Column:
    """The content type that a path announces; null if it names none of the known ones."""
    low = F.lower(p)
    name = F.element_at(F.split(low, "/"), -1)
    return (
        F.when(low.endswith(".pdf"), "application/pdf").when(low.endswith(".json"), "application/json").when(low.endswith(".txt") | low.endswith(".md"), "text/plain")
        .when(low.endswith(".html") | low.endswith(".htm") | low.endswith("/") | ~name.contains("."), "text/html")
    )


def input_kind(text: Column) -> Column:
    """``file``, ``inline``, ``http`` or null, by prefix in that order."""
    return F.when(text.startswith("file://"), "file").when(text.startswith("raw:"), "inline").when(scheme(text).isin("http", "https") & host(text).isNotNull(), "http")


def host_matches(h: Column, domain: Column) -> Column:
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def _domain(d: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(d), r"^\.+|\.+$", ""))


def domain_covers(domain: Column, h: Column) -> Column:
    """Whether a cookie or allowed domain covers a host; empty domains cover nothing."""
    d, own = _domain(domain), _domain(h)
    return F.coalesce((F.length(d) > 0) & (F.length(own) > 0) & host_matches(own, d), F.lit(False))


def imported_domain_covers(cookie_domain: Column, root: Column) -> Column:
    """The stricter test of imports: a domain with a leading dot is covered by the identical root only."""
    d, r = F.lower(F.trim(cookie_domain)), _domain(root)
    return F.when(d.startswith("."), F.substring(d, 2, 1 << 20) == r).otherwise(host_matches(d, r))


def origin_host(origin: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), r"[\[\]]", "")), F.lit(""))


def login_domains(url: Column) -> Column:
    """The domains of a login at ``url``: https only, with and without ``www.``."""
    h = host(url)
    return F.when((scheme(url) == "https") & h.startswith("www."), F.array(F.substring(h, 5, 1 << 20), h)).when((scheme(url) == "https") & h.isNotNull(), F.array(h))


def _vector(function, kind: pa.DataType, spark_type: T.DataType):
    @F.arrow_udf(spark_type)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if any(v is None for v in row) else function(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return run


url_join = _vector(urls.join, pa.string(), T.StringType())
followable = _vector(urls.followable, pa.string(), T.StringType())
normal_url = _vector(lambda u: (lambda p: None if p is None else str(p))(urls.parse(u)), pa.string(), T.StringType())
glob_match = _vector(urls.glob_match, pa.bool_(), T.BooleanType())
redact_url = _vector(urls.redact_url, pa.string(), T.StringType())


def fnv1a64(text: str) -> str:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a64_many(texts: list[str]) -> np.ndarray:
    """``fnv1a64`` of many texts, one step for each byte place of the longest."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    longer = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    for i, n in enumerate(longer.tolist()):  # the n longest have a byte at i
        h[:n] = (h[:n] ^ flat[starts[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.arrow_udf(T.StringType())
def fnv1a64_hex(texts: pa.Array) -> pa.Array:
    values = texts.to_pylist()
    done = iter(fnv1a64_many([v for v in values if v is not None]).tolist())
    return pa.array([None if v is None else f"{next(done):016x}" for v in values], pa.string())


def register(spark: SparkSession) -> None:
    """Makes the Arrow functions callable from SQL."""
    from .html import html_text, page_links, page_metadata

    for name, f in {"url_join": url_join, "followable": followable, "normal_url": normal_url, "glob_match": glob_match, "redact_url": redact_url, "fnv1a64": fnv1a64_hex, "html_text": html_text, "page_metadata": page_metadata, "page_links": page_links}.items():
        spark.udf.register(name, f)
