"""Redaction of secrets in texts, and consent gates."""

from __future__ import annotations

import json
from collections.abc import Iterable
from urllib.parse import quote, quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "<redacted>"


def variants(secrets: Iterable[str]) -> list[str]:
    """Each secret as it may be spelled (plain, percent-, form- and JSON-escaped), longest first."""
    out: set[str] = set()
    for s in secrets:
        if s:
            out |= {s, quote(s, safe=""), quote_plus(s), json.dumps(s)[1:-1], json.dumps(s, ensure_ascii=False)[1:-1]}
    return sorted(out, key=lambda v: (-len(v), v))


def redact(text: str, secrets: Iterable[str]) -> str:
    for v in variants(secrets):
        text = text.replace(v, REDACTED)
    return text


def redact_column(text: Column, secrets: Iterable[str]) -> Column:
    """``redact`` as nested JVM replacements; the secrets of one session, so few."""
    for v in variants(secrets):
        text = F.replace(text, F.lit(v), F.lit(REDACTED))
    return text


def secret_values(cookies: Column, storage: Column) -> Column:
    """All non-empty values of a session's cookies and storage entries."""
    return F.filter(F.array_distinct(F.concat(F.transform(cookies, lambda c: c["value"]), F.transform(storage, lambda s: s["value"]))), lambda v: F.length(v) > 0)


def safe_error(df: DataFrame, message: str = "message", sensitive: str = "sensitive") -> DataFrame:
    """Error messages of sensitive rows say nothing specific."""
    return df.withColumn(message, F.when(F.coalesce(F.col(sensitive), F.lit(False)) & F.col(message).isNotNull(), "extraction failed for a session-backed request").otherwise(F.col(message)))


def predicates(df: DataFrame, must_contain: Iterable[str] = (), must_not_contain: Iterable[str] = (), content: str = "content") -> DataFrame:
    """``predicates`` (one record a value) and ``verified``, true if all hold."""
    tests = [F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("value"), (F.coalesce(F.col(content), F.lit("")).contains(v) == wanted).alias("passed")) for kind, values, wanted in (("must_contain", must_contain, True), ("must_not_contain", must_not_contain, False)) for v in values]
    out = df.withColumn("predicates", F.array(*tests) if tests else F.array().cast("array<struct<kind:string,value:string,passed:boolean>>"))
    return out.withColumn("verified", F.forall("predicates", lambda p: p["passed"]))


def consent_errors(df: DataFrame, plan: str = "plan", sessions: str = "sessions", current_tab: str = "current_tab", port: str = "port", allow_private: bool = False, allow_screenshot: bool = False) -> DataFrame:
    """``consent_error``: what a run would need leave for, null if nothing is missing.

    A run on the open tab needs the browser's port and leave to read private content, a
    port is of no use to any other run, sessions need the same leave, and captures with a
    screenshot need theirs. The first that fails is named.
    """
    tab = F.coalesce(F.col(current_tab), F.lit(False))
    with_session = F.coalesce(F.size(sessions), F.lit(0)) > 0
    captures = F.from_json(F.get_json_object(F.col(plan), "$.actions"), "array<struct<type:string,screenshot:boolean>>")
    shots = F.coalesce(F.exists(captures, lambda a: (F.coalesce(a["type"], F.lit("")) == "capture") & F.coalesce(a["screenshot"], F.lit(False))), F.lit(False))
    error = (
        F.when(tab & F.col(port).isNull(), "the open tab needs the port of its browser")
        .when(tab & F.lit(not allow_private), "the open tab may show private content, which must be allowed")
        .when(~tab & F.col(port).isNotNull(), "a port belongs to the open tab only")
        .when(with_session & F.lit(not allow_private), "sessions may show private content, which must be allowed")
        .when(shots & F.lit(not allow_screenshot), "screenshots must be allowed")
    )
    return df.withColumn("consent_error", error)
