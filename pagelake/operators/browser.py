"""Deterministic rules around a browser, over tables of what it reported."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import url as urls
from ..functions import urls as U
from .sessions import _merge

#: Events that a run keeps, at most 64 of them, and those that always stop it.
ALWAYS = ("Browser.downloadWillBegin", "Browser.downloadProgress", "Page.fileChooserOpened", "Page.javascriptDialogOpening", "Page.windowOpen")
TRACKED = (*ALWAYS, "Page.frameScheduledNavigation", "Target.targetCreated", "Target.attachedToTarget")


def tracked_events(events: DataFrame, by: str = "run", order: str = "pos", method: str = "method", most: int = 64) -> DataFrame:
    """The first ``most`` events of the kinds that are kept. ``most`` is the log's own size."""
    kept = events.where(F.col(method).isin(*TRACKED))
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def hazards(events: DataFrame, by: str = "run", order: str = "pos", method: str = "method", params: str = "params", start_url: str = "start_url", target: str = "target_id") -> DataFrame:
    """``(by, pos, code, method)`` of the first hazardous event of each run.

    ``params`` is JSON. Downloads, choosers, dialogs and popups need confirmation, as does
    a new page that isn't the run's own; a scheduled navigation to another origin is
    blocked, where an address that doesn't parse counts as the same origin.
    """
    p = F.col(params)
    goal = F.coalesce(F.get_json_object(p, "$.url"), F.lit(""))
    known = U.scheme(goal).isNotNull() & U.scheme(F.col(start_url)).isNotNull()
    leaves = (goal != "") & known & ~U.same_origin(goal, F.col(start_url))
    kind = F.coalesce(F.get_json_object(p, "$.targetInfo.type"), F.get_json_object(p, "$.type"))
    new_id = F.coalesce(F.get_json_object(p, "$.targetInfo.targetId"), F.get_json_object(p, "$.targetId"), F.lit(""))
    other = (kind == "page") & (new_id != "") & (new_id != F.col(target))
    code = F.when(F.col(method).isin(*ALWAYS), "requires_confirmation").when((F.col(method) == "Page.frameScheduledNavigation") & leaves, "navigation_blocked").when(F.col(method).isin("Target.targetCreated", "Target.attachedToTarget") & other, "requires_confirmation")
    hit = tracked_events(events, by, order, method).withColumn("code", code).where("code is not null")
    return hit.groupBy(by).agg(F.min(F.struct(F.col(order).alias("pos"), F.col("code"), F.col(method).alias("method"))).alias("h")).select(by, "h.pos", "h.code", "h.method")


def preferred_target(targets: DataFrame, by: str = "run", order: str = "pos", kind: str = "type", url: str = "url", target: str = "target_id") -> DataFrame:
    """``(by, target_id)``: the first page that shows something, else the first page; the browser's own pages don't count."""
    address = F.coalesce(F.col(url), F.lit(""))
    own = address.startswith("chrome://") | address.startswith("chrome-extension://") | address.startswith("devtools://")
    pages = targets.where(F.col(kind).isin("page", "webview") & ~own & F.col(target).isNotNull())
    blank = address.isin("", "about:blank")
    return pages.groupBy(by).agg(F.min(F.struct(blank.alias("blank"), F.col(order).alias("pos"), F.col(target).alias("target_id"))).alias("t")).select(by, "t.target_id")


def frame_origins(tree: str, allowed: list[str]) -> list[str]:
    """Sorted origins of the frames of a frame tree (JSON) whose host an allowed domain covers; opaque ones are dropped."""
    try:
        todo = [json.loads(tree).get("frameTree")]
    except (ValueError, AttributeError):
        return []
    found = set()
    while todo:
        node = todo.pop()
        if not isinstance(node, dict):
            continue
        u = urls.parse(str((node.get("frame") or {}).get("url") or ""))
        if u is not None and u.scheme in ("http", "https", "ftp", "ws", "wss") and u.host and any(urls.domain_covers(d, u.host) for d in allowed):
            found.add(f"{u.scheme}://{u.host}" + (f":{u.port}" if u.port is not None else ""))
        todo += node.get("childFrames") or []
    return sorted(found)


def frame_origin_column(tree: str, allowed: list[str]) -> Column:
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(trees: pa.Array) -> pa.Array:
        return pa.array([None if t is None else frame_origins(t, allowed) for t in trees.to_pylist()], pa.list_(pa.string()))

    return run(tree)


def imported_cookies(cookies: DataFrame, domains: list[str], session: str = "imported") -> tuple[DataFrame, DataFrame]:
    """(cookies, conflicts) of an import: only the named domains, session-only cookies without expiry, http-only, no same-site."""
    test = F.lit(False)
    for d in domains:
        test = test | U.imported_domain_covers(F.col("domain"), F.lit(d))
    kept = cookies.where(test).select(
        F.lit(session).alias("session"), "name", "value", F.lower(F.regexp_replace(F.trim("domain"), r"^\.+|\.+$", "")).alias("domain"), "path",
        F.when(~F.coalesce(F.col("session_only"), F.lit(False)), F.col("expires")).alias("expires"), F.lit(True).alias("http_only"), "secure", F.lit(None).cast("string").alias("same_site"),
    )
    return _merge(kept, ["name", "domain", "path"], ["value", "expires", "http_only", "secure", "same_site"])


def screenshot_warnings(df: DataFrame, wanted: Column, warnings: str = "warnings") -> DataFrame:
    """A warning for each row that asks for a screenshot, as only a rendered page has one."""
    more = F.when(wanted, F.array(F.lit("screenshot was requested but the page was not rendered"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(warnings, F.concat(F.coalesce(F.col(warnings), F.array().cast("array<string>")), more))
