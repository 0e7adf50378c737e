"""Action plans: validation, redaction, and the rows of a dry run."""

from __future__ import annotations

import json
import re
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..html import SelectorError
from ..html.select import compile_selector
from ..page import Options
from . import pages

VERSION = "pagelake.actions.v1"
MOST_ACTIONS, MOST_NAME = 50, 80
#: Keys of each action; True if required.
KEYS: dict[str, dict[str, bool]] = {
    "wait": {"selector": False, "load_state": False, "duration_ms": False},
    "click": {"selector": True},
    "type": {"selector": True, "text": True, "sensitive": False, "clear": False},
    "select": {"selector": True, "value": False, "label": False, "index": False},
    "submit": {"selector": True, "confirm": False},
    "capture": {"name": True, "screenshot": False, "html": False, "selector": False},
    "extract": {"selector": False, "format": False},
}
COMMON = frozenset(("type", "timeout_ms"))


def _one_of(action: dict, keys: tuple[str, ...]) -> bool:
    return sum(action.get(k) is not None for k in keys) == 1


def plan_errors(text: str, allow_sensitive: bool = False, allow_submit: bool = False, version: str = VERSION) -> list[str]:
    """What is wrong with a plan; [] if nothing is."""
    try:
        plan = json.loads(text)
    except ValueError:
        return ["the plan is no JSON"]
    if not isinstance(plan, dict):
        return ["the plan is no object"]
    out = [f"unknown key '{k}'" for k in plan if k not in ("schema_version", "defaults", "actions")]
    if plan.get("schema_version") != version:
        out.append(f"schema_version must be '{version}'")
    actions = plan.get("actions")
    if not isinstance(actions, list) or not 1 <= len(actions) <= MOST_ACTIONS:
        return [*out, f"a plan has 1 to {MOST_ACTIONS} actions"]
    names: set[str] = set()
    for i, a in enumerate(actions):
        out += [f"action {i} {problem}" for problem in _action_errors(a, names, allow_sensitive, allow_submit)]
    return out


def _action_errors(a: object, names: set[str], allow_sensitive: bool, allow_submit: bool) -> list[str]:
    if not isinstance(a, dict) or a.get("type") not in KEYS:
        return ["has no known type"]
    kind = a["type"]
    keys = KEYS[kind]
    out = [f"has the unknown key '{k}'" for k in a if k not in keys and k not in COMMON] + [f"needs '{k}'" for k, required in keys.items() if required and a.get(k) is None]
    if a.get("selector") is not None:
        try:
            compile_selector(str(a["selector"]))
        except SelectorError as error:
            out.append(f"the selector of this {kind} can't be read: {error}")
    if kind == "wait" and not _one_of(a, ("selector", "load_state", "duration_ms")):
        out.append("a wait names one thing to wait for: selector, load_state or duration_ms")
    if kind == "select" and not _one_of(a, ("value", "label", "index")):
        out.append("a select names its option in one way: value, label or index")
    if kind == "type" and a.get("sensitive") and not allow_sensitive:
        out.append("types sensitive text, which must be allowed")
    if kind == "submit" and not (a.get("confirm") is True and allow_submit):
        out.append("submit must be confirmed and allowed")
    if kind == "capture":
        name = str(a.get("name") or "")
        if not re.fullmatch(rf"[A-Za-z0-9._-]{{1,{MOST_NAME}}}", name):
            out.append(f"capture name must have 1 to {MOST_NAME} letters, digits, dots, dashes and underscores")
        elif name in names:
            out.append(f"two captures are called '{name}'")
        names.add(name)
        if not (a.get("screenshot") or a.get("html")):
            out.append("a capture asks for screenshot, html or both")
    return out


def redacted_plan(text: str) -> str | None:
    """The plan with sensitive texts replaced and their length noted; None if it is no plan."""
    try:
        plan = json.loads(text)
        for a in plan["actions"]:
            if a.get("type") == "type" and a.get("sensitive"):
                a |= {"text": "<redacted>", "text_redacted": True, "text_chars": len(a.get("text") or "")}
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    return json.dumps(plan, ensure_ascii=False)


def validate_plans(df: DataFrame, plan: str = "plan", allow_sensitive: bool = False, allow_submit: bool = False) -> DataFrame:
    """``errors``, ``ok`` and ``redacted`` for each plan; a null plan is an error."""

    @F.arrow_udf("array<string>")
    def errors(texts: pa.Array) -> pa.Array:
        return pa.array([plan_errors(t or "", allow_sensitive, allow_submit) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted_plan(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn("errors", errors(plan)).withColumn("ok", F.size("errors") == 0).withColumn("redacted", redacted(plan))


def dry_run(df: DataFrame, plan: str = "plan", key: str = "run") -> DataFrame:
    """``(key, index, type, status)``: one row for each action of a valid plan, in order."""
    actions = F.from_json(F.get_json_object(F.col(plan), "$.actions"), "array<struct<type:string>>")
    return validate_plans(df, plan).where("ok").select(key, F.posexplode(actions).alias("index", "a")).select(key, F.col("index").cast("bigint").alias("index"), F.col("a.type").alias("type"), F.lit("planned").alias("status"))


def until_failure(rows: DataFrame, by: str = "run", order: str = "index", status: str = "status") -> DataFrame:
    """Result rows up to the first failed action of each run."""
    failed = rows.where(F.col(status) == "failed").groupBy(by).agg(F.min(order).alias("__first"))
    return rows.join(failed, by, "left").where(F.col("__first").isNull() | (F.col(order) <= F.col("__first"))).drop("__first")


def extract_results(df: DataFrame, options: Options = Options(), by: str = "run", url: str = "url", html: str = "html", selector: str = "selector") -> DataFrame:
    """Extract actions on the pages that they saw: ``(by, ok, content, error)``.

    A browser resolves an action's selector and hands over that element's markup (``html``
    is then the element), which is extracted without a selector, so the choice of the main
    content applies to it. A row with a selector and no markup had no such element.
    """
    rows = df.withColumn("__missed", F.col(html).isNull() & F.col(selector).isNotNull()).select(by, "__missed", F.col(url).alias("url"), F.col(html).alias("html"))
    got = pages.get(rows, replace(options, selector=None), keep=(by, "__missed"))
    missed = F.struct(F.lit("selector_not_found").alias("code"), F.lit("no element matched the selector").alias("message"))
    return got.select(by, "ok", "content", F.when(F.col("__missed"), missed).otherwise(F.col("error")).alias("error"))
