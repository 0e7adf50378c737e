"""Structured extraction: headings, links, tables, definitions, metadata, selector and JSON fields of each source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import url as urls
from ..functions.html import absolute_base
from ..session import spread
from ..html import Element, SelectorError, inner_html, parse_document, select
from ..html.select import compile_selector

KINDS = ("headings", "links", "tables", "definitions", "metadata", "selector", "json")


class FieldError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """One field; ``selector`` fields need a selector, ``json`` fields a path."""

    name: str
    kind: str
    selector: str | None = None
    attribute: str | None = None
    multiple: bool = False
    path: str | None = None

    def __post_init__(self) -> None:
        if not self.name or self.kind not in KINDS:
            raise FieldError(f"field '{self.name}' has no known type: '{self.kind}'")
        if self.kind == "selector":
            if not self.selector:
                raise FieldError(f"selector field '{self.name}' needs a selector")
            try:
                compile_selector(self.selector)
            except SelectorError as error:
                raise FieldError(str(error)) from error
        if self.kind == "json" and not self.path:
            raise FieldError(f"json field '{self.name}' needs a path")


def read_schema(text: str) -> list[Field]:
    """Fields of a JSON schema ``{"fields": [{"name", "type", ...}]}``; at least one, unknown keys are ignored."""
    try:
        raw = json.loads(text)["fields"]
    except (ValueError, KeyError, TypeError) as error:
        raise FieldError("a schema is an object with a list of fields") from error
    if not isinstance(raw, list) or not raw:
        raise FieldError("a schema needs at least one field")
    return [Field(f.get("name", ""), f.get("type", ""), f.get("selector"), f.get("attribute"), bool(f.get("multiple")), f.get("path")) for f in raw]


def shortcut(*kinds: str) -> list[Field]:
    """Fields named after the built-in kinds."""
    return [Field(k, k) for k in kinds]


def pointer(path: str) -> str:
    """A JSON pointer: paths with a leading slash as they are, dotted ones translated."""
    if path.startswith("/"):
        return path
    parts = (p.replace("~", "~0").replace("/", "~1") for p in path.removeprefix("$.").split(".") if p)
    return "/" + "/".join(parts)


def at_pointer(value: object, where: str) -> object:
    """The value at a JSON pointer; None where there is none."""
    if where == "":
        return value
    if not where.startswith("/"):
        return None
    for part in where[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and part in value:
            value = value[part]
        elif isinstance(value, list) and re.fullmatch(r"0|[1-9]\d*", part) and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def is_html(kind: str | None, content: str) -> bool:
    return kind == "html" or any(mark in content for mark in ("<html", "<table", "<a ", "<dl"))


def lines_of(text: str) -> list[str]:
    """Lines as the rest of the engine counts them: cut at line feeds, a carriage return before one dropped."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


# -- Markdown and text ---------------------------------------------------------------

_HEADING = re.compile(r"^\s*(#{1,6}) (.*)$", re.S)


def markdown_headings(text: str) -> list[dict]:
    return [{"level": len(m.group(1)), "text": m.group(2).strip()} for m in map(_HEADING.match, lines_of(text)) if m]


def markdown_links(text: str, base: str) -> list[dict]:
    """Inline links; images and links without text or target are skipped, a bracket runs to the next ``](``."""
    out, at = [], 0
    while (start := text.find("[", at)) >= 0:
        if start and text[start - 1] == "!":
            at = start + 1
            continue
        middle = text.find("](", start)
        end = text.find(")", middle + 2) if middle >= 0 else -1
        if end < 0:
            break
        label, target = text[start + 1 : middle].strip(), text[middle + 2 : end].strip()
        if label and target:
            out.append({"text": label, "url": href_target(base, target)})
        at = end + 1
    return out


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _is_row(line: str) -> bool:
    return "|" in line and len(_cells(line)) > 1


def _is_rule(line: str) -> bool:
    cells = _cells(line)
    return len(cells) > 1 and all("-" in c and not c.strip("-: ") for c in cells)


def table_record(headers: list[str], rows: list[list[str]]) -> dict:
    """Rows as objects keyed by header: a repeated header keeps its last cell, surplus cells fall away, missing ones are empty."""
    return {"headers": headers, "rows": [dict(zip(headers, row + [""] * max(0, len(headers) - len(row)))) for row in rows]}


def markdown_tables(text: str) -> list[dict]:
    lines, out, at = lines_of(text), [], 0
    while at + 1 < len(lines):
        if not (_is_row(lines[at]) and _is_rule(lines[at + 1])):
            at += 1
            continue
        end = at + 2
        while end < len(lines) and _is_row(lines[end]):
            end += 1
        out.append(table_record(_cells(lines[at]), [_cells(x) for x in lines[at + 2 : end]]))
        at = end
    return out


def markdown_definitions(text: str) -> list[dict]:
    """``term: definition`` lines; a term has at most 80 bytes, is no heading and no URL."""
    out = []
    for line in lines_of(text):
        term, colon, definition = (x.strip() for x in line.strip().partition(":"))
        if colon and term and definition and len(term.encode()) <= 80 and "://" not in term and not term.startswith("#"):
            out.append({"term": term, "definition": definition})
    return out


# -- HTML ----------------------------------------------------------------------------


def href_target(base: str, href: str) -> str:
    href = href.strip()
    if not href or href.startswith("javascript:"):
        return ""
    return urls.join(base, href) or href


def html_headings(root: Element) -> list[dict]:
    return [{"level": int(e.name[1]), "text": e.joined_text()} for e in root.elements("h1", "h2", "h3", "h4", "h5", "h6")]


def html_links(root: Element, url: str) -> list[dict]:
    base = absolute_base(url, root)
    return [{"text": a.joined_text(), "url": href_target(base, a.attrs["href"])} for a in root.elements("a") if "href" in a.attrs]


def html_tables(root: Element) -> list[dict]:
    """Each table with all rows under it, so rows of a nested table count twice; the first row is the header if it holds a ``th``."""
    out = []
    for table in root.elements("table"):
        trs = list(table.elements("tr"))
        rows = [row for row in ([c.joined_text() for c in tr.elements("th", "td")] for tr in trs) if row]
        if not rows:
            continue
        if next(trs[0].elements("th"), None) is not None:
            headers, rows = rows[0], rows[1:]
        else:
            headers = [f"column_{i}" for i in range(1, max(map(len, rows)) + 1)]
        out.append(table_record(headers, rows))
    return out


def html_definitions(root: Element) -> list[dict]:
    """All terms of the page paired with all definitions in order."""
    return [{"term": t.joined_text(), "definition": d.joined_text()} for t, d in zip(root.elements("dt"), root.elements("dd"))]


def _selected(e: Element, attribute: str | None) -> str:
    if attribute in (None, "text"):
        return e.joined_text()
    return inner_html(e) if attribute == "html" else e.attrs.get(attribute.removeprefix("attr:").lower(), "")


# -- a source -------------------------------------------------------------------------


def values_of(content: str, kind: str | None, url: str, metadata: str | None, fields: Iterable[Field]) -> dict[str, object]:
    """Values by field name; the page is parsed once for all fields. Raises ``FieldError``."""
    page: Element | None = parse_document(content) if is_html(kind, content) else None
    out: dict[str, object] = {}
    for f in fields:
        if f.kind == "headings":
            value: object = html_headings(page) if page is not None else markdown_headings(content)
        elif f.kind == "links":
            value = html_links(page, url) if page is not None else markdown_links(content, url)
        elif f.kind == "tables":
            value = html_tables(page) if page is not None else markdown_tables(content)
        elif f.kind == "definitions":
            value = html_definitions(page) if page is not None else markdown_definitions(content)
        elif f.kind == "metadata":
            try:
                known = json.loads(metadata) if metadata else None
            except ValueError:
                known = None
            value = known if f.path is None else at_pointer(known, pointer(f.path))
        elif f.kind == "selector":
            if page is None:
                raise FieldError(f"selector field '{f.name}' needs an HTML source")
            found = [_selected(e, f.attribute) for e in select(page, f.selector)]
            value = found if f.multiple else next(iter(found), None)
        else:
            try:
                value = at_pointer(json.loads(content), pointer(f.path or ""))
            except (ValueError, RecursionError) as error:
                raise FieldError(f"json field '{f.name}' needs JSON content") from error
        out[f.name] = value
    return out


def extract_fields(df: DataFrame, fields: list[Field], key: str = "page_id", url: str = "url", final_url: str | None = "final_url", content: str = "content", kind: str | None = "content_format", metadata: str | None = "metadata", sensitive: str | None = "sensitive") -> DataFrame:
    """``(key, url, final_url, sensitive, ok, values VARIANT, error, provenance)``: one record a row.

    A failing row carries its error and null values; null contents fail. Of fields with
    one name the last value stays and each keeps its provenance.
    """
    if not fields:
        raise FieldError("at least one field is needed")
    last = F.coalesce(F.col(final_url), F.col(url)) if final_url else F.col(url)
    inner = df.select(key, F.col(url).alias("url"), last.alias("final_url"), (F.col(sensitive) if sensitive else F.lit(False)).alias("sensitive"), F.col(content).alias("__content"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("__kind"), (F.col(metadata) if metadata else F.lit(None).cast("string")).alias("__metadata"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for last_url, text, k, meta in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6))):
                value = error = None
                try:
                    if text is None:
                        raise FieldError("no content")
                    value = json.dumps(values_of(text, k, last_url or "", meta, fields), ensure_ascii=False)
                except (FieldError, RecursionError) as problem:
                    error = str(problem)
                texts.append(value)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(errors, pa.string())], [key, "url", "final_url", "sensitive", "values_json", "error"])

    out = spread(inner).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, url string, final_url string, sensitive boolean, values_json string, error string")
    provenance = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.col("final_url").alias("source_url"), F.lit(f.selector).cast("string").alias("selector"), F.lit(f.path).cast("string").alias("path")) for f in fields))
    return out.select(key, "url", "final_url", "sensitive", F.col("error").isNull().alias("ok"), F.try_parse_json("values_json").alias("values"), "values_json", "error", provenance.alias("provenance"))


def extract_summary(records: DataFrame, fields: list[Field]) -> DataFrame:
    """Counts over the records of one extraction."""
    return records.agg(F.count("*").alias("sources"), F.lit(len(fields)).cast("bigint").alias("fields"), F.count_if("sensitive").alias("sensitive_sources"), F.count_if(~F.col("ok")).alias("failed"))
