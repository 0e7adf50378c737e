"""Functions of one HTML text; each parses the page once and never raises."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import url as urls
from ..html import Element, parse_document
from ..page.metadata import needs_render as _needs_render
from ..page.metadata import page_metadata as _metadata
from ..page.text import element_text

LINK = pa.struct([("pos", pa.int64()), ("url", pa.string()), ("text", pa.string())])
LINKS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))


def absolute_base(url: str, root: Element) -> str:
    """The page's URL, or its first ``base`` if that is an absolute URL."""
    tag = next((b for b in root.elements("base") if "href" in b.attrs), None)
    own = urls.parse(tag.attrs["href"]) if tag is not None else None
    return str(own) if own is not None else url


def links_of(url: str, root: Element) -> list[dict]:
    """Links that lead to pages, in document order, without fragments."""
    base, out = absolute_base(url, root), []
    for a in root.elements("a"):
        if "href" in a.attrs and (target := urls.followable(base, a.attrs["href"])) is not None:
            out.append({"pos": len(out), "url": urls.without_fragment(target), "text": a.joined_text() or a.attrs.get("aria-label", "").strip()})
    return out


def mapped_links(url: str, root: Element, any_origin: bool, any_path: bool, include: tuple[str, ...], exclude: tuple[str, ...], content_types: tuple[str, ...], max_links: int) -> dict:
    """The links of a page that the filters keep, with what was counted until the cap was reached.

    Origin and path are compared with the document's base, which ``base`` may move away
    from the page's own URL. The first of equal links counts.
    """
    base = absolute_base(url, root)
    home = urls.parse(base)
    prefix = urls.path_prefix(home.path) if home is not None else None
    seen, out, discovered = set(), [], 0
    for link in links_of(url, root):
        discovered += 1
        if link["url"] in seen:
            continue
        seen.add(link["url"])
        target = urls.parse(link["url"])
        same_origin = urls.same_origin(target, home)
        same_path = prefix is not None and target is not None and target.path.startswith(prefix)
        kind = urls.content_type_of(target.path) if target is not None else None
        if not (any_origin or same_origin) or not (any_path or same_path):
            continue
        if include and not any(urls.glob_match(x, link["url"]) for x in include) or any(urls.glob_match(x, link["url"]) for x in exclude):
            continue
        if content_types and kind not in content_types:
            continue
        out.append({"url": link["url"], "text": link["text"], "same_origin": same_origin, "same_path": same_path, "content_type": kind})
        if len(out) == max_links:
            break
    return {"discovered": discovered, "truncated": len(out) == max_links, "links": out}


_MAPPED = [("url", pa.string(), T.StringType()), ("text", pa.string(), T.StringType()), ("same_origin", pa.bool_(), T.BooleanType()), ("same_path", pa.bool_(), T.BooleanType()), ("content_type", pa.string(), T.StringType())]
MAP = pa.struct([("discovered", pa.int64()), ("truncated", pa.bool_()), ("links", pa.list_(pa.struct([(n, k) for n, k, _ in _MAPPED])))])
MAP_TYPE = T.StructType([T.StructField("discovered", T.LongType()), T.StructField("truncated", T.BooleanType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in _MAPPED])))])


def page_map(**filters):
    """An Arrow function of (url, html) with the result of ``mapped_links``; a page that can't be parsed has no links."""
    return text_function(lambda u, h: mapped_links(u, parse_document(h), **filters), MAP, MAP_TYPE, {"discovered": 0, "truncated": False, "links": []})


def _safe(function, empty):
    def run(*args):
        if any(a is None for a in args):
            return None
        try:
            return function(*args)
        except RecursionError:
            return empty

    return run


def text_function(function, kind: pa.DataType, spark_type: T.DataType, empty=None):
    """An Arrow function of texts; null for a null argument, ``empty`` for a page nested too deeply to be walked."""
    safe = _safe(function, empty)

    @F.arrow_udf(spark_type)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([safe(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return run


html_text = text_function(lambda h: element_text(parse_document(h)), pa.string(), T.StringType())
page_metadata = text_function(lambda h: sorted(_metadata(parse_document(h)).items()), pa.map_(pa.string(), pa.string()), T.MapType(T.StringType(), T.StringType()))
needs_render = text_function(lambda h: _needs_render(parse_document(h)), pa.bool_(), T.BooleanType())
page_links = text_function(lambda u, h: links_of(u, parse_document(h)), pa.list_(LINK), LINKS)


def _candidates(h: str) -> list[dict]:
    from ..page.content import candidates, score

    found = candidates(parse_document(h))
    return [{"pos": i, "tag": e.name, "score": score(e, 1)} for i, e in enumerate(found)]


_CANDIDATE = pa.struct([("pos", pa.int64()), ("tag", pa.string()), ("score", pa.int64())])
#: Containers in the order in which ties are decided, with their scores before any clean-up.
content_candidates = text_function(_candidates, pa.list_(_CANDIDATE), T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("tag", T.StringType()), T.StructField("score", T.LongType())])))
