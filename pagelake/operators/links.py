"""Link discovery: links of pages, filtered by origin, path, patterns and content type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import page_links, page_map
from ..session import spread


def any_pattern(url: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches; patterns without ``*`` stay in the JVM."""
    test = F.lit(False)
    for p in patterns:
        test = test | (U.glob_match(F.lit(p), url) if "*" in p else url.contains(p))
    return test


def discovered_links(df: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(key, source_url, pos, url, text)``: every link of every page in document order, fragments dropped."""
    return spread(df).select(key, F.col(url_col).alias("source_url"), F.explode(page_links(F.col(url_col), F.col(html_col))).alias("link")).select(key, "source_url", "link.*")


def filter_links(links: DataFrame, key: str = "page_id", any_origin: bool = False, any_path: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), content_types: Sequence[str] = (), max_links: int = 500) -> DataFrame:
    """Links of each page after dedupe, filters and cap, in this order; the cap counts in document order.

    ``links`` has ``(key, source_url, pos, url, text)``.  The first text of a link wins.
    The path filter compares with the directory of ``source_url`` whatever the origin; give
    the document's base there for pages that have one.
    """
    if not 1 <= max_links <= 5000:
        raise ValueError("max_links must be from 1 to 5000")
    first = Window.partitionBy(key, "url").orderBy("pos")
    # source_url is the same for all links of a page
    out = links.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    source, target = F.col("source_url"), F.col("url")
    out = out.withColumns({"same_origin": U.same_origin(source, target), "same_path": F.coalesce(U.path(target).startswith(U.path_prefix(U.path(source))), F.lit(False)), "content_type": U.content_type(U.path(target))})
    if not any_origin:
        out = out.where("same_origin")
    if not any_path:
        out = out.where("same_path")
    if include:
        out = out.where(any_pattern(target, include))
    if exclude:
        out = out.where(~any_pattern(target, exclude))
    if content_types:
        out = out.where(F.col("content_type").isin(*content_types))
    cap = Window.partitionBy(key).orderBy("pos")
    return out.withColumn("rank", F.row_number().over(cap)).where(F.col("rank") <= max_links)


def _mapped(df: DataFrame, key: str, url_col: str, html_col: str, max_links: int, any_origin: bool = False, any_path: bool = False, include: Sequence[str] = (), exclude: Sequence[str] = (), content_types: Sequence[str] = ()) -> DataFrame:
    if not 1 <= max_links <= 5000:
        raise ValueError("max_links must be from 1 to 5000")
    found = page_map(any_origin=any_origin, any_path=any_path, include=tuple(include), exclude=tuple(exclude), content_types=tuple(content_types), max_links=max_links)
    return spread(df.select(key, F.col(url_col).alias("source_url"), F.col(html_col).alias("__html"))).select(key, "source_url", found(F.col("source_url"), F.col("__html")).alias("map"))


def map_links(df: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html", max_links: int = 500, **filters) -> DataFrame:
    """``(key, url, text, source_url, same_origin, same_path, content_type)``, sorted by ``url`` within a page.

    Links are deduped, filtered and capped where the page is parsed, so nothing is
    shuffled. Origin and path are compared with the document's base.
    """
    out = _mapped(df, key, url_col, html_col, max_links, **filters)
    return out.select(key, "source_url", F.explode(F.array_sort("map.links")).alias("link")).select(key, "link.url", "link.text", "source_url", "link.same_origin", "link.same_path", "link.content_type")


def map_summary(df: DataFrame, key: str = "page_id", url_col: str = "url", html_col: str = "html", max_links: int = 500, **filters) -> DataFrame:
    """``(key, discovered, emitted, truncated)``; discovery stops with the link that fills the cap. A page without URL or text has no links."""
    out = _mapped(df, key, url_col, html_col, max_links, **filters)
    return out.select(key, F.coalesce("map.discovered", F.lit(0)).cast("bigint").alias("discovered"), F.coalesce(F.size("map.links"), F.lit(0)).cast("bigint").alias("emitted"), F.coalesce("map.truncated", F.lit(False)).alias("truncated"))
