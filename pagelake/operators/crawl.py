"""Bounded breadth-first crawl over a table of links or of pages.

The frontier lives on the driver: a crawl fetches at most 100 pages, so a wave is a few
rows. The links of a wave are filtered by scope where they lie, and of each page only as
many as the queue can take come to the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import url as urls
from ..functions import urls as U
from ..functions.html import links_of, text_function
from ..html import parse_document
from ..page import Options
from . import pages as get_pages
from .links import any_pattern


@dataclass(frozen=True)
class Scope:
    """Which links a crawl follows: origin or allowed domains, the start's directory, patterns."""

    start: str
    same_origin: bool = True
    same_path: bool = False
    allow_domains: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def admits(self, url: str) -> bool:
        target, home = urls.parse(url), urls.parse(self.start)
        if target is None or home is None or target.host is None:
            return False
        here = urls.same_origin(target, home)
        if self.same_origin and not here and not any(urls.host_matches(target.host, d) for d in self.allow_domains):
            return False
        if self.same_path and not target.path.startswith(urls.path_prefix(home.path)):
            return False
        if self.include and not any(urls.glob_match(p, url) for p in self.include):
            return False
        return not any(urls.glob_match(p, url) for p in self.exclude)

    def condition(self, url: Column) -> Column:
        """``admits`` as an expression over URLs in normal form, for the filter that goes to the link table."""
        home = urls.parse(self.start)
        if home is None:
            return F.lit(False)
        test = U.host(url).isNotNull()
        if self.same_origin:
            here = U.same_origin(url, F.lit(str(home)))
            for domain in self.allow_domains:
                here = here | F.coalesce(U.host_matches(U.host(url), F.lit(domain)), F.lit(False))
            test = test & here
        if self.same_path:
            test = test & U.path(url).startswith(urls.path_prefix(home.path))
        if self.include:
            test = test & any_pattern(url, self.include)
        return test & ~any_pattern(url, self.exclude) if self.exclude else test


SCHEMA = "index bigint, url string, final_url string, depth bigint, source_url string, status string, error string"


def crawl(pages: DataFrame, links: DataFrame, start: str, limit: int, max_depth: int = 2, concurrency: int = 2, scope: Scope | None = None) -> DataFrame:
    """``(index, url, final_url, depth, source_url, status, error)`` in fetch order.

    ``pages`` has ``(url, final_url)`` of what can be fetched, ``links`` has
    ``(source_url, pos, url)`` with URLs in normal form. A URL without a page fails. Links of a wave
    are queued in order until fetched and queued items fill the limit; a URL that is
    queued twice takes two places of the limit.
    """
    spark = pages.sparkSession

    def visit(wave: list[tuple[str, int, str | None]], most: int) -> dict[str, tuple[str | None, str | None, list[str]]]:
        found = _fetch(pages, [w[0] for w in wave])
        wanted = [u for u, depth, _ in wave if u in found and depth < max_depth]
        out = _links(links, wanted, scope or Scope(start), most) if wanted else {}
        return {u: (final, None, out.get(u, [])) for u, final in found.items()}

    return spark.createDataFrame(_crawl(visit, start, limit, max_depth, concurrency), SCHEMA)


def crawl_pages(pages: DataFrame, start: str, limit: int, max_depth: int = 2, concurrency: int = 2, scope: Scope | None = None, options: Options = Options(), url_col: str = "url", html_col: str = "html", final_col: str | None = None) -> DataFrame:
    """``crawl`` over pages with their HTML: links are those of the cleaned page, and a page whose extraction fails is a failed item.

    Links are resolved against the final URL (``final_col``, else the URL), or a base that
    the clean-up has left. The pages of a wave are parsed by the tasks; of each the links
    in scope that could still be queued come to the driver, at most 200.
    """
    scope = scope or Scope(start)
    final = F.coalesce(F.col(final_col), F.col(url_col)) if final_col else F.col(url_col)

    def visit(wave: list[tuple[str, int, str | None]], most: int) -> dict[str, tuple[str | None, str | None, list[str]]]:
        def targets(url: str, html: str) -> list[str]:
            found = dict.fromkeys(link["url"] for link in links_of(url, parse_document(html)))
            return [u for u in found if scope.admits(u)][:most]

        asked = U.without_fragment(F.col(url_col))
        rows = pages.where(asked.isin(*(w[0] for w in wave))).select(asked.alias("asked"), final.alias("url"), F.col(html_col).alias("html"))
        # of several records of one URL the first that has a text
        one = rows.groupBy("asked").agg(F.min(F.struct(F.col("html").isNull().alias("gone"), "url", "html")).alias("r")).select("asked", "r.url", "r.html")
        got = get_pages.get(one, replace(options, format="html"), keep=("asked",))
        listed = text_function(targets, pa.list_(pa.string()), T.ArrayType(T.StringType()), [])
        out = got.select("asked", "final_url", F.when(~F.col("ok"), F.col("error.message")).alias("error"), listed("final_url", "content").alias("links")).collect()
        return {r["asked"]: (r["final_url"], r["error"], r["links"] or []) for r in out}

    return pages.sparkSession.createDataFrame(_crawl(visit, start, limit, max_depth, concurrency), SCHEMA)


def _crawl(visit: Callable, start: str, limit: int, max_depth: int, concurrency: int) -> list[tuple]:
    if not 1 <= limit <= 100 or not 0 <= max_depth <= 5 or not 1 <= concurrency <= 8:
        raise ValueError("limit must be 1..100, max_depth 0..5, concurrency 1..8")
    first = urls.parse(start)
    queue: deque[tuple[str, int, str | None]] = deque([(urls.without_fragment(str(first)) if first else start, 0, None)])
    scheduled: set[str] = set()
    items: list[tuple] = []
    while queue and len(items) < limit:
        wave: list[tuple[str, int, str | None]] = []
        while queue and len(wave) < concurrency and len(items) + len(wave) < limit:
            candidate = queue.popleft()
            if candidate[0] not in scheduled:
                scheduled.add(candidate[0])
                wave.append(candidate)
        if not wave:
            continue
        # a link that was fetched before takes no place, so that many more may have to be seen
        found = visit(wave, limit + len(scheduled))
        for url, depth, source in wave:
            final, error, targets = found.get(url, (None, "page not found", []))
            ok = error is None
            for target in dict.fromkeys(targets) if ok and depth < max_depth else ():
                if len(items) + len(queue) >= limit:
                    break
                if target not in scheduled:
                    queue.append((target, depth + 1, url))
            items.append((len(items), url, final, depth, source, "ok" if ok else "failed", error))
    return items


def _fetch(pages: DataFrame, wave: Sequence[str]) -> dict[str, str]:
    """Final URLs of the pages of a wave: at most eight rows."""
    rows = pages.where(F.col("url").isin(*wave)).groupBy("url").agg(F.min(F.coalesce("final_url", "url")).alias("final_url")).collect()
    return {r[0]: r[1] for r in rows}


def _links(links: DataFrame, wave: Sequence[str], scope: Scope, most: int) -> dict[str, list[str]]:
    """The first ``most`` distinct targets in scope of each page of a wave, in document order: at most eight times 200 rows."""
    target = U.without_fragment(F.col("url"))
    kept = links.where(F.col("source_url").isin(*wave)).select("source_url", target.alias("url"), "pos").where(scope.condition(F.col("url")))
    first = kept.groupBy("source_url", "url").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("source_url").orderBy("pos", "url"))).where(F.col("n") <= most)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("source_url", "pos", "url").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def crawl_summary(items: DataFrame, by: str = "crawl_id") -> DataFrame:
    """Counts of each crawl; ``ok`` means that nothing failed."""
    return items.groupBy(by).agg(F.count("*").alias("fetched"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("ok", F.col("failed") == 0)


def crawl_manifest(items: DataFrame, start: str, limit: int) -> DataFrame:
    """One row ``(manifest_json, manifest_md, metadata_json)`` of a crawl; its items are at most 100."""
    one = F.struct("index", "url", "final_url", "depth", "source_url", "status", "error")
    head = items.agg(F.count("*").alias("fetched"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.array_sort(F.collect_list(one)).alias("items"))
    summary_ = F.struct("fetched", "succeeded", "failed", F.lit(limit).cast("bigint").alias("limit"))
    line = F.transform("items", lambda i: F.concat(F.lit("- "), i["status"], F.lit(" depth="), i["depth"].cast("string"), F.lit(" `"), i["url"], F.lit("`\n")))
    title = F.concat(F.lit(f"# Crawl\n\nStart: {start}\nFetched: "), F.col("fetched").cast("string"), F.lit("\nSucceeded: "), F.col("succeeded").cast("string"), F.lit("\nFailed: "), F.col("failed").cast("string"), F.lit("\n\n"))
    return head.select(
        F.to_json(F.struct(F.lit(start).alias("start_url"), summary_.alias("summary"), "items"), {"pretty": "true"}).alias("manifest_json"),
        F.concat(title, F.array_join(line, "")).alias("manifest_md"),
        F.to_json(F.struct((F.col("failed") == 0).alias("ok"), F.lit("crawl").alias("command"), F.lit(start).alias("url"), summary_.alias("summary")), {"pretty": "true"}).alias("metadata_json"),
    )
