"""Lines repeated across one site's documents (problem 4).

Numbers, dates and names are masked in each line; the masked lines of a site are
clustered by locality-sensitive hashing of their word sets, and the lines of clusters
that reach a share of the site's pages come out.  The first pass counts pages per
cluster (pre-aggregated in each task, one 64-bit key and a count per row); the second
emits only the lines of hot clusters.  Optionally a line must also be hot in its own
exact form, which is counted over the emitted lines: equal lines share their cluster,
so no occurrence is missing.

A site that holds a third of all pages adds nothing but larger counts: no task ever
holds a site's lines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .common import WORD, arrow_map, drop_tags, mix64, need, site_of

DIGITS = re.compile("[0-9]+")
#: Month names, masked as parts of dates.
MONTHS = frozenset("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
ROWS, BANDS = 4, 2
_RNG = np.random.default_rng(20240229)
_SEEDS = _RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_MULTS = (_RNG.integers(0, 2**32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def line_forms(content: str, html: bool) -> list[str]:
    """The form of each line: no markup tags (html only), no digits, single spaces, trimmed, lower case."""
    if html:
        content = drop_tags(content)
    return [" ".join(line.split()) for line in DIGITS.sub("", content).lower().split("\n")]


class _Bands:
    """Cluster keys of line forms, remembered for lines seen before (bounded)."""

    def __init__(self, most: int = 400_000):
        self.words: dict[str, int] = {}
        self.most = most

    def __call__(self, forms: list[str], sites: np.ndarray, names: list[frozenset[str]]) -> np.ndarray:
        """(BANDS, n) keys; ``names``: the words of each line's site name, masked like other names."""
        words = self.words
        if len(words) > self.most:
            words.clear()
        flat, starts = [], np.empty(len(forms), np.int64)
        for i, (form, own) in enumerate(zip(forms, names)):
            starts[i] = len(flat)
            got = [w for w in WORD.findall(form) if w not in MONTHS and w not in own]
            try:
                flat += [words[w] for w in got]
            except KeyError:
                for w in got:
                    if w not in words:
                        words[w] = xxhash.xxh32_intdigest(w)
                flat += [words[w] for w in got]
            if len(flat) == starts[i]:
                flat.append(xxhash.xxh32_intdigest(form))
        tokens = np.array(flat, np.uint64).astype(np.uint32)
        keys = np.empty((BANDS, len(forms)), np.uint64)
        for b in range(BANDS):
            key = sites.astype(np.uint64) + np.uint64(b + 1)
            for r in range(b * ROWS, (b + 1) * ROWS):
                key = mix64(key) ^ np.minimum.reduceat((tokens ^ _SEEDS[r]) * _MULTS[r], starts)
            keys[b] = mix64(key)
        return keys


def _lines_of(batch: pa.RecordBatch, least: int):
    """(page, line number, form, site hash, site words) of all lines of at least ``least`` characters."""
    page, number, forms, sites, names = [], [], [], [], []
    known: dict[str, frozenset[str]] = {}
    for p, site, kind, content, digest in zip(*(batch.column(i).to_pylist() for i in range(5))):
        words = known.get(site) or known.setdefault(site, frozenset(WORD.findall(site)))
        for k, form in enumerate(line_forms(content, kind == "html"), 1):
            if len(form) >= least:
                page.append(p)
                number.append(k)
                forms.append(form)
                sites.append(digest)
                names.append(words)
    return page, number, forms, np.array(sites, np.int64).view(np.uint64), names


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def repeated_lines(pages: DataFrame, min_pages: int = 6, min_share: float = 0.2, min_chars: int = 15, exact: bool = False, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``(page_id, line_no)`` of the lines in clusters of near-equal lines that at least ``min_pages`` pages and ``min_share`` of the site's pages hold.

    ``exact``: only lines whose own form reaches the same two counts.  Pages with null
    content don't count; a page without an address belongs to the site ''.  ``page_id``
    is the key of ``pages``: a row repeated under one id is taken once.  Further columns
    are ignored; an empty table gives no rows.  The hot cluster keys are broadcast up to
    ``broadcast_keys`` of 8 bytes each; beyond, the lines are joined with them instead.
    """
    spark = pages.sparkSession
    base = need(pages, "page_id", "final_url", "url", "content_format", "content").where("content is not null")
    base = base.select("page_id", site_of(F.col("final_url"), F.col("url")).alias("site"), "content_format", "content").withColumn("site_key", F.xxhash64("site"))
    if not exact and base.groupBy("page_id").count().where("count > 1").limit(1).count():
        base = base.dropDuplicates(["page_id"])  # the exact count takes an id once by itself
    lines_of = spread(base)
    totals = base.groupBy(F.col("site_key").alias("site")).agg(F.count_distinct("page_id").alias("pages"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        page, _, forms, sites, names = _lines_of(batch, min_chars)
        if not forms:
            return None
        out = []
        rank = np.unique(np.array(page), return_inverse=True)[1].astype(np.uint64)
        for key in _Bands()(forms, sites, names):
            # once a page: distinct (cluster, page), then pages per cluster
            order = np.lexsort((rank, key))
            k, r, s = key[order], rank[order], sites[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
            k, s = k[new], s[new]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            out.append((s[first], k[first], np.diff(np.append(first, len(k)))))
        return pa.RecordBatch.from_arrays([_signed(np.concatenate([o[0] for o in out])), _signed(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64))], ["site", "key", "n"])

    counts = arrow_map(lines_of, count, "site bigint, key bigint, n bigint", text="content").groupBy("site", "key").agg(F.sum("n").alias("n"))
    clusters = counts.where(F.col("n") >= min_pages)
    hot = cut_lineage(clusters.join(totals, "site").where(F.col("n") >= F.col("pages") * min_share).select("site", "key", "pages"))
    small = hot.count() <= broadcast_keys
    held = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in hot.select("key").collect()), np.int64).view(np.uint64))) if small else None

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        page, number, forms, sites, names = _lines_of(batch, min_chars)
        if not forms:
            return None
        keys = _Bands()(forms, sites, names)
        pick = np.ones(len(forms), bool)
        if held is not None:
            table = held.value
            if not len(table):
                return None
            at = [np.minimum(np.searchsorted(table, k), len(table) - 1) for k in keys]
            pick = np.logical_or.reduce([table[a] == k for a, k in zip(at, keys)])
        at = np.flatnonzero(pick)
        form = np.array([xxhash.xxh64_intdigest(forms[i]) for i in at], np.uint64)
        form = mix64(form ^ mix64(sites[at]))
        return pa.RecordBatch.from_arrays([pa.array([page[i] for i in at], batch.schema.field(0).type), pa.array([number[i] for i in at], pa.int64()), _signed(sites[at]), _signed(form), *(_signed(k[at]) for k in keys)], ["page_id", "line_no", "site", "form", "b0", "b1"])

    kind = dict(base.dtypes)["page_id"]
    found = arrow_map(lines_of, lines, f"page_id {kind}, line_no bigint, site bigint, form bigint, b0 bigint, b1 bigint", text="content")
    if not small:
        keyed = found.select("page_id", "line_no", "site", "form", F.explode(F.array("b0", "b1")).alias("key"))
        found = keyed.join(hot.select("key"), "key", "left_semi").dropDuplicates(["page_id", "line_no"])
    found = found.select("page_id", "line_no", "site", "form")
    if exact:
        found = cut_lineage(found)  # read twice: for the counts and for the places
        own = found.select("site", "form", "page_id").groupBy("site", "form").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") >= min_pages)
        own = own.join(hot.groupBy("site").agg(F.first("pages").alias("pages")), "site").where(F.col("n") >= F.col("pages") * min_share)
        found = found.join(own.select("form"), "form", "left_semi")
    return found.select("page_id", "line_no").distinct()
