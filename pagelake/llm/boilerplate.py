"""Page boilerplate beside the main content (problem 3): differencing of nearest-URL pages.

1. Each page becomes a list of line keys (markup, digits and the site's own name masked)
   with a few structural bits; only these packed lists are shuffled, never the text.
2. Pages are grouped by host and sorted by URL path. Each page is aligned with its
   nearest neighbours in that order; the longest common subsequence of their lines gives
   a vote to every line in it. A neighbour that shares most of the page is another
   version of the same text and casts no vote. Hosts with more than a thousandth of all
   pages are cut into blocks of consecutive pages, so a host with a third of all rows is
   spread over hundreds of tasks; a task holds one window of pages, not a host. A block
   also gets the pages within the window on both sides, for their votes only, so that
   the votes are those of the uncut host.
3. Differencing says little on hosts with a handful of pages. Forms that win votes on
   several hosts in a good part of their occurrences are collected as templates and hold
   for all pages; so are the openings of lines (``Notice:``).
4. Lines that name other pages (breadcrumbs, previous and next, link lists, tags) are
   never equal. For these the names are masked: a line that consists of links, or of short
   parts between separators and arrows, is kept as its shape (``_ › _ › _``, ``← _``, ``tags: _, _``), and
   the shapes of two pages are aligned as the lines are. Shapes win or lose by the same
   counts of votes as lines do.
5. A line that is shared is still body if it stands mostly on pages that would be left with
   nothing but headings: the message or filler of a whole-page template.
6. Where there is nothing to align with, a host with one page in a small collection, the
   same kinds of lines are known by fixed rules of structure, and messages by a list
   (``structure=False`` leaves both out, to measure what the alignment does by itself).

Code, headings, table rows and whole-line error messages belong to the body; only lines
that match a template are taken out of code.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .common import arrow_map, need, path_of, site_of
from .residue import FILLER, MESSAGES

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--(?:(?!<!--).)*?-->")
_DIGITS = re.compile(r"\d+")
_LEAD = re.compile(r"^[\s#>*•·\-+]+")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_ONLY_LINKS = re.compile(r"^(?:[|·•\s]*!?\[[^\[\]\n]{1,40}\](?:\([^()\s]*\))?){2,}[|·•\s]*$")
_LINK_ITEM = re.compile(r"^\s*(?:[*+·•-]\s+)?\[[^\[\]]+\]\([^()\s]*\)\s*$")
_DOT_ITEM = re.compile(r"^\s*[·•»›]\s+\S")
_SPLIT = re.compile(r"\s[|·•]\s")
#: The word before the colon of a list of tags, in several languages.
TAGS = re.compile(r"^(?:tags?|tagged|keywords?|topics?|filed under|categor(?:y|ies)|schlagw(?:ort|örter)|themen|stichw(?:ort|örter)|mots[- ]clés|étiquettes|thèmes|etiquetas|temas|palabras clave|palavras-chave|argomenti|trefwoorden|taggar|tagi|теги|タグ)\s*[:：]", re.I)
_OPEN = re.compile(r"^(?:([★☆✱✦➤►!ⓘ※])\s|([^\s:：]+(?:\s[^\s:：]+){0,3})[:：]\s)")
_CONTAINER = re.compile(r"<(/?)(nav|footer|aside|header|noscript|div)\b([^<>]*)>", re.I)
_BODY_TAG = re.compile(r"<(?:h[1-6]|pre|table|blockquote|article|main)\b", re.I)
_HEADING = re.compile(r"<h[1-6]\b", re.I)

CODE, HEADING, ROW, STRONG, MESSAGE, SHORT, VOTED, TOUCHED, LONG, SHAPED = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512
_BODY = CODE | HEADING | ROW | MESSAGE


def _html_bits(lines: list[str]) -> list[int]:
    """Structural bits from containers, code and headings of an html text."""
    bits = [0] * len(lines)
    stack: list[tuple[str, int]] = []
    code = False
    for i, line in enumerate(lines):
        low = line.lower()
        if code or "<pre" in low or "<code" in low and "</code" not in low:
            bits[i] |= CODE
            code = not ("</pre" in low or "</code" in low and "<pre" not in low)
        if "<h" in low and _HEADING.search(line):
            bits[i] |= HEADING
        if "<td" in low or "<th" in low:
            bits[i] |= ROW
        if any(name in ("nav", "footer", "aside", "header", "noscript") for name, _ in stack):
            bits[i] |= STRONG
        for m in _CONTAINER.finditer(line):
            name = m.group(2).lower()
            if not m.group(1):
                stack.append((name, i))
                if name != "div":
                    bits[i] |= STRONG
            elif any(n == name for n, _ in stack):
                while stack:
                    n, at = stack.pop()
                    if n == name:
                        break
                if name == "div":
                    inner = lines[at : i + 1]
                    if not any(_BODY_TAG.search(x) for x in inner) and sum(len(_TAG.sub(" ", x).split()) for x in inner) <= 80:
                        for k in range(at, i + 1):
                            bits[k] |= STRONG
    return bits


def _text_bits(lines: list[str], kind: str | None) -> list[int]:
    bits = [0] * len(lines)
    fence = ""
    run: list[int] = []
    blank = True
    for i, line in enumerate([*lines, ""]):
        s = line.strip()
        if i < len(lines):
            if fence or s.startswith(("```", "~~~")):
                bits[i] |= CODE
                if not fence:
                    fence = s[:3]
                elif s.startswith(fence):
                    fence = ""
                blank = False
                continue
            if line.startswith(("    ", "\t")) and (blank or i and bits[i - 1] & CODE):
                bits[i] |= CODE
            elif s.startswith("#") and kind != "text":
                bits[i] |= HEADING
            elif s.startswith("|") or "\t" in s:
                bits[i] |= ROW
        # a run of four and more very short lines is a menu
        if s and not bits[i] if i < len(lines) else False:
            words = s.lstrip("*·•-»› ").split()
            if 0 < len(words) <= 3 and s[-1] not in ".!?:;,{}()" and s[0] not in "{}<\"'-":
                run.append(i)
                blank = False
                continue
        if len(run) >= 4:
            for k in run:
                bits[k] |= STRONG
        run = []
        blank = not s
    return bits


_LINKED = re.compile(r"!?\[[^\[\]]+\]\([^()\s]*\)|<a\b[^<>]*>[^<>]*</a\s*>", re.I)
_MARKS = re.compile(r"(?:^|(?<=\s))[|·•›»«‹→←](?=\s|$)")
_MARK = re.compile("[|·•›»«‹→←]")
_HINT = re.compile(r"[|·•›»«‹→←：]|\]\(|<a|:\s.*,")
_LISTED = re.compile(r"^(\S+(?:\s\S+){0,2})[:：]\s(\S.*)$")


def shape(line: str, label: str, is_html: bool) -> str:
    """``line`` with the names in it masked; '' if it isn't made of links or of short parts between marks."""
    if not _HINT.search(line):
        return ""
    linked = "](" in line or is_html and "<a" in line
    if not linked and (m := _LISTED.match(line if not is_html else " ".join(_TAG.sub(" ", line).split()))):
        parts = re.split("[,、，]", m.group(2))
        if len(parts) > 1 and line.rstrip()[-1:] not in ".!?" and all(len(p.split()) <= 4 for p in parts):
            return f"{m.group(1).lower()}: _, _"
    if not linked and not _MARK.search(line):
        return ""
    v = _LINKED.sub("\1", line)
    if is_html and "<" in v:
        v = html.unescape(_TAG.sub(" ", v))
    v = " ".join(v.split())
    out, at = [], 0
    for m in [*_MARKS.finditer(v), None]:
        part = v[at : m.start() if m else len(v)].strip()
        bullet, _, rest = part.partition(" ")
        if not out and bullet in ("*", "-", "+") and rest:
            out.append(bullet)
            part = rest
        if part and not part.replace("\1", "").strip():
            out.append("[_]")  # one link or several
        elif "\1" in part or part.count(" ") >= 15 or part[-1:] in (".", "!", "?"):
            return ""
        elif part:
            out.append("@" if label and part.lower() == label else "_")
        if m:
            out.append(m.group().strip())
            at = m.end()
    if len(out) == 1 and out != ["[_]"]:
        return ""
    form = " ".join(out)
    while "_ | _ | _ | _" in form or "_ · _ · _ · _" in form:  # menus of any length
        form = form.replace("_ | _ | _ | _", "_ | _ | _").replace("_ · _ · _ · _", "_ · _ · _")
    return form


def line_table(content: str, kind: str | None, label: str, lists: bool = True) -> tuple[list[int], list[int], list[int], list[tuple[int, int]], list[int], list[int]]:
    """(numbers, keys, opening keys, keys joined with the next lines, bits, keys of shapes) of the lines with visible text."""
    lines = content.replace("\r\n", "\n").split("\n")
    is_html = kind == "html"
    bits = _html_bits(lines) if is_html else _text_bits(lines, kind)
    wrap = kind in ("text", None)
    # the list of messages is for pages without running text
    lists = lists and sum(n for n in (line.count(" ") + 1 for line in lines) if n > 12) < 150
    numbers, keys, opens, joined, out, forms, shapes = [], [], [], [], [], [], []
    hashed = xxhash.xxh64_intdigest
    for i, line in enumerate(lines):
        v = line
        if "<" in v and is_html:
            v = _TAG.sub(" ", v)
        if "&" in v and is_html:
            v = html.unescape(v)
        v = " ".join(v.split())
        if not v or not any(map(str.isalnum, v)) and not bits[i] & CODE:
            if not v or is_html or not bits[i] & CODE:
                forms.append("")
                continue
        b = bits[i]
        shown = _LINK.sub(r"\1", v) if "](" in v else v
        low = shown.lower()
        bare = _LEAD.sub("", low)
        if label and label in bare:
            bare = bare.replace(label, "@")
        form = _DIGITS.sub("0", bare)
        forms.append(form)
        if not b & CODE:
            n = low.count(" ") + 1
            if lists and n <= 20 and (MESSAGES.search(bare) or FILLER.match(bare)):
                # a notice about scripts is a message only without a real body; others are messages anywhere
                b |= MESSAGE
            if n <= 5 and v[-1] not in ".!?":
                b |= SHORT
            if n >= 20:
                b |= LONG
            first, last = v[0], v[-1]
            if not b & (HEADING | ROW) and n <= 30:
                parts = _SPLIT.split(v)
                if (
                    " › " in v or " » " in v or first in "←‹›»" or last in "→›»"
                    or TAGS.match(bare) or low.startswith("©") or _ONLY_LINKS.match(line)
                    or _LINK_ITEM.match(line) or (_DOT_ITEM.match(line) and last not in ".!?")
                    or (len(parts) >= 3 and all(len(p.split()) <= 4 for p in parts) and last not in ".?!")
                    or (len(parts) == 2 and (label and label in parts[0].lower() and len(parts[0].split()) == 1 or all(len(p.split()) <= 2 for p in parts)))
                ):
                    b |= STRONG
        numbers.append(i + 1)
        keys.append(hashed(bare if b & HEADING else form))  # numbers tell headings apart
        m = _OPEN.match(bare) if not b & (_BODY & ~CODE) else None
        opens.append(hashed(f"open\0{m.group(1) or m.group(2)}") if m else 0)
        out.append(b)
        masked = "" if b & _BODY else shape(line, label, is_html)
        shapes.append(hashed(f"shape\0{masked}") if masked else 0)
    if wrap:
        at = {n: k for k, n in enumerate(numbers)}
        for k, n in enumerate(numbers):
            two = three = 0
            if len(forms[n - 1]) >= 30 and n in (numbers[k + 1] - 1 if k + 1 < len(numbers) else -1,):
                pair = f"{forms[n - 1]} {forms[n]}"
                two = hashed(pair)
                if n + 2 in at:
                    three = hashed(f"{pair} {forms[n + 1]}")
            joined.append((two, three))
    else:
        joined = [(0, 0)] * len(numbers)
    return numbers, keys, opens, joined, out, shapes


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class _Page:
    __slots__ = ("heads", "long", "own", "peers", "place", "row", "shaped", "shapes", "size", "votes")

    def __init__(self, row: tuple, keys: np.ndarray, bits: np.ndarray, shapes: np.ndarray, own: bool = True):
        self.row, self.own = row, own
        self.shapes, self.shaped = {}, set()
        for i, k in enumerate(shapes.tolist()):
            if k:
                self.shapes.setdefault(k, i)
        self.place = {}
        for i, k in enumerate(keys.tolist()):
            if not bits[i] & _BODY:
                self.place.setdefault(k, i)
        self.long = set(keys[(bits & LONG) > 0].tolist())
        self.heads = set(keys[(bits & HEADING) > 0].tolist())
        self.size, self.votes, self.peers = len(keys), np.zeros(len(keys), np.int32), 0


def difference(a: _Page, b: _Page, version: float = 0.6) -> None:
    """A vote for each line in the longest common subsequence of both pages, unless they are versions of one text."""
    common = a.place.keys() & b.place.keys()
    share = len(common) / max(a.size, b.size, 5)
    if share > version or share > version / 2 and a.heads & b.heads or len(a.long & b.long) > 2:
        return
    a.peers += 1
    b.peers += 1
    for j, i in _aligned(a.place, b.place, common):
        b.votes[j] += 1
        a.votes[i] += 1
    masked = a.shapes.keys() & b.shapes.keys()
    if masked - a.shaped or masked - b.shaped:
        kept = {j for j, _ in _aligned(a.shapes, b.shapes, masked)}
        masked = {k for k in masked if b.shapes[k] in kept}
        a.shaped |= masked
        b.shaped |= masked


def _aligned(a: dict[int, int], b: dict[int, int], common: set[int]) -> list[tuple[int, int]]:
    """Places in both of a longest common subsequence, from the places of the keys that both hold."""
    pairs = sorted((b[k], a[k]) for k in common)
    left = [x for _, x in pairs]
    if any(x > y for x, y in zip(left, left[1:])):
        pairs = [pairs[i] for i in _increasing(left)]
    return pairs


def _order(path: str, record: str, rid: int | None) -> tuple:
    """The order of pages within a host as Spark sorts them: strings by code point, nulls first."""
    return path, record, rid is not None, rid or 0


def host_cuts(rows: DataFrame, sizes: dict[str, int], limit: int, window: int) -> dict[str, tuple[list[tuple], list[tuple], list[tuple]]]:
    """Where the hosts of ``sizes`` are cut into blocks of about ``limit`` consecutive pages.

    For each host three lists with an entry for each cut: the first page behind it, the
    first page within ``window`` pages before it, and the first page beyond ``window`` pages
    behind it (none if the host ends earlier). ``limit`` is at least ``window``. The pages
    are ranked exactly by a distributed sort of their keys; only the places around the
    cuts come to the driver, about three for each block.
    """
    columns = ("site", "path", "record", "record_id")
    ranked = cut_lineage(rows.where(F.col("site").isin(*sizes)).select(*columns).distinct().orderBy(*columns))
    parts = ranked.groupBy(F.spark_partition_id().alias("part"), "site").count().orderBy("part").collect()
    pages: dict[str, int] = {}
    before: dict[tuple[int, str], int] = {}
    for part, site, n in parts:
        before[part, site] = pages.get(site, 0)
        pages[site] = before[part, site] + n
    wanted: dict[str, dict[int, list[tuple[int, int]]]] = {}
    for site, n in pages.items():
        blocks = -(-n // limit)
        for cut in range(1, blocks):
            at = cut * n // blocks
            for kind, rank in enumerate((at, at - window, at + window)):
                wanted.setdefault(site, {}).setdefault(max(0, rank), []).append((cut - 1, kind))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rank = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            got, ranks = [], []
            for i, site in enumerate(batch.column(0).to_pylist()):
                if site != last:
                    last, rank = site, before[part, site]
                if rank in wanted.get(site, ()):
                    got.append(i)
                    ranks.append(rank)
                rank += 1
            if got:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(got)).columns, pa.array(ranks, pa.int64())], [*columns, "rank"])

    cuts = {site: tuple([None] * len({cut for places in ranks.values() for cut, _ in places}) for _ in range(3)) for site, ranks in wanted.items()}
    for site, path, record, rid, rank in ranked.mapInArrow(pick, "site string, path string, record string, record_id bigint, rank bigint").collect():
        for cut, kind in wanted[site][rank]:
            cuts[site][kind][cut] = _order(path, record, rid)
    return cuts


def blocks_of(page: tuple, cuts: tuple[list[tuple], list[tuple], list[tuple]]) -> list[tuple[int, bool]]:
    """The blocks that hold a page, and whether it is one of the block's own or lent for its votes."""
    starts, lows, highs = cuts
    k = bisect_right(starts, page)
    out = [(k, True)]
    if k < len(starts) and page >= lows[k]:
        out.append((k + 1, False))
    if k and (highs[k - 1] is None or page < highs[k - 1]):
        out.append((k - 1, False))
    return out


def chrome_lines(pages: DataFrame, artifacts: DataFrame | None = None, window: int = 16, min_sites: int = 3, min_ratio: float = 0.3, broadcast_keys: int = 1_000_000, block_pages: int = 2000, structure: bool = True) -> DataFrame:
    """``(record, record_id, line_no)`` of the lines that aren't part of the main body.

    ``record`` is ``page`` or ``artifact``. Null contents and json pages have no such
    lines. Lines are numbered from 1, blank lines counted. Rows repeated under one id
    are taken once; further columns are ignored; empty tables give no rows. Hosts of more
    than ``block_pages`` pages and a thousandth of all are cut; it doesn't change the result.
    """
    spark = pages.sparkSession
    base = need(pages, "page_id", "final_url", "url", "content_format", "content").select(F.lit("page").alias("record"), F.col("page_id").alias("record_id"), "final_url", "url", "content_format", "content")
    if artifacts is not None:
        base = base.unionByName(need(artifacts, "artifact_id", "final_url", "url", "content").select(F.lit("artifact").alias("record"), F.col("artifact_id").alias("record_id"), "final_url", "url", F.lit("markdown").alias("content_format"), "content"))
    base = base.where("length(content) > 0 and coalesce(content_format, '') <> 'json'")
    site, path = site_of(F.col("final_url"), F.col("url")), path_of(F.col("final_url"), F.col("url"))

    # At most a thousand hosts hold more than a thousandth of all pages each.
    hosts = cut_lineage(base.groupBy(site.alias("site")).count())
    total = hosts.agg(F.sum("count")).first()[0] or 0
    limit = max(block_pages, total // 1000, 2 * window)
    sizes = {r[0]: r[1] for r in hosts.where(F.col("count") > limit).collect()}
    rows = base.select("record", "record_id", site.alias("site"), path.alias("path"), "content_format", "content")
    cuts = host_cuts(rows, sizes, limit, window) if sizes else {}

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        at, blocks, owns = [], [], []
        for i, (record, rid, s, p, kind, content) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)))):
            labels = s.split(".")
            label = labels[-2] if len(labels) > 1 else ""
            numbers, keys, opens, joined, bits, shapes = line_table(content, kind, label if len(label) > 3 else "", structure)
            for column, (values, kind_) in zip(cols, ((numbers, np.int32), (keys, np.uint64), (opens, np.uint64), (shapes, np.uint64), ([j for j, _ in joined], np.uint64), ([j for _, j in joined], np.uint64), (bits, np.uint16))):
                column.append(np.array(values, kind_).tobytes())
            for block, own in blocks_of(_order(p, record, rid), cuts[s]) if s in cuts else ((0, True),):
                at.append(i)
                blocks.append(block)
                owns.append(own)
        held = pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.binary()) for c in cols)], names).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*held.columns[:4], pa.array(blocks, pa.int32()), pa.array(owns, pa.bool_()), *held.columns[4:]], [*names[:4], "block", "own", *names[4:]])

    names = ["record", "record_id", "site", "path", "numbers", "keys", "opens", "shapes", "two", "three", "bits"]
    packed_schema = "record string, record_id bigint, site string, path string, block int, own boolean, numbers binary, keys binary, opens binary, shapes binary, two binary, three binary, bits binary"
    packed = arrow_map(spread(rows), pack, packed_schema, text="content")

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "record_id", "site", "numbers", "keys", "opens", "shapes", "two", "three", "bits"]
        done: list[tuple] = []

        def finish(page: _Page) -> None:
            if not page.own:
                return
            row, bits = page.row, np.frombuffer(page.row[-1], np.uint16).copy()
            need_ = 2 if page.peers >= 8 else 1
            bits[page.votes >= 1] |= TOUCHED
            bits[page.votes >= need_] |= VOTED
            if page.shaped:
                bits[np.isin(np.frombuffer(row[6], np.uint64), np.fromiter(page.shaped, np.uint64, len(page.shaped)))] |= SHAPED
            done.append((*row[:-1], bits.tobytes()))

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string()] + [pa.binary()] * 7
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
            done.clear()
            return batch

        near: deque[_Page] = deque()
        group, last = None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(13))):
                record, rid, site_, _, block, own, numbers, keys, opens, shapes, two, three, bits = row
                if (site_, block) != group:
                    for page in near:
                        finish(page)
                    near.clear()
                    group, last = (site_, block), None
                if last == (record, rid):  # a repeated row
                    continue
                last = (record, rid)
                page = _Page((record, rid, site_, numbers, keys, opens, shapes, two, three, bits), np.frombuffer(keys, np.uint64), np.frombuffer(bits, np.uint16), np.frombuffer(shapes, np.uint64), own)
                for other in near:
                    if own or other.own:
                        difference(other, page)
                near.append(page)
                if len(near) > window:
                    finish(near.popleft())
                if len(done) >= 2000:
                    yield out()
        for page in near:
            finish(page)
        if done:
            yield out()

    aligned_schema = "record string, record_id bigint, site string, numbers binary, keys binary, opens binary, shapes binary, two binary, three binary, bits binary"
    ordered = packed.repartition("site", "block").sortWithinPartitions("site", "block", "path", "record", "record_id")
    table = cut_lineage(ordered.mapInArrow(align, aligned_schema))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, touched, site_bits = [], [], []
        for s, k, o, m, b in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5, 6, 9))):
            bits = np.frombuffer(b, np.uint16)
            open_ = (bits & _BODY) == 0
            t = (bits & TOUCHED) > 0
            opens, shapes = np.frombuffer(o, np.uint64), np.frombuffer(m, np.uint64)
            use, masked = open_ & (opens > 0), shapes > 0
            # once a page
            k, first = np.unique(np.concatenate((np.frombuffer(k, np.uint64)[open_], opens[use], shapes[masked])), return_index=True)
            keys.append(k)
            touched.append(np.concatenate((t[open_], t[use], (bits[masked] & SHAPED) > 0))[first])
            site_bits.append(np.full(len(k), 1 << (xxhash.xxh32_intdigest(s) % 63), np.int64))
        key = np.concatenate(keys)
        if not len(key):
            return None
        order = np.argsort(key, kind="stable")
        key, t, s = key[order], np.concatenate(touched)[order], np.concatenate(site_bits)[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(np.add.reduceat(t.astype(np.int64), at)), pa.array(np.diff(np.append(at, len(key)))), pa.array(np.bitwise_or.reduceat(s, at))], ["key", "touched", "n", "sites"])

    stats = arrow_map(table, count, "key bigint, touched bigint, n bigint, sites bigint").groupBy("key").agg(F.sum("touched").alias("touched"), F.sum("n").alias("n"), F.expr("bit_count(bit_or(sites))").alias("sites"))
    common = (F.col("sites") >= min_sites) & (F.col("touched") >= 2) & (F.col("touched") >= F.col("n") * min_ratio)
    # A notice of one host that few of its pages carry: rarely within a page's window, but touched far above chance.
    local = (F.col("sites") < min_sites) & (F.col("n") >= 8) & (F.col("touched") >= F.col("n") * 0.12)
    templates = stats.where(common | local).select("key")
    templates = cut_lineage(templates)
    size = templates.count()
    kinds = dict(base.dtypes)["record_id"]
    if size <= broadcast_keys:
        held = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in templates.collect()), np.int64, size).view(np.uint64)))
    else:
        held = None

    def known(keys: np.ndarray) -> np.ndarray:
        if held is None or not len(held.value):
            return np.zeros(len(keys), bool)
        return held.value[np.minimum(np.searchsorted(held.value, keys), len(held.value) - 1)] == keys

    def chrome_of(k: bytes, o: bytes, m: bytes, two: bytes, three: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines that aren't body, keys of the lines, bits) of a page."""
        bits, k = np.frombuffer(b, np.uint16), np.frombuffer(k, np.uint64)
        o, m = np.frombuffer(o, np.uint64), np.frombuffer(m, np.uint64)
        named = known(k) | (o > 0) & known(o) | (m > 0) & known(m)
        chrome = named | ((bits & (STRONG | VOTED if structure else VOTED)) > 0)
        for j, size_ in ((np.frombuffer(two, np.uint64), 2), (np.frombuffer(three, np.uint64), 3)):
            for at in np.flatnonzero((j > 0) & known(j)):
                chrome[at : at + size_] = True
        # a template line that was put into the middle of a code block is no code
        return chrome & ((bits & _BODY) == 0) | named & ((bits & _BODY) == CODE), k, bits

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """How many pages have a line, once each, and how many of them would keep nothing but headings."""
        keys, bare = [], []
        for packed_ in zip(*(batch.column(i).to_pylist() for i in range(4, 10))):
            chrome, k, bits = chrome_of(*packed_)
            keys.append(np.unique(k[chrome]))
            bare.append(np.full(len(keys[-1]), bool((chrome | ((bits & HEADING) > 0)).all())))
        key = np.concatenate(keys)
        if not len(key):
            return None
        order = np.argsort(key, kind="stable")
        key, b = key[order], np.concatenate(bare)[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(b.astype(np.int64), at))], ["key", "n", "bare"])

    whole = (F.col("n") >= 6) & (F.col("bare") >= 0.4 * F.col("n"))

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, numbers = [], [], []
        for record, rid, no, *packed_ in zip(*(batch.column(i).to_pylist() for i in (0, 1, *range(3, 10)))):
            chrome, k, _ = chrome_of(*packed_)
            if body_keys is not None and len(body_keys.value):
                held_ = body_keys.value
                chrome &= held_[np.minimum(np.searchsorted(held_, k), len(held_) - 1)] != k
            got = np.frombuffer(no, np.int32)[chrome]
            names += [record] * len(got)
            ids += [rid] * len(got)
            numbers.append(got)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(np.concatenate(numbers).astype(np.int64))], ["record", "record_id", "line_no"])

    body_keys = None
    schema = f"record string, record_id {kinds}, line_no bigint"
    if held is not None:
        messages = cut_lineage(arrow_map(table, alone, "key bigint, n bigint, bare bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare")).where(whole).select("key"))
        size = messages.count()
        if size <= broadcast_keys:
            body_keys = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in messages.collect()), np.int64, size).view(np.uint64)))
            return arrow_map(table, decide, schema)

    def visible(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, numbers = [], [], []
        for record, rid, no, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 9))):
            got = np.frombuffer(no, np.int32)[(np.frombuffer(b, np.uint16) & HEADING) == 0]
            names += [record] * len(got)
            ids += [rid] * len(got)
            numbers.append(got)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(np.concatenate(numbers).astype(np.int64))], ["record", "record_id", "line_no"])

    # More templates than may be broadcast: the keys of each line are joined with them.
    def line_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, ids, starts, sizes_, keys = [], [], [], [], []
        for record, rid, no, k, o, m, two, three, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, *range(3, 10)))):
            bits, no = np.frombuffer(b, np.uint16), np.frombuffer(no, np.int32)
            free = (bits & _BODY) == 0
            for part, width in ((k, 0), (k, 1), (o, 1), (m, 1), (two, 2), (three, 3)):  # 0: the line's own key once more
                part = np.frombuffer(part, np.uint64)
                at = np.flatnonzero((free | ((bits & _BODY) == CODE) & (width < 2)) & (part > 0))
                names += [record] * len(at)
                ids += [rid] * len(at)
                starts.append(no[at])
                sizes_.append(np.full(len(at), width))
                keys.append(part[at])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes_).astype(np.int64)), pa.array(np.concatenate(keys).view(np.int64))], ["record", "record_id", "line_no", "width", "key"])

    lines = arrow_map(table, line_keys, "record string, record_id bigint, line_no bigint, width bigint, key bigint")
    place = ["record", "record_id", "line_no"]
    hit = lines.where("width > 0").join(templates, "key", "left_semi").select("record", "record_id", F.explode(F.sequence("line_no", F.expr("line_no + width - 1"))).alias("line_no"))
    free = lines.where("width = 1")
    found = cut_lineage(arrow_map(table, decide, schema).unionByName(hit.join(free.select(*place).distinct(), place, "left_semi")).distinct())
    # The same count of pages that would keep nothing but headings.
    kept = arrow_map(table, visible, schema).join(found, place, "left_anti").select("record", "record_id").distinct()
    named = lines.where("width = 0").join(found, place, "left_semi")
    alone_ = named.join(kept.withColumn("keeps", F.lit(1)), ["record", "record_id"], "left").groupBy("key").agg(F.count_distinct("record", "record_id").alias("n"), F.count_distinct(F.when(F.col("keeps").isNull(), F.struct("record", "record_id"))).alias("bare"))
    wrong = named.join(alone_.where(whole).select("key"), "key", "left_semi").select(*place)
    return found.join(wrong, place, "left_anti")
