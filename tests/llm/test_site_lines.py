"""Repeated lines against counting every form, on small pages and with clashing columns."""

import re
from collections import defaultdict

from pagelake.llm.site_lines import line_forms, repeated_lines

URL = "https://www.Docs.a.example:8080/p/{}?q#f"


def brute(rows, least=6, share=0.2):
    sites, where = defaultdict(set), defaultdict(set)
    for r in rows:
        if r.get("content") is None:
            continue
        host = re.match(r"[a-z]+://([^/:?#]*)", (r.get("final_url") or r.get("url") or "").lower())
        site = re.sub(r"^www\.", "", host.group(1)) if host else ""
        sites[site].add(r["page_id"])
        for k, line in enumerate(r["content"].split("\n"), 1):
            form = re.sub(r"<[^>]*>", "", line) if r.get("content_format") == "html" else line
            form = " ".join(re.sub("[0-9]", "", form).lower().split())
            if len(form) >= 15:
                where[site, form].add((r["page_id"], k))
    out = set()
    for (site, _), places in where.items():
        n = len({p for p, _ in places})
        if n >= least and n >= share * len(sites[site]):
            out |= places
    return out


def rows_of(count=40):
    rows = []
    for i in range(count):
        lines = [f"Unique body line number {chr(97 + i % 26)}{chr(97 + i // 26)} of this page, quite long", "Share  this with 12 friends " + str(i), "SHARE THIS WITH FRIENDS ", "short 1"]
        if i % 4 == 0:
            lines.append("Printed on 3 March 2020 by the archive team")
        rows.append({"page_id": i, "url": URL.format(i), "final_url": None if i % 3 else URL.format(i).lower(), "content_format": "html" if i % 2 else "text", "content": "\r\n".join(lines if i % 2 == 0 else [f"<p class='x{i}'>{x}</p>" for x in lines])})
    rows += [{"page_id": 900 + i, "url": None, "content": "Share this with friends everywhere"} for i in range(7)]
    rows += [{"page_id": 950, "content": None}, {"page_id": 951, "content": ""}, {"page_id": 952, "url": "no url", "content": "x" * 100_000}]
    return rows


def test_exact_forms(pages):
    rows = rows_of()
    want = brute(rows)
    assert len(want) > 60
    for limit in (1_000_000, 0):  # keys broadcast, and keys joined
        got = repeated_lines(pages(rows), exact=True, broadcast_keys=limit).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_clusters_take_in_small_variants(pages):
    rows = [{"page_id": i, "url": "https://b.example/" + str(i), "content": f"Your privacy matters to us at Bexample since {y} and we keep all of your data safe{'' if i % 2 else ' always'}"} for i, y in enumerate(range(2000, 2020))]
    got = {r.page_id for r in repeated_lines(pages(rows)).collect()}
    assert len(got) >= 10


def test_forms_and_empty_tables(pages):
    assert line_forms("<b>A</b> 12  b\r\n X y ", True) == ["a b", "x y"]
    assert repeated_lines(pages([{"page_id": 1, "content": None}]), exact=True).count() == 0
    one = [{"page_id": 1, "url": "https://c.example/", "content": "the same long line here"}] * 9
    assert repeated_lines(pages(one), exact=True).count() == 0  # one page, however often its row is repeated


def test_near_forms_of_repeated_rows(pages):
    """A page whose row comes several times, in whatever tasks, counts once."""
    rows = [{"page_id": i, "url": "https://a.example/", "content": "Read more about our letters"} for i in range(5)]
    assert repeated_lines(pages(rows * 4).repartition(4)).count() == 0
    rows.append({"page_id": 6, "url": "https://a.example/", "content": "Read more about our letters"})
    assert repeated_lines(pages(rows * 4).repartition(4)).count() == 6
