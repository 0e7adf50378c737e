"""Boilerplate: alignment of neighbours, structural lines, templates across hosts, and lines that stay."""

import random

from pagelake.llm.boilerplate import _increasing, blocks_of, chrome_lines, host_cuts, line_table, shape


def page(rng, i, host, extra=()):
    body = [" ".join(rng.choice("amber basil cedar dune ember fjord grove heath islet juniper kelp".split()) for _ in range(14)) + f" {i}x{k}." for k in range(6)]
    lines = ["Home | Docs | Blog | Sign in", "", f"Docs › Guides › Title {i}", "", f"# Title {rng.random()}", "", *body[:3], "", f"Share this with a friend · {i} shares so far", "", *body[3:], *extra, "", f"Tags: a{i}, b{i}", "", f"© 2026 {host.split('.')[0].title()} Team. All rights reserved.", "", f"← Older {i}"]
    chrome = {k for k, x in enumerate(lines, 1) if x.startswith(("Home", "Docs ›", "Share", "Tags", "©", "←"))}
    return "\n".join(lines), chrome


def test_lines_come_out(pages):
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(60):
        host = f"host{i % 6}.example"
        text, chrome = page(rng, i, host, extra=("", "```", "Home | Docs | Blog | Sign in", "x = 1", "```") if i % 5 == 0 else ())
        rows.append({"page_id": i, "url": f"https://{host}/p/{i}", "content_format": "markdown", "content": text})
        want |= {("page", i, n) for n in chrome if text.split("\n")[n - 1] != "x = 1"}
    rows += [{"page_id": 70, "url": "https://host9.example/z", "content_format": "text", "content": "Share this with a friend · 5 shares so far\n\nOnly words of its own."}, {"page_id": 71, "content": None}, {"page_id": 72, "content": ""}, {"page_id": 73, "content_format": "json", "content": '{"a": "Home | Docs | Blog"}'}, {"page_id": 74, "content_format": "text", "content": "z " * 100_000}]
    for limit in (1_000_000, 0):
        got = {tuple(r) for r in chrome_lines(pages(rows + rows[:3]), broadcast_keys=limit).collect()}
        assert got - {("page", 70, 1)} == want
        assert ("page", 70, 1) in got  # a template of other hosts holds for a host with a single page
    assert chrome_lines(pages(rows).limit(0)).count() == 0


def test_versions_of_one_text_keep_their_body(pages):
    rng = random.Random(9)
    text, chrome = page(rng, 1, "host.example")
    rows = [{"page_id": i, "url": f"https://host.example/{i}", "content_format": "markdown", "content": text.replace("Older 1", f"Older {i}")} for i in range(8)]
    got = {(r.record_id, r.line_no) for r in chrome_lines(pages(rows)).collect()}
    assert {n for _, n in got} <= chrome


def test_artifacts_and_html(spark, pages):
    html = '<html><body>\n<nav>\n<p>Menu item of some length</p>\n</nav>\n<h1>T</h1>\n<p>Body text that nobody shares at all.</p>\n<div class="c1">\n<p>Keep reading</p>\n<li><a href="/x">Other page</a></li>\n</div>\n</body></html>'
    artifacts = spark.createDataFrame([(5, "https://h.example/a", None, "# T\n\nOwn words.\n\n* [Other](/o)\n\nTags: x, y", "q")], "artifact_id bigint, url string, final_url string, content string, record string")
    got = {tuple(r) for r in chrome_lines(pages([{"page_id": 1, "url": "https://h.example/b", "content_format": "html", "content": html}]), artifacts).collect()}
    assert got == {("page", 1, 3), ("page", 1, 8), ("page", 1, 9), ("artifact", 5, 5), ("artifact", 5, 7)}


def test_increasing_and_table():
    assert _increasing([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5] and _increasing([]) == []
    numbers, keys, _, _, bits, _ = line_table("a\r\n\n<b></b>\n  \n***", "html", "")
    assert numbers == [1]


def test_large_hosts_are_cut_between_neighbours(spark, pages):
    # Each directory of three pages has a line of its own, which only neighbours by path can tell.
    rng = random.Random(11)
    words = "amber basil cedar dune ember fjord grove heath islet juniper kelp".split()
    rows, want = [], set()
    for i in range(2600):
        own = "".join(rng.choice("abcdefghij") for _ in range(12))
        notice = "".join(chr(97 + int(d)) for d in f"{i // 3:04d}")
        text = f"# {own}\n\n{own} {' '.join(rng.choice(words) for _ in range(9))} {own}.\n\nPlease mind the {notice} counter here."
        rows.append({"page_id": i, "url": f"https://big.example/d{i // 3:04d}/{i % 3}", "content_format": "markdown", "content": text})
        if i < 2598:
            want.add(("page", i, 5))
    rng.shuffle(rows)
    table = pages(rows + rows[:40])
    assert {tuple(r) for r in chrome_lines(table).collect()} == want
    assert {tuple(r) for r in chrome_lines(table, block_pages=40).collect()} == want

    keys = spark.createDataFrame([("h", f"/{i:03d}", "page", i) for i in range(100)] + [("h", "/007", "page", 7)], "site string, path string, record string, record_id bigint")
    cuts = host_cuts(keys, {"h": 101}, 34, 16)["h"]
    held = [[], [], []]
    for i in range(100):
        for block, own in blocks_of((f"/{i:03d}", "page", True, i), cuts):
            held[block].append((i, own))
    assert [[i for i, _ in b] for b in held] == [[*range(49)], [*range(17, 82)], [*range(50, 100)]]
    assert [[i for i, own in b if own] for b in held] == [[*range(33)], [*range(33, 66)], [*range(66, 100)]]


def test_names_and_messages_without_rules(spark, pages):
    """Breadcrumbs, previous and next, tags and link lists come out by alignment of their shapes; messages stay."""
    rng = random.Random(13)
    rows, want = [], set()
    for i in range(80):
        host = f"host{i % 5}.example"
        text, chrome = page(rng, i, host, extra=("", f"* [Other {rng.random()}](/o{i})", f"* [More {rng.random()}](/m{i})"))
        chrome |= {k for k, x in enumerate(text.split("\n"), 1) if x.startswith("* [")}
        rows.append({"page_id": i, "url": f"https://{host}/p/{i}", "content_format": "markdown", "content": text})
        want |= {("page", i, n) for n in chrome}
    for i in range(100, 112):
        rows.append({"page_id": i, "url": f"https://host{i % 5}.example/p/{i}", "content_format": "markdown", "content": f"Home | Docs | Blog | Sign in\n\nNobody lives in this house number {i} any more\n\nWhoever asks again gets the same answer."})
        want.add(("page", i, 1))
    for limit in (1_000_000, 0):
        assert {tuple(r) for r in chrome_lines(pages(rows), broadcast_keys=limit, structure=False).collect()} == want


def test_shapes():
    assert shape("Docs › Guides › A title", "", False) == "_ › _ › _" and shape("← Before this", "", False) == "← _" and shape("After that →", "", False) == "_ →"
    assert shape("* [A](/a)", "", False) == "* [_]" and shape('<li><a href="/x">A b</a></li>', "", True) == "[_]" and shape("Tags: a, b c, d", "", False) == "tags: _, _"
    assert shape("A | B | C | D | E", "", False) == shape("A | B | C", "", False) == "_ | _ | _" and shape("Acme · A title", "acme", False) == "@ · _"
    assert not any(shape(x, "", False) for x in ("See [x](/y) for more", "plain words", "the *|TITLE|* here", "We say: first, then.", "- a list item", "", "a → " + "word " * 20))
