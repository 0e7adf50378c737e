"""Operators on small tables, with expected rows worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions.urls import fnv1a64, fnv1a64_many
from pagelake.operators import actions, artifacts, batch, cache, crawl, doctor, fields, links, pages, privacy, search, sessions
from pagelake.operators.running import running_before
from pagelake.page import Options, Page
from pagelake.plans import queries
from pagelake.sources import readers, sinks


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_get_limits_usage_and_envelope(spark):
    df = spark.createDataFrame([(1, "https://a.example/x", "<title>T</title><main><h1>Head</h1><p>Body é</p></main>", "q"), (2, "https://a.example/y", None, "q"), (3, None, "", "q")], "page_id bigint, url string, html string, content string")
    out = pages.with_usage(pages.get(df, Options(max_chars=6), keep=("page_id",)))
    got = {r.page_id: r for r in out.collect()}
    assert got[1].ok and got[1].content == "# Head" and got[1].limits.truncated and got[1].limits.chars_before == 14 and got[1].usage.estimated_tokens == 2 and got[1].page_metadata["title"] == "T"
    assert not got[2].ok and got[2].error.code == "extraction_failed" and got[2].content is None
    assert got[3].ok and got[3].content == ""
    fake = pages.get(df, extractor=lambda u, h, o: Page(content="fixed"), keep=("page_id",))
    assert {r.content for r in fake.collect()} == {"fixed"}
    assert pages.get(df.limit(0), keep=("page_id",)).count() == 0
    enveloped = pages.envelope(spark.createDataFrame([("u", True, "c"), ("v", False, "d")], "url string, sensitive boolean, content string"), "get", ["url", "content"])
    data = [json.loads(r.envelope)["data"] for r in enveloped.orderBy("url").collect()]
    assert data == [{"url": "u"}, {"url": "v", "content": "d"}]
    with pytest.raises(ValueError):
        pages.envelope(enveloped, "get", ["url"], inline="x")


PAGE = '<p><a href="/docs/a#x">First</a><a href="/docs/a">Again</a><a href="b.pdf">Pdf</a><a href="https://o.example/docs/z">Out</a><a href="mailto:x@y">m</a><a href="#t">t</a><a href="/other" aria-label="Label"></a><a href="/docs/c?q=1">C</a></p>'


def test_links(spark):
    df = spark.createDataFrame([(1, "https://a.example/docs/index", PAGE), (2, "https://b.example/", None), (3, "https://c.example/", "<p>none</p>")], "page_id bigint, url string, html string")
    got = rows(links.map_links(df), "url", "text", "content_type")
    assert got == [("https://a.example/docs/a", "First", "text/html"), ("https://a.example/docs/b.pdf", "Pdf", "application/pdf"), ("https://a.example/docs/c?q=1", "C", "text/html")]
    assert len(rows(links.map_links(df, any_path=True))) == 4 and len(rows(links.map_links(df, any_path=True, any_origin=True))) == 5
    assert [r[0] for r in rows(links.map_links(df, any_path=True), "text")].count("Label") == 1
    assert rows(links.map_links(df, include=("*.pdf",)), "text") == [("Pdf",)] and rows(links.map_links(df, exclude=("docs/a", "q=")), "text") == [("Pdf",)]
    assert rows(links.map_links(df, content_types=("application/pdf",)), "text") == [("Pdf",)]
    assert rows(links.map_links(df, max_links=2), "text") == [("First",), ("Pdf",)]  # the cap counts in document order
    assert rows(links.map_summary(df, max_links=2)) == [(1, 3, 2, True), (2, 0, 0, False), (3, 0, 0, False)]
    assert rows(links.map_summary(df))[0] == (1, 6, 3, False)
    report = sinks.links_markdown(links.map_links(df, max_links=2), "page_id").first().report
    assert report == "- [First](https://a.example/docs/a)\n- [Pdf](https://a.example/docs/b.pdf)"
    with pytest.raises(ValueError):
        links.map_links(df, max_links=0)


def test_search(spark):
    text = "Intro line.\n# Install\nRun cargo install now.\n- cargo | list\n## Other\nnothing\n  ### Cargo install\nmore cargo\n####### no heading\n"
    df = spark.createDataFrame([(1, text, False), (2, None, False), (3, "", False), (4, "cargo install", True)], "page_id bigint, content string, sensitive boolean")
    secs = [tuple(r) for r in search.sections(df, keep=("page_id",)).orderBy("page_id", "char_start").collect() if r.page_id == 1]
    assert [(s[1], s[2]) for s in secs] == [("section-1", "Document"), ("section-2", "Install"), ("section-3", "Other"), ("section-4", "### Cargo install")]
    assert "".join(s[3] for s in secs) == text and [text[s[4] : s[5]] for s in secs] == [s[3] for s in secs]
    best = search.search(df, "Cargo install", context_chars=20, sensitive="sensitive").orderBy("rank").collect()
    assert [(r.page_id, r.section_id, r.score) for r in best] == [(1, "section-4", 120 + 60 + 30 + 30 + 12 + 6), (1, "section-2", 60 + 30 + 12 + 12 + 4)]
    assert best[0].snippet.startswith("### Cargo inst") and best[1].snippet == "# Install Ru..."
    assert search.search(df, "Cargo", sensitive="sensitive", allow_private=True).where("page_id = 4").count() == 1
    assert search.query_terms("a Cargo-Install, cargo 7x") == ["7x", "cargo", "install"]
    for bad in ((" ", 1, 10), ("x", 0, 10), ("x", 51, 10), ("x", 1, 0), ("x", 1, 2001)):
        with pytest.raises(ValueError):
            search.search(df, *bad)


MARKDOWN = "# A\n  ## B  \nterm: what it is\nhttp://x: no\n| h | i |\n| - | :-: |\n| 1 | 2 |\n|3|\n\n![no](i.png) [L](/p) [ ](/q) [M]( r ) [open](\n"
HTML = '<html><body><h2>H <b>x</b></h2><table><tr><th>a<th>a</tr><tr><td>1<td>2<td>3</tr></table><table><tr><td>z</table><dl><dt>t<dd>d<dt>u</dl><a href=" /k ">K</a><a href="javascript:1">J</a><p class=p data-v=1>one</p><p class=p>two</p></body></html>'


def test_fields(spark):
    df = spark.createDataFrame([(1, "https://a.example/d/", None, False, MARKDOWN, "markdown", '{"site": "S", "n": {"a/b": [1, 2]}}'), (2, "https://a.example/d/", None, True, HTML, "html", None), (3, "u", None, False, '{"plan": "pro", "nested": {"seats": [5]}}', "json", "broken"), (4, "u", None, False, None, "text", None)], "page_id bigint, url string, final_url string, sensitive boolean, content string, content_format string, metadata string")
    every = fields.extract_fields(df, fields.shortcut("headings", "links", "tables", "definitions", "metadata"))
    got = {r.page_id: json.loads(r.values_json) if r.ok else r.error for r in every.collect()}
    assert got[1]["headings"] == [{"level": 1, "text": "A"}, {"level": 2, "text": "B"}]
    assert got[1]["links"] == [{"text": "L", "url": "https://a.example/p"}, {"text": "M", "url": "https://a.example/d/r"}]
    assert got[1]["tables"] == [{"headers": ["h", "i"], "rows": [{"h": "1", "i": "2"}]}]
    assert {"term": "term", "definition": "what it is"} in got[1]["definitions"] and got[1]["metadata"]["site"] == "S"
    assert got[2]["headings"] == [{"level": 2, "text": "H x"}] and got[2]["links"] == [{"text": "K", "url": "https://a.example/k"}, {"text": "J", "url": ""}]
    assert got[2]["tables"] == [{"headers": ["a", "a"], "rows": [{"a": "2"}]}, {"headers": ["column_1"], "rows": [{"column_1": "z"}]}]
    assert got[2]["definitions"] == [{"term": "t", "definition": "d"}] and got[3]["metadata"] is None and got[4] == "no content"
    chosen = fields.extract_fields(df, [fields.Field("x", "selector", "p.p", "attr:data-v"), fields.Field("all", "selector", ".p", multiple=True), fields.Field("h", "selector", "h2", "html"), fields.Field("no", "selector", "em")])
    got = {r.page_id: r for r in chosen.collect()}
    assert json.loads(got[2].values_json) == {"x": "1", "all": ["one", "two"], "h": "H <b>x</b>", "no": None} and not got[1].ok and len(got[2].provenance) == 4
    some = fields.extract_fields(df, [fields.Field("s", "json", path="$.nested.seats.0"), fields.Field("m", "metadata", path="n.a/b")])
    got = {r.page_id: r for r in some.collect()}
    assert json.loads(got[3].values_json) == {"s": 5, "m": None} and not got[1].ok
    only = fields.extract_fields(df, [fields.Field("m", "metadata", path="/n/a~1b/1")])
    assert json.loads({r.page_id: r for r in only.collect()}[1].values_json) == {"m": 2}
    assert rows(fields.extract_summary(every, fields.shortcut("headings"))) == [(4, 1, 1, 1)]
    assert [f.name for f in fields.read_schema('{"fields": [{"name": "a", "type": "links", "more": 1}]}')] == ["a"]
    for bad in ("{}", "[]", '{"fields": []}', '{"fields": [{"name": "a", "type": "x"}]}', '{"fields": [{"name": "a", "type": "json"}]}', '{"fields": [{"name": "a", "type": "selector"}]}', '{"fields": [{"name": "a", "type": "selector", "selector": "["}]}'):
        with pytest.raises(fields.FieldError):
            fields.read_schema(bad)


def test_batch(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" https://a.example \n\n# c\nhttps://b.example\nhttps://a.example\nhttps://c.example\nhttps://d.example\nftp://x\n")
    urls = readers.url_list(spark, str(tmp_path / "urls.txt"))
    assert rows(batch.unsupported(urls), "url") == [("ftp://x",)]
    items = batch.dedupe(urls)
    assert rows(items.where("status = 'skipped'"), "index", "reason") == [(2, "duplicate")]
    done = batch.fail_fast(items, F.col("url") == "https://b.example", 2)
    assert [(r["index"], r.status, r.reason) for r in done.orderBy("index").collect()] == [(0, "ok", None), (1, "failed", None), (2, "skipped", "duplicate"), (3, "skipped", "fail_fast"), (4, "skipped", "fail_fast"), (5, "skipped", "fail_fast")]
    assert rows(batch.summary(done)) == [(6, 1, 1, 4, False)]
    report = batch.manifest_parts(done.withColumn("run", F.lit(1)), "run").first()
    assert json.loads(report.manifest_json)["summary"]["requested"] == 6 and report.manifest_md.startswith("- ok `https://a.example`\n- failed `https://b.example`")
    assert (report.part, report.parts, report["items"]) == (1, 1, 6)
    lines = batch.manifest_lines(done.withColumn("run", F.lit(1)), "run").orderBy("index").collect()
    assert "\n".join(r.item_md for r in lines) == report.manifest_md
    with pytest.raises(ValueError):
        batch.fail_fast(items, F.lit(False), 9)


def test_manifest_of_long_runs(spark, tmp_path):
    mixed = spark.createDataFrame([(r, i, f"https://a.example/\"é\"/{i}", "skipped" if i % 3 else "ok", "duplicate" if i % 3 else None) for r, n in ((1, 7), (2, 3), (3, 1), (None, 6)) for i in range(0, 9 * n, 9)], "run bigint, index bigint, url string, status string, reason string")
    whole = {r.run: r for r in batch.manifest_parts(mixed.fillna({"run": 9}), "run", max_items=100).collect()}
    parts = batch.manifest_parts(mixed, "run", max_items=3).orderBy("run", "part").collect()
    assert [(r.run, r.part, r.parts, r["items"]) for r in parts] == [(None, 1, 2, 6), (None, 2, 2, 6), (1, 1, 3, 7), (1, 2, 3, 7), (1, 3, 3, 7), (2, 1, 1, 3), (3, 1, 1, 1)]
    for run in (None, 1, 2, 3):
        for c in ("manifest_json", "manifest_md"):
            assert "".join(r[c] for r in parts if r.run == run) == whole[run or 9][c]

    items = spark.range(25_000).select(F.lit(4).cast("bigint").alias("batch_id"), F.col("id").alias("item_index"), F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"))
    items.write.parquet(str(tmp_path / "batch_items.parquet"))
    got = queries.batch_manifest(spark, str(tmp_path)).collect()
    assert got and all(r.manifest_json is not None and r.manifest_md is not None for r in got)
    got.sort(key=lambda r: r.part)
    assert [i["index"] for i in json.loads("".join(r.manifest_json for r in got))["items"]] == [*range(25_000)]
    assert "".join(r.manifest_md for r in got).count("\n") == 24_999


def test_crawl(spark):
    home = "https://a.example/docs/"
    graph = {"": ["x", "y", "x#f", "https://o.example/"], "x": ["", "z"], "y": ["z", "gone"], "z": ["deep"]}
    table = spark.createDataFrame([(home + s, i, t if "://" in t else home + t) for s, ts in graph.items() for i, t in enumerate(ts)], "source_url string, pos bigint, url string")
    known = spark.createDataFrame([(home + s, None) for s in ("", "x", "y", "z", "deep")], "url string, final_url string")
    got = [(r.url.removeprefix(home), r.depth, r.status) for r in crawl.crawl(known, table, home, 10).orderBy("index").collect()]
    assert got == [("", 0, "ok"), ("x", 1, "ok"), ("y", 1, "ok"), ("z", 2, "ok"), ("gone", 2, "failed")]
    assert crawl.crawl(known, table, home, 3).count() == 3 and crawl.crawl(known, table, home, 10, max_depth=0).count() == 1
    wide = crawl.Scope(home, allow_domains=("o.example",), exclude=("/y",))
    assert {r.url for r in crawl.crawl(known, table, home, 10, 1, scope=wide).collect()} == {home, home + "x", "https://o.example/"}
    with pytest.raises(ValueError):
        crawl.crawl(known, table, home, 0)


def test_cache(spark):
    assert cache.cache_key("https://a.example") != cache.cache_key("https://a.example", Options(format="text")) and len(cache.cache_key("x")) == 16
    assert cache.fnv1a64("") == "cbf29ce484222325" and cache.fnv1a64("a") == "af63dc4c8601ec8c"
    options = Options.of({"body_width": 3}, selector="p")
    df = spark.createDataFrame([("https://a.example",)], "url string")
    assert df.select(cache.key_column(F.col("url"), options)).first()[0] == cache.cache_key("https://a.example", options)
    entries = spark.createDataFrame([("k1", 100, "old", 1), ("k1", 150, "new", 1), ("k1", 999, "v2", 2), ("k2", 100, None, 1), ("k3", 0, "c", 1)], "key string, created_at bigint, content string, schema_version int")
    latest = cache.latest_entries(entries)
    assert rows(latest, "key", "content") == [("k1", "new"), ("k3", "c")]
    req = spark.createDataFrame([("k1", "https://a.example", False, False), ("k2", "https://a.example", False, False), ("k3", "http://a.example", None, None), ("k1", "https://a.example", True, False), ("k1", "https://a.example", False, True), ("k1", "raw:x", False, False)], "key string, url string, sensitive boolean, screenshot boolean")
    look = lambda **o: [r[0] for r in cache.lookup(req.coalesce(1), latest, F.lit(199), **o).select("cache_status").collect()]
    assert sorted(look(ttl_seconds=50)) == ["hit", "ineligible", "ineligible", "ineligible", "miss", "stale"]
    assert sorted(look(ttl_seconds=49))[-2:] == ["stale", "stale"] and "hit" not in look(ttl_seconds=0)
    assert set(look(policy="off")) == {"disabled"} and look(policy="refresh").count("refresh") == 3
    stored = cache.store(latest, spark.createDataFrame([("k1", 200, "x", 1), ("k9", 1, "y", 1)], latest.schema))
    assert rows(stored, "key", "content") == [("k1", "x"), ("k3", "c"), ("k9", "y")]
    with pytest.raises(ValueError):
        look(policy="x")


def test_artifacts(spark):
    base = spark.createDataFrame([("run-1", 100, 10, False, "https://a.example/?x"), ("run-2", 200, 20, True, "https://a.example/?x"), ("run-3", 200, 30, False, None), ("run-4", 300, 40, None, "x")], "run_id string, modified bigint, size_bytes bigint, sensitive boolean, url string")
    runs = artifacts.runs(base, F.lit(100_300))
    assert [r.run_id for r in artifacts.listing(runs).collect()] == ["run-4", "run-2", "run-3", "run-1"] and runs.first().age == "1d"
    assert rows(artifacts.summary(runs)) == [(4, 100, 1, 0)]
    assert {r.run_id: r.url for r in artifacts.inspect(runs).collect()} == {"run-1": "https://a.example/?x", "run-2": "https://a.example/?%3Credacted%3E", "run-3": None, "run-4": "x"}
    gone = lambda **o: sorted(r.run_id for r in artifacts.prune(runs, **o).collect())
    assert gone(keep_last=2) == ["run-1", "run-3"] and gone(older_than=100_100) == ["run-1"] and gone(older_than=100_099) == ["run-1", "run-2", "run-3"]
    assert gone(max_bytes=100) == [] and gone(max_bytes=99) == ["run-1"] and gone(max_bytes=69) == ["run-1", "run-2", "run-3"] and gone(max_bytes=0, keep_last=1) == ["run-1", "run-2", "run-3"]
    assert gone(older_than=100_100, max_bytes=85) == ["run-1", "run-2"] and gone(keep_last=9) == []
    assert sorted(r.run_id for r in artifacts.delete(runs, ["run-2"], True).collect()) == ["run-1", "run-3", "run-4"]
    for bad in (lambda: artifacts.prune(runs), lambda: artifacts.delete(runs, ["run-1"], False), lambda: artifacts.delete(runs, ["batch-1"], True), lambda: artifacts.parse_duration("3w")):
        with pytest.raises(ValueError):
            bad()
    assert artifacts.prune(runs.limit(0), keep_last=1).count() == 0


COOKIE = "session string, name string, value string, domain string, path string, expires bigint, http_only boolean, secure boolean, same_site string"


def test_sessions(spark):
    state = spark.createDataFrame([("a", "sid", "1", ".Example.com", "/", None, True, True, None), ("b", " sid ", "1", "example.com", None, None, True, True, None), ("b", "t", "x", "sub.example.com", "/", None, False, False, None), ("a", "t", "y", "sub.example.com", "", None, False, False, None), ("a", "o", "z", "other.test", "/p", 5, False, False, "Lax")], COOKIE)
    merged, conflicts = sessions.compose_cookies(state)
    assert rows(merged, "name", "domain", "path", "value", "source_session") == [("o", "other.test", "/p", "z", "a"), ("sid", "example.com", "/", "1", None)]
    assert rows(conflicts) == [("t", "sub.example.com", "/", "session_conflict")]
    assert rows(sessions.filter_cookies(state, ["example.com", ""]), "name") == [(" sid ",), ("sid",), ("t",), ("t",)]
    assert rows(sessions.dedupe_cookies(state, "session"), "name", "value") == [("o", "z"), ("sid", "1"), ("t", "y")]
    assert {r.value for r in sessions.inspect(state).collect()} == {"<redacted>"}
    req = spark.createDataFrame([("https://sub.example.com/x", "b"), ("https://example.com/", "b"), ("raw:x", "b"), ("https://q.test/", "none"), ("https://q.test/", None)], "url string, session string")
    assert {(r.url, r.session): r.scope_error for r in sessions.replay_scope(req, state).collect()} == {("https://sub.example.com/x", "b"): None, ("https://example.com/", "b"): "session_scope_mismatch", ("raw:x", "b"): "usage_error", ("https://q.test/", "none"): "session_scope_mismatch", ("https://q.test/", None): None}
    ask = spark.createDataFrame([("http://sub.example.com/", "b"), ("https://other.test/p/q", "a"), ("https://other.test/pq", "a")], "url string, session string")
    assert {r.url: r.cookie_header for r in sessions.cookie_header(ask, state.fillna({"path": "/"})).collect()} == {"http://sub.example.com/": "t=x", "https://other.test/p/q": "o=z", "https://other.test/pq": None}
    raw = spark.createDataFrame([('{"name": "n", "value": "v", "domain": "d", "expires": 9.7}',), ('{"name": "n", "value": "v", "domain": "d", "expires": -1}',), ('{"name": "n"}',), ("x",)], "cookie string")
    assert rows(sessions.cookies_from_events(raw), "name", "path", "expires") == [("n", "/", 9), ("n", "/", None)]
    assert json.loads(sessions.cookie_json(state).where("cookie like '%Lax%'").first().cookie)["sameSite"] == "Lax"
    storage = spark.createDataFrame([("a", "https://x.test", "local", "k", "1"), ("b", "https://x.test", "local", "k", "2"), ("b", "https://y.test:8", "local", "k", "2")], "session string, origin string, kind string, name string, value string")
    assert sessions.compose_storage(storage)[1].count() == 1 and sessions.filter_storage(storage, ["y.test"]).count() == 1
    head = sessions.compose_header(spark.createDataFrame([("b", ["y", "x"], False), ("a", ["x"], True), ("c", None, None)], "name string, allowed_domains array<string>, sensitive boolean")).first()
    assert (head.sources, head.sensitive, head.allowed_domains) == (["a", "b", "c"], True, ["x", "y"])
    assert sessions.login_merge(state, state.where("name = 'o'").withColumn("value", F.lit("n")), ["other.test"]).where("name = 'o'").first().value == "n"
    names = spark.createDataFrame([("b",), ("a/b",), ("..",), ("",), ("a",)], "name string")
    assert [r.name for r in sessions.session_names(names).collect()] == ["a", "b"]
    origins = spark.range(1).select(sessions.candidate_origins(F.array(F.lit("d.test")), F.array(F.lit("HTTPS://E.test"))).alias("o")).first().o
    assert origins == ["http://d.test", "https://d.test", "https://e.test"]


def test_browser_rules(spark):
    from pagelake.functions.html import content_candidates
    from pagelake.operators import browser

    new_page = '{"targetInfo": {"type": "page", "targetId": "t2"}}'
    events = [(1, 0, "Page.loadEventFired", "{}"), (1, 1, "Page.frameScheduledNavigation", '{"url": "https://b.test/"}'), (1, 2, "Page.javascriptDialogOpening", "{}"), (2, 0, "Page.frameScheduledNavigation", '{"url": "https://a.test/x"}'), (2, 1, "Page.frameScheduledNavigation", '{"url": "::"}'), (2, 2, "Target.targetCreated", new_page.replace("t2", "t1")), (3, 5, "Target.attachedToTarget", new_page), (4, 0, "Page.windowOpen", None)]
    df = spark.createDataFrame([(*e, "https://a.test/", "t1") for e in events], "run int, pos int, method string, params string, start_url string, target_id string")
    assert rows(browser.hazards(df), "run", "pos", "code") == [(1, 1, "navigation_blocked"), (3, 5, "requires_confirmation"), (4, 0, "requires_confirmation")]
    assert browser.tracked_events(df, most=1).count() == 4
    targets = spark.createDataFrame([(1, 0, "page", "about:blank", "a"), (1, 1, "page", "chrome://x", "b"), (1, 2, "webview", "https://x", "c"), (2, 0, "worker", "https://x", "d"), (2, 1, "page", None, "e"), (3, 0, "worker", "u", "f")], "run int, pos int, type string, url string, target_id string")
    assert rows(browser.preferred_target(targets)) == [(1, "c"), (2, "e")]
    tree = json.dumps({"frameTree": {"frame": {"url": "https://W.a.test:8443/x"}, "childFrames": [{"frame": {"url": "data:x"}}, {"frame": {"url": "http://a.test/"}, "childFrames": [{"frame": {"url": "https://o.test"}}]}]}})
    assert browser.frame_origins(tree, ["a.test"]) == ["http://a.test", "https://w.a.test:8443"] and browser.frame_origins("x", ["a"]) == []
    assert spark.createDataFrame([(tree,)], "t string").select(browser.frame_origin_column("t", ["o.test"])).first()[0] == ["https://o.test"]
    cookies = spark.createDataFrame([("n", "v", "a.test", "/", 9, True, True), ("n", "v", "x.a.test", "/", 9, False, True), ("n", "v", ".x.a.test", "/", 9, False, True), ("d", "1", "a.test", "/", None, False, True), ("d", "2", ".a.test", "/", None, False, True)], "name string, value string, domain string, path string, expires bigint, session_only boolean, secure boolean")
    good, bad = browser.imported_cookies(cookies, ["a.test"])
    assert rows(good, "name", "domain", "expires", "http_only") == [("n", "a.test", None, True), ("n", "x.a.test", 9, True)] and rows(bad, "name") == [("d",)]
    warned = browser.screenshot_warnings(spark.createDataFrame([(True, None), (False, ["w"])], "s boolean, warnings array<string>"), F.col("s"))
    assert [len(r.warnings) for r in warned.collect()] == [1, 1]
    page = spark.createDataFrame([("<article>one two three</article><div class=nav>x</div><main>one two</main>",), (None,)], "h string").select(content_candidates("h").alias("c")).collect()
    assert [(c.tag, c.score > 0) for c in page[0].c] == [("main", True), ("article", True)] and page[1].c is None


def test_privacy_and_plans(spark):
    text = "a=s%20x, s+x and s x; longer s xy; \\u00e9"
    assert privacy.redact(text, ["s x", "", "s xy", "é"]) == "a=<redacted>, <redacted> and <redacted>; longer <redacted>; <redacted>"
    df = spark.createDataFrame([(text, True, "boom"), (None, False, "boom")], "content string, sensitive boolean, message string")
    assert df.select(privacy.redact_column(F.col("content"), ["s x", "s xy", "é"])).first()[0] == privacy.redact(text, ["s x", "s xy", "é"])
    assert [r.message for r in privacy.safe_error(df).collect()] == ["extraction failed for a session-backed request", "boom"]
    assert [r.verified for r in privacy.predicates(df, ["longer"], ["absent"]).collect()] == [True, False]
    plan = {"schema_version": actions.VERSION, "actions": [{"type": "wait", "selector": "p"}, {"type": "type", "selector": "#q", "text": "pässword", "sensitive": True}, {"type": "capture", "name": "a", "html": True}]}
    assert actions.plan_errors(json.dumps(plan), allow_sensitive=True) == [] and len(actions.plan_errors(json.dumps(plan))) == 1
    assert json.loads(actions.redacted_plan(json.dumps(plan)))["actions"][1] == {"type": "type", "selector": "#q", "text": "<redacted>", "sensitive": True, "text_redacted": True, "text_chars": 8}
    bad = [{"type": "wait"}, {"type": "wait", "selector": "p", "duration_ms": 1}, {"type": "click"}, {"type": "click", "selector": "["}, {"type": "select", "selector": "p", "value": "a", "index": 1}, {"type": "submit", "selector": "p", "confirm": True}, {"type": "capture", "name": "b c", "html": True}, {"type": "capture", "name": "b"}, {"type": "hover"}, {"type": "click", "selector": "p", "x": 1}]
    for action in bad:
        assert actions.plan_errors(json.dumps(plan | {"actions": [action]})), action
    twice = [{"type": "capture", "name": "a", "html": True}] * 2
    assert actions.plan_errors(json.dumps(plan | {"actions": twice})) and actions.plan_errors(json.dumps(plan | {"actions": []})) and actions.plan_errors("x") and actions.plan_errors(json.dumps(plan | {"schema_version": "2"}))
    plans = spark.createDataFrame([(1, json.dumps(plan | {"actions": twice[:1]})), (2, "x"), (3, None)], "run int, plan string")
    assert rows(actions.validate_plans(plans), "run", "ok") == [(1, True), (2, False), (3, False)]
    assert rows(actions.dry_run(plans)) == [(1, 0, "capture", "planned")]
    steps = spark.createDataFrame([(1, 0, "ok"), (1, 1, "failed"), (1, 2, "ok"), (2, 0, "ok")], "run int, index int, status string")
    assert rows(actions.until_failure(steps)) == [(1, 0, "ok"), (1, 1, "failed"), (2, 0, "ok")]


def test_doctor(spark):
    found = doctor.checks(spark, "/nowhere")
    assert found.where("id = 'store.data' and status = 'fail'").count() == 1 and doctor.summary(found).first().exit_code == 1


def test_sources_and_sinks(spark, tmp_path):
    import http.server
    import threading

    (tmp_path / "a.html").write_text("<p>ü\nx")
    page = readers.file_pages(spark, str(tmp_path / "a.html")).first()
    assert page.html == "<p>ü\nx" and page.url.startswith("file:///")
    inline = spark.createDataFrame([("raw:<p>a",), ("raw://<p>b",), ("https://x",)], "input string")
    assert rows(readers.inline_pages(inline), "html") == [("<p>a",), ("<p>b",)]
    runs = spark.createDataFrame([("r1", True, "get", False, "/s/runs/r1/c.md"), ("r2", True, "get", True, "/s/runs/r2/c.md"), ("r3", True, "map", False, "/s/runs/../../etc"), ("r4", False, "get", False, "/s/runs/r4/c.md"), ("r5", True, "map", None, "/s/runs/r5/c.md")], "run_id string, ok boolean, command string, sensitive boolean, content_path string")
    contents = runs.select("content_path", F.lit("text").alias("content"))
    assert rows(readers.run_sources(runs, contents, "/s/runs"), "run_id") == [("r1",), ("r5",)]
    assert rows(readers.run_sources(runs, contents, "/s/runs", allow_private=True, only_get=True), "run_id") == [("r1",), ("r2",)]
    (tmp_path / "m.json").write_text(json.dumps({"items": [{"index": 0, "url": "u", "status": "ok", "content_path": "p"}, {"index": 1, "url": "v", "status": "failed"}]}))
    assert rows(readers.manifest_items(spark, str(tmp_path / "m.json"))) == [(0, "u", "p")]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/moved": 302, "/loop": 302, "/missing": 404}.get(self.path, 200)
            self.send_response(code)
            if code == 302:
                self.send_header("Location", "/ok" if self.path == "/moved" else "/loop")
            self.end_headers()
            self.wfile.write(self.headers["User-Agent"].encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = spark.createDataFrame([(base + p,) for p in ("/ok", "/moved", "/loop", "/missing")] + [("ftp://x",), ("http://127.0.0.1:1/",)], "url string")
    got = {r.url.removeprefix(base): r for r in readers.fetch(asked, timeout=5).collect()}
    server.shutdown()
    assert got["/ok"].html == "pagelake/0.1" and got["/moved"].final_url == base + "/ok" and got["/missing"].status == 404 and got["/missing"].html
    assert got["/loop"].error and got["http://127.0.0.1:1/"].error and len(got) == 5
    df = spark.createDataFrame([(1, "b", None)], "z int, a string, m string")
    assert df.select(sinks.metadata_json(["z", "a", "m"])).first()[0] == '{"a":"b","m":null,"z":1}'
    assert df.select(sinks.run_id(F.col("a"), suffix="-map")).first()[0].startswith("run-") and json.loads(df.select(sinks.error_record(F.lit("c"), F.lit("m"))).first()[0])["ok"] is False
    sinks.write_lines(df, "a", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["b"]
    sinks.write_content(df, str(tmp_path / "content"))
    assert spark.read.parquet(str(tmp_path / "content")).count() == 1
    assert json.loads(df.select(sinks.debug_trace(["a"])).first()[0])["a"] == "b" and "```json" in df.select(sinks.records_markdown("a", "a")).first()[0]


def test_sql_functions(spark):
    from pagelake.functions.urls import register

    register(spark)
    row = spark.sql("select url_join('https://a.example/x', 'y') as j, glob_match('*x*', 'axb') as g, redact_url('https://a.example/?q') as r, fnv1a64('a') as f, normal_url('HTTP://A.example:80') as n, html_text('<p>a<p>b') as t, page_metadata('<title>T')['title'] as m, page_links('https://a.example', '<a href=/q>Q</a>')[0].url as l").first()
    assert tuple(row) == ("https://a.example/y", True, "https://a.example/?%3Credacted%3E", "af63dc4c8601ec8c", "http://a.example/", "a\nb", "T", "https://a.example/q")


def test_runs_without_an_id_keep_their_rows(spark):
    table = spark.createDataFrame([(None, 0, "https://a.example/", "failed"), (None, 1, "https://b.example/", "ok"), (None, 2, "https://c.example/", "ok"), (1, None, "https://d.example/", "ok"), (1, 0, None, "ok")], "run bigint, index bigint, url string, was string")
    out = batch.fail_fast(batch.dedupe(table, run="run"), F.col("was") == "failed", 1, run="run")
    assert sorted((r.run or 0, -1 if r["index"] is None else r["index"], r.status) for r in out.collect()) == [(0, 0, "failed"), (0, 1, "skipped"), (0, 2, "skipped"), (1, -1, "ok"), (1, 0, "ok")]


@pytest.mark.parametrize(("width", "descending"), [(None, False), (None, True), (7, False), (7, True)])
def test_running_sums(spark, width, descending):
    rng = random.Random(5)
    data = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(30)]), i, rng.randrange(9)) for i in range(300)] + [("c", 5, 1000 + i, 1) for i in range(200)]
    df = spark.createDataFrame(data, "part string, at int, id int, n int").repartition(5)
    got = {r.id: r.before for r in running_before(df, ["part"], F.col("n"), "at", width, ["id"], descending, "before").collect()}
    key = lambda r: ((r[1] is None) == descending, 0 if r[1] is None else -r[1] if descending else r[1], r[2])
    want, sums = {}, {}
    for r in sorted(data, key=key):
        want[r[2]] = sums.get(r[0], 0)
        sums[r[0]] = want[r[2]] + r[3]
    assert got == want


def test_pruning_of_runs_without_time_or_size(spark):
    table = spark.createDataFrame([("run-a", None, 5), ("run-b", 100, None), ("run-c", 200, 7), ("run-d", 300, 4)], "run_id string, modified bigint, size_bytes bigint")
    known = artifacts.runs(table, F.lit(400))
    assert {r.run_id for r in artifacts.prune(known, keep_last=3).collect()} == {"run-a"}
    assert {r.run_id for r in artifacts.prune(known, older_than=1000).collect()} == {"run-a"}
    assert {r.run_id for r in artifacts.prune(known, max_bytes=11).collect()} == {"run-a"}


def test_map_follows_the_base(spark):
    html = '<head><base href="https://b.example/k/"></head><a href="y">1</a><a href="/other">2</a><a href="https://a.example/docs/z">3</a><a href="y#again">4</a>'
    df = spark.createDataFrame([(1, "https://a.example/docs/x", html), (2, "https://a.example/docs/x", html.replace("https://b.example/k/", "/k/")), (3, "https://a.example/", None)], "page_id bigint, url string, html string")
    assert rows(links.map_links(df), "page_id", "url", "text") == [(1, "https://b.example/k/y", "1"), (2, "https://a.example/docs/y", "1"), (2, "https://a.example/docs/z", "3")]
    assert rows(links.map_summary(df), "page_id", "discovered", "emitted", "truncated") == [(1, 4, 1, False), (2, 4, 2, False), (3, 0, 0, False)]
    assert rows(links.map_summary(df, any_origin=True, any_path=True, max_links=2), "page_id", "discovered", "emitted", "truncated") == [(1, 2, 2, True), (2, 2, 2, True), (3, 0, 0, False)]


def test_crawl_over_pages_and_a_hub(spark):
    home = "https://a.example/"
    many = "".join(f'<a href="/p{i}">x</a><a href="https://far.example/{i}">y</a>' for i in range(3000))
    table = [(home, None, f"<script>'<a href=/menu>'</script><main><p>{many}</p></main>"), (home + "p0", home + "moved/", '<main><a href="q">q</a><a href="/p1">1</a></main>'), (home + "p1", None, None), (home + "moved/q", None, "<main><p>end</p></main>")]
    df = spark.createDataFrame(table, "url string, final_url string, html string")
    got = crawl.crawl_pages(df, home, 6, 3, 2, final_col="final_url")
    assert rows(got, "index", "url", "final_url", "depth", "status") == [(0, home, home, 0, "ok"), (1, home + "p0", home + "moved/", 1, "ok"), (2, home + "p1", home + "p1", 1, "failed"), (3, home + "p2", None, 1, "failed"), (4, home + "p3", None, 1, "failed"), (5, home + "p4", None, 1, "failed")]
    manifest = crawl.crawl_manifest(got, home, 6).first()
    assert json.loads(manifest.manifest_json)["summary"] == {"fetched": 6, "succeeded": 2, "failed": 4, "limit": 6}
    assert json.loads(manifest.metadata_json)["ok"] is False and manifest.manifest_md.splitlines()[7] == f"- ok depth=0 `{home}`"
    # a hub in a link table gives up no more links than the queue can take
    hub = spark.range(100_000).select(F.lit(home).alias("source_url"), F.col("id").alias("pos"), F.concat(F.lit(home + "p"), "id").alias("url"))
    known = spark.createDataFrame([(home, None)], "url string, final_url string")
    assert crawl.crawl(known, hub, home, 100).count() == 100
    assert len(crawl._links(hub, [home], crawl.Scope(home), 150)[home]) == 150


def test_consent(spark):
    shot = '{"actions": [{"type": "capture", "screenshot": true}]}'
    df = spark.createDataFrame([(1, "{}", [], True, None), (2, "{}", [], True, 9222), (3, "{}", [], False, 9222), (4, "{}", ["s"], False, None), (5, shot, [], False, None), (6, "broken", None, None, None)], "id int, plan string, sessions array<string>, current_tab boolean, port int")
    assert {r.id for r in privacy.consent_errors(df).where("consent_error is not null").collect()} == {1, 2, 3, 4, 5}
    assert {r.id for r in privacy.consent_errors(df, allow_private=True, allow_screenshot=True).where("consent_error is not null").collect()} == {1, 3}


def test_session_store(spark, tmp_path):
    cookie = ("k", "v", "a.example", "/", None, False, True, None)
    table = spark.createDataFrame([("one", ["a.example"], True, [cookie, (*cookie[:1], "w", *cookie[2:])], [("https://a.example", "local", "x", "1")]), ("../bad", [], False, [], [])], sessions.STORE)
    sessions.write_store(table, str(tmp_path / "store"))
    (tmp_path / "store" / "broken.json").write_text("{oops\n")
    back = sessions.read_store(spark, str(tmp_path / "store"))
    assert rows(sessions.store_views(back), "name", "cookies", "origins", "entries", "sensitive") == [("one", 2, 1, 1, True)]
    assert sessions.without_session(back, "one").count() == 0 and sessions.without_session(back, "two").count() == 1
    asked = spark.createDataFrame([("https://a.example/p", "one"), ("https://b.example/", "one")], "url string, session string")
    held = sessions.store_cookies(back).withColumn("name", F.concat("name", F.lit(9) - F.col("position")))
    assert rows(sessions.cookie_header(asked, held, position="position"), "url", "cookie_header") == [("https://a.example/p", "k9=v; k8=w"), ("https://b.example/", None)]
    storage = spark.createDataFrame([("one", "https://a.example", "local", "x", "1")], "session string, origin string, kind string, name string, value string")
    scope = {r.url: r.scope_error for r in sessions.replay_scope(asked.unionByName(spark.createDataFrame([("https://sub.a.example/", "one")], asked.schema)), held, storage=storage).collect()}
    assert scope == {"https://a.example/p": None, "https://b.example/": "session_scope_mismatch", "https://sub.a.example/": "session_scope_mismatch"}
    assert sessions.login_merge_storage(storage, storage.withColumn("value", F.lit("2")), ["a.example"]).first().value == "2"


def test_manifest_sources(spark):
    items = spark.createDataFrame([(0, "https://a.example/", "/s/run-1/./content.md"), (1, "https://b.example/", "/s/run-2/content.md")], "index bigint, url string, content_path string")
    metadata = spark.createDataFrame([("/s/x/../run-1/content.md", "https://a.example/final", "markdown", None)], "content_path string, final_url string, content_format string, sensitive boolean")
    contents = spark.createDataFrame([("/s/run-1/content.md", "# A")], "content_path string, content string")
    assert rows(readers.manifest_sources(items, metadata, contents)) == [(0, "https://a.example/", "https://a.example/final", "markdown", False, "# A")]
    assert rows(readers.manifest_errors(items, metadata), "index") == [(1,)] and readers.manifest_errors(items.limit(0), metadata).count() == 1
    runs = spark.createDataFrame([("/s/run-1/content.md", True), ("/s/run-1/../../etc/x", True), ("/t/content.md", True)], "content_path string, ok boolean").selectExpr("*", "'get' command", "false sensitive")
    texts = spark.createDataFrame([(p, "t") for p in ("/s/run-1/content.md", "/s/run-1/../../etc/x", "/t/content.md")], "content_path string, content string")
    assert readers.run_sources(runs, texts, "/s").count() == 1 and readers.run_sources(runs, texts, "/s", contained=False).count() == 3


def test_report_forms(spark):
    found = spark.createDataFrame([(1, "https://b.example/", "B", "https://a.example/", False, False, None), (1, "https://a.example/x", "", "https://a.example/", True, True, "text/html")], "page_id bigint, url string, text string, source_url string, same_origin boolean, same_path boolean, content_type string")
    assert [x["url"] for x in json.loads(sinks.links_json(found, "page_id").first().report)] == ["https://a.example/x", "https://b.example/"]
    record = spark.createDataFrame([("https://a.example/", '{"h": [1]}', None), (None, None, "no content")], "final_url string, values_json string, error string").withColumn("r", sinks.records_json())
    assert [json.loads(r.r) for r in record.collect()] == [{"final_url": "https://a.example/", "values": {"h": [1]}}, {"error": "no content", "values": None}]
    assert [r[0] for r in spark.createDataFrame([("a",), ("b\n",)], "c string").select(sinks.content_lines(F.col("c"))).collect()] == ["a\n", "b\n"]


def test_many_hashes_at_once():
    texts = ["", "a", "foobar", "é" * 50, "x" * 1000, "a"]
    assert fnv1a64_many(texts).tolist() == [int(fnv1a64(t), 16) for t in texts] and fnv1a64("foobar") == "85944171f73967e8"
    assert len(fnv1a64_many([])) == 0


def test_prune_results_and_file_entries(spark):
    table = spark.createDataFrame([(f"run-{i}", i * 100, i, '{"artifacts": {"content": "/elsewhere/c.md", "debug": ["/s/run-1/debug.json"], "captures": ["/s/run-1/../x.png"]}}' if i == 1 else None) for i in range(3)], "run_id string, modified bigint, size_bytes bigint, metadata string")
    known = artifacts.runs(table, F.lit(400))
    after, chosen = artifacts.prune_result(known, keep_last=1)
    assert after.count() == 3 and rows(chosen) == [("run-0", 0, "would_delete"), ("run-1", 1, "would_delete")]
    after, chosen = artifacts.prune_result(known, apply=True, keep_last=1)
    assert rows(after, "run_id") == [("run-2",)] and rows(chosen, "action") == [("deleted",)] * 2
    with pytest.raises(ValueError):
        artifacts.prune_result(known, apply=True, dry_run=True, keep_last=1)
    files = spark.createDataFrame([("/s/run-1/debug.json", 7), ("/elsewhere/c.md", 9), ("/s/run-0/content.md", 3)], "path string, size_bytes bigint")
    got = rows(artifacts.file_entries(known.where("run_id <> 'run-2'"), files, "/s"), "run_id", "kind", "ownership", "exists", "size_bytes")
    assert got == [("run-0", "content", "internal", True, 3), ("run-0", "metadata", "internal", False, 0), ("run-1", "capture", "external", False, 0), ("run-1", "content", "external", True, 9), ("run-1", "debug", "internal", True, 7), ("run-1", "metadata", "internal", False, 0)]


def test_finalize_exports_and_extract_actions(spark):
    df = spark.createDataFrame([(1, "https://a.example/", "<main><p>Some words here</p></main>", True), (2, "https://a.example/", None, False)], "page_id bigint, url string, html string, sensitive boolean")
    done = pages.finalize(pages.get(df, keep=("page_id", "sensitive")), max_chars=4, debug=True, keep=("page_id",)).orderBy("page_id").collect()
    record = json.loads(done[0].envelope)
    assert record["data"]["limits"]["chars_before"] == 15 and "content" not in record["data"] and record["data"]["usage"]["content_bytes"] == 4 and json.loads(done[0].debug_trace)["ok"]
    assert json.loads(done[1].envelope)["ok"] is False
    cookies = spark.createDataFrame([("k", "v", "a.example"), ("k", "v", "b.example")], "name string, value string, domain string")
    storage = spark.createDataFrame([("https://c.example", "x")], "origin string, name string")
    kept, stored, error = sessions.login_export(cookies, storage, ["a.example"])
    assert kept.count() == 1 and stored.count() == 0 and error.count() == 0 and sessions.login_export(cookies, storage, ["d.example"])[2].first().code == "login_empty"
    seen = spark.createDataFrame([(1, "https://a.example/", "<div><nav>menu</nav><article><p>Body of it</p></article></div>", ".x"), (2, "https://a.example/", None, ".gone"), (3, "https://a.example/", None, None)], "run int, url string, html string, selector string")
    got = {r.run: r for r in actions.extract_results(seen, Options(format="text")).collect()}
    assert got[1].content == "Body of it" and got[2].error.code == "selector_not_found" and got[3].error.code == "extraction_failed"
