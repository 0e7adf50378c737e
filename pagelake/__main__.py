"""``python -m pagelake COMMAND ...``; a bare URL, ``file://`` address or ``raw:`` document means ``get``.

Sources are such inputs, or Parquet tables: of pages (url, html) for get, map and crawl, of
texts (page_id, content, ...) for search, extract and verify, of runs for artifacts, of
stored sessions for session, and a file of URLs for batch.
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagelake")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *positional: str, **flags: dict) -> None:
        p = commands.add_parser(name, help=help_)
        for x in positional:
            p.add_argument(x)
        for flag, settings in flags.items():
            p.add_argument("--" + flag.replace("_", "-"), **settings)
        p.add_argument("--out", help="write Parquet here instead of showing rows")

    number = lambda default: {"type": int, "default": default}
    several = {"action": "append", "default": []}
    switch = {"action": "store_true"}
    add("get", "extract pages", "source", format={"default": "markdown"}, selector={}, exclude_selector={}, max_chars={"type": int}, option={**several, "metavar": "NAME=VALUE"})
    add("map", "list the links of pages", "source", any_origin=switch, any_path=switch, include=several, exclude=several, content_type=several, max_links=number(500), summary=switch)
    add("crawl", "follow links from a page of a table", "source", "start", limit=number(20), max_depth=number(2), concurrency=number(2), same_path=switch, allow_domain=several, include=several, exclude=several, manifest=switch)
    add("search", "find sections", "source", "query", max_results=number(8), context_chars=number(240), allow_private=switch)
    add("extract", "extract a field from texts", "source", "field", path={}, selector={})
    add("batch", "plan the fetches of a list of URLs", "source", manifest=switch)
    add("verify", "check texts for what they must and must not contain", "source", contains=several, lacks=several)
    add("plan", "validate action plans (a table with a column plan)", "source", allow_sensitive=switch, allow_submit=switch)
    add("session", "list stored sessions", "source", cookies=switch)
    add("artifacts", "list or prune stored runs", "source", now={"type": int, "required": True}, summary=switch, older_than={}, keep_last={"type": int}, max_bytes={"type": int}, apply={**switch, "help": "show what stays instead of what would go"})
    add("query", "run a named query over a folder of tables", "name", "folder")
    add("doctor", "check the installation")
    return top


def main(argv: list[str] | None = None) -> None:
    from . import url as urls

    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and urls.classify_input(argv[0]):
        argv.insert(0, "get")
    args = parser().parse_args(argv)

    from .session import build_session

    df = result(build_session(), args)
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(20, truncate=120)


def result(spark, args):
    """The rows of one command."""
    from . import url as urls
    from .operators import actions, artifacts, batch, crawl, doctor, fields, links, pages, privacy, search, sessions
    from .page import Options
    from .plans import catalog
    from .sources import readers

    def pages_of(source: str):
        kind = urls.classify_input(source)
        one = spark.createDataFrame([(source,)], "url string") if kind else None
        if kind == "http":
            return readers.fetch(one).select("final_url", "html").withColumnRenamed("final_url", "url")
        if kind == "file":
            return readers.file_pages(spark, source)
        return readers.inline_pages(one, "url") if kind else spark.read.parquet(source)

    command = args.command
    if command == "doctor":
        return doctor.checks(spark)
    if command == "query":
        return catalog.queries()[args.name](spark, args.folder)
    if command == "get":
        options = Options.of([tuple(o.partition("=")[::2]) for o in args.option], format=args.format, selector=args.selector, exclude_selector=args.exclude_selector, max_chars=args.max_chars)
        return pages.with_usage(pages.get(pages_of(args.source), options))
    if command == "map":
        filters = {"any_origin": args.any_origin, "any_path": args.any_path, "include": args.include, "exclude": args.exclude, "content_types": args.content_type, "max_links": args.max_links}
        return (links.map_summary if args.summary else links.map_links)(pages_of(args.source).selectExpr("url as page", "url", "html"), "page", **filters)
    if command == "crawl":
        scope = crawl.Scope(args.start, same_path=args.same_path, allow_domains=tuple(args.allow_domain), include=tuple(args.include), exclude=tuple(args.exclude))
        items = crawl.crawl_pages(pages_of(args.source), args.start, args.limit, args.max_depth, args.concurrency, scope)
        return crawl.crawl_manifest(items, args.start, args.limit) if args.manifest else items
    if command == "batch":
        items = batch.dedupe(readers.url_list(spark, args.source))
        return batch.manifest_parts(items.selectExpr("*", "1 as run"), "run") if args.manifest else items
    table = spark.read.json(args.source, schema=sessions.STORE) if command == "session" else spark.read.parquet(args.source)
    if command == "session":
        return sessions.inspect(sessions.store_cookies(table)) if args.cookies else sessions.store_views(table)
    if command == "search":
        return search.search(table, args.query, args.max_results, args.context_chars, allow_private=args.allow_private, sensitive="sensitive" if "sensitive" in table.columns else None)
    if command == "extract":
        wanted = fields.shortcut(args.field) if args.field in ("headings", "links", "tables", "definitions") else [fields.Field("value", args.field, args.selector, path=args.path)]
        return fields.extract_fields(table, wanted).select("page_id", "final_url", "ok", "values_json", "error")
    if command == "verify":
        return privacy.predicates(table, args.contains, args.lacks).select("page_id", "predicates", "verified")
    if command == "plan":
        return actions.validate_plans(table, "plan", args.allow_sensitive, args.allow_submit)
    from pyspark.sql import functions as F

    known = artifacts.runs(table, F.lit(args.now))
    if args.summary:
        return artifacts.summary(known)
    if args.older_than is None and args.keep_last is None and args.max_bytes is None:
        return artifacts.listing(artifacts.inspect(known))
    chosen = artifacts.prune(known, args.older_than and artifacts.parse_duration(args.older_than), args.keep_last, args.max_bytes)
    return known.join(chosen.select("run_id"), "run_id", "left_anti") if args.apply else chosen


if __name__ == "__main__":
    main()
