"""Queries of the reference's operators over the tables of TESTDATA.md, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.html import needs_render as needs_render_of
from ..functions.html import page_metadata as page_metadata_of
from ..operators import actions, artifacts, batch, cache, crawl, fields, links, pages, privacy, search, sessions
from ..operators.running import running_before
from ..page import Options
from ..sources import sinks


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _html(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "source_pages").where("content_format = 'html' and content is not null").select("page_id", F.coalesce("final_url", "url").alias("url"), F.col("content").alias("html"))


def _get(format: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        out = pages.get(_html(spark, folder), Options(format=format), keep=("page_id",))
        return pages.with_usage(out).select("page_id", "ok", "final_url", "content", "source_bytes", "needs_render", F.col("usage.content_bytes").alias("content_bytes"), F.col("usage.estimated_tokens").alias("estimated_tokens"), F.col("usage.estimated_tokens_saved").alias("estimated_tokens_saved"))

    return query


get_markdown, get_text, get_html, get_json = map(_get, ("markdown", "text", "html", "json"))


def get_with_options(spark, folder):
    """Reference-style links, wrapped bodies and no overlays, in one pass."""
    o = Options.of({"inline_links": "false", "body_width": "72", "exclude_external_images": "true", "remove_forms": "true", "pad_tables": "true"})
    return pages.get(_html(spark, folder), o, keep=("page_id",)).select("page_id", "ok", "content")


def page_metadata(spark, folder):
    return _html(spark, folder).select("page_id", F.explode(page_metadata_of("html")).alias("name", "value"))


def needs_render(spark, folder):
    return _html(spark, folder).select("page_id", needs_render_of("html").alias("needs_render"))


def page_usage(spark, folder):
    df = _read(spark, folder, "source_pages").where("content is not null")
    return pages.with_usage(df, source_bytes=None).select("page_id", F.col("usage.content_bytes").alias("content_bytes"), F.col("usage.estimated_tokens").alias("estimated_tokens"))


def max_chars_limits(spark, folder):
    df = pages.with_limits(_read(spark, folder, "source_pages").where("content is not null").select("page_id", "content"), 1000)
    return df.select("page_id", "content", F.col("limits.truncated").alias("truncated"), F.col("limits.chars_before").alias("chars_before"), F.col("limits.chars_after").alias("chars_after"))


def input_classify(spark, folder):
    return _read(spark, folder, "batch_items").select("batch_id", "item_index", "url", U.input_kind(F.col("url")).alias("kind")).distinct()


def url_parts(spark, folder):
    u = F.col("url")
    return _read(spark, folder, "source_pages").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.port(u).alias("port"), U.path(u).alias("path"), U.path_prefix(U.path(u)).alias("prefix"), U.without_fragment(u).alias("normal"))


def content_types(spark, folder):
    return _read(spark, folder, "links").groupBy(U.content_type(U.path(F.col("url"))).alias("content_type")).agg(F.count("*").alias("links"))


def link_origins(spark, folder):
    """Origin and path relation of every link row, computed anew."""
    u, s = F.col("url"), F.col("source_url")
    same_path = F.coalesce(U.path(u).startswith(U.path_prefix(U.path(s))), F.lit(False))
    return _read(spark, folder, "links").groupBy(U.same_origin(u, s).alias("same_origin"), same_path.alias("same_path")).agg(F.count("*").alias("links"))


def _link_table(spark, folder):
    """Rows of ``links`` numbered per page; equal rows stay equal, so ties don't matter."""
    df = _read(spark, folder, "links").where("url is not null and source_url is not null")
    rows = df.select(F.col("source_url").alias("page_id"), "source_url", "text", F.col("url").alias("__url"), U.without_fragment(F.col("url")).alias("url"))
    placed = running_before(rows, ["source_url"], F.lit(1), "__url", ties=["text"], name="pos")
    return placed.select("page_id", "source_url", "url", F.coalesce("text", F.lit("")).alias("text"), F.col("pos").cast("bigint").alias("pos"))


def map_links(spark, folder):
    return links.map_links(_html(spark, folder), any_origin=True, any_path=True)


def map_summary(spark, folder):
    return links.map_summary(_html(spark, folder), any_origin=True, any_path=True, max_links=5)


def map_filtered(spark, folder):
    out = links.filter_links(_link_table(spark, folder), any_path=True, exclude=("/login",), content_types=("text/html",), max_links=3)
    return out.select("source_url", "url", "text", "pos")


def search_sections(spark, folder):
    df = _read(spark, folder, "source_artifacts").where("content is not null").select("artifact_id", "content")
    return search.sections(df, keep=("artifact_id",)).select("artifact_id", "section_id", "heading", "char_start", "char_end")


def search_topk(spark, folder):
    df = _read(spark, folder, "source_artifacts").where("content is not null")
    return search.search(df, "library card", max_results=3, key="artifact_id", sensitive="sensitive").select("artifact_id", "rank", "section_id", "score", "snippet", "char_start", "char_end")


def search_report(spark, folder):
    df = _read(spark, folder, "source_artifacts").where("content is not null")
    return sinks.search_markdown(search.search(df, "library card", max_results=3, key="artifact_id"), "artifact_id")


def _extract(field_list, kinds, rows=True):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = _read(spark, folder, "source_pages").where(F.col("content_format").isin(*kinds) & F.col("content").isNotNull())
        out = fields.extract_fields(df, field_list)
        return out.select("page_id", "ok", "values_json", "error") if rows else out

    return query


#: Every format but JSON, whose records have no text structure.
_TEXTS = ("markdown", "text", "html")


def _listed(name: str, kind: str, out: DataFrame) -> DataFrame:
    """A row for each entry of a field that holds a list of records."""
    listed = F.from_json(F.get_json_object("values_json", f"$.{name}"), f"array<struct<{kind}>>")
    return out.select("page_id", F.posexplode(listed).alias("pos", "x")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "x.*")


def extract_headings(spark, folder):
    return _listed("headings", "level:bigint,text:string", _extract(fields.shortcut("headings"), _TEXTS, rows=False)(spark, folder))


def extract_links(spark, folder):
    return _listed("links", "text:string,url:string", _extract(fields.shortcut("links"), _TEXTS, rows=False)(spark, folder))


def extract_tables(spark, folder):
    """A row for each cell."""
    found = _listed("tables", "headers:array<string>,rows:array<map<string,string>>", _extract(fields.shortcut("tables"), _TEXTS, rows=False)(spark, folder))
    rows = found.select("page_id", "pos", F.posexplode("rows").alias("row", "cells"))
    return rows.select("page_id", "pos", F.col("row").cast("bigint").alias("row"), F.explode("cells").alias("name", "value"))


def extract_definitions(spark, folder):
    return _listed("definitions", "term:string,definition:string", _extract(fields.shortcut("definitions"), _TEXTS, rows=False)(spark, folder))


def extract_selector(spark, folder):
    wanted = [fields.Field("title", "selector", "h1"), fields.Field("targets", "selector", "a", "attr:href", True)]
    out = _extract(wanted, ("html",), rows=False)(spark, folder)
    targets = F.from_json(F.get_json_object("values_json", "$.targets"), "array<string>")
    return out.select("page_id", F.get_json_object("values_json", "$.title").alias("title"), F.array_join(targets, " ").alias("targets"))


def extract_metadata(spark, folder):
    out = _extract([fields.Field("site", "metadata", path="$.site"), fields.Field("lang", "metadata", path="/lang")], ("markdown", "html", "text"), rows=False)(spark, folder)
    return out.select("page_id", F.get_json_object("values_json", "$.site").alias("site"), F.get_json_object("values_json", "$.lang").alias("lang"))


def extract_json(spark, folder):
    return _extract([fields.Field("code", "json", path="$.error.code"), fields.Field("status", "json", path="status")], ("json",))(spark, folder)


def extract_summary(spark, folder):
    wanted = fields.shortcut("headings")
    df = _read(spark, folder, "source_artifacts")
    return fields.extract_summary(fields.extract_fields(df, wanted, key="artifact_id", kind=None, metadata=None), wanted)


def batch_dedupe(spark, folder):
    return batch.dedupe(_batch(spark, folder).select("batch_id", "item_index", "url"), index="item_index", run="batch_id")


def _batch(spark, folder):
    """Batch items with repeated rows taken once."""
    return _read(spark, folder, "batch_items").groupBy("batch_id", "item_index").agg(F.min("url").alias("url"), F.max("status").alias("was"))


def batch_fail_fast(spark, folder):
    items = batch.dedupe(_batch(spark, folder), index="item_index", run="batch_id")
    return batch.fail_fast(items, F.col("was") == "failed", 2, "item_index", "batch_id").select("batch_id", "item_index", "url", "status", "reason")


def batch_summary(spark, folder):
    return batch.summary(_read(spark, folder, "batch_items"), by=["batch_id"])


def batch_manifest(spark, folder):
    """Runs of more than 10,000 items come in numbered parts, others as one."""
    return batch.manifest_parts(batch.dedupe(_batch(spark, folder), index="item_index", run="batch_id"), "batch_id", "item_index")


def crawl_summary(spark, folder):
    return crawl.crawl_summary(_read(spark, folder, "crawl_items"))


def crawl_replay(spark, folder):
    """A crawl from the page with most links over the link table."""
    table = _link_table(spark, folder)
    start = table.groupBy("source_url").count().orderBy(F.desc("count"), "source_url").first()
    found = _read(spark, folder, "source_pages").select(U.without_fragment(F.col("url")).alias("url"), "final_url")
    first = start[0] if start else "https://nowhere.invalid/"
    scope = crawl.Scope(first, same_origin=False)
    return crawl.crawl(found, table.select(U.without_fragment(F.col("source_url")).alias("source_url"), "pos", "url"), first, 100, 5, 8, scope)


def _requests(spark, folder):
    df = _read(spark, folder, "source_pages")
    return df.select("page_id", "url", "sensitive", F.lit(False).alias("screenshot"), F.unix_timestamp("fetched_at").alias("at"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("key"), "content")


def cache_status(spark, folder):
    """Each page asks for its URL a day after the last fetch of the table's first half-month."""
    req = _requests(spark, folder)
    entries = cache.latest_entries(req.where("at < unix_timestamp(timestamp '2026-01-15 00:00:00')").select("key", F.col("at").alias("created_at"), "content", F.lit(1).alias("schema_version")))
    out = cache.lookup(req, entries, F.lit(1768435200), ttl_seconds=7 * 86_400)
    return out.select("page_id", "cache_status", "cache_eligible", "age_seconds", "cache_reason")


def cache_latest(spark, folder):
    req = _requests(spark, folder).select("key", F.col("at").alias("created_at"), "content", F.lit(1).alias("schema_version"))
    return cache.latest_entries(req).select("key", "created_at", F.char_length("content").cast("bigint").alias("chars"))


def cache_keys(spark, folder):
    return _read(spark, folder, "source_pages").where("url is not null").select("page_id", cache.key_column(F.col("url"), Options(format="text")).alias("key"))


def _runs(spark, folder):
    df = _read(spark, folder, "source_artifacts")
    base = df.select(F.concat(F.lit("run-"), F.col("artifact_id").cast("string")).alias("run_id"), F.unix_timestamp("fetched_at").alias("modified"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size_bytes"), "sensitive", "url")
    return artifacts.runs(base, F.lit(1772323200))


def artifacts_summary(spark, folder):
    return artifacts.summary(_runs(spark, folder))


def artifacts_list(spark, folder):
    return artifacts.listing(_runs(spark, folder)).select("run_id", "modified", "size_bytes", "age_seconds", "age")


def artifacts_inspect(spark, folder):
    return artifacts.inspect(_runs(spark, folder)).select("run_id", "url", "sensitive")


def prune_keep_last(spark, folder):
    return artifacts.prune(_runs(spark, folder), keep_last=25).select("run_id")


def prune_older_than(spark, folder):
    return artifacts.prune(_runs(spark, folder), older_than=artifacts.parse_duration("30d"), keep_last=5).select("run_id")


def prune_max_bytes(spark, folder):
    return artifacts.prune(_runs(spark, folder), older_than=artifacts.parse_duration("55d"), keep_last=5, max_bytes=150_000).select("run_id")


def _cookies(spark, folder):
    """Cookie rows drawn from crawl items: name from the depth, domain from the host, value from the status."""
    u = F.coalesce("final_url", "url")
    df = _read(spark, folder, "crawl_items").where("url is not null")
    return df.select(
        F.concat(F.lit("s"), (F.col("crawl_id") % 7).cast("string")).alias("session"), F.concat(F.lit("c"), F.col("depth").cast("string")).alias("name"), F.coalesce("status", F.lit("")).alias("value"), U.host(u).alias("domain"), F.lit("/").alias("path"),
        F.lit(None).cast("bigint").alias("expires"), F.lit(False).alias("http_only"), F.lit(True).alias("secure"), F.lit(None).cast("string").alias("same_site"),
    ).where("domain is not null")


def session_compose(spark, folder):
    return sessions.compose_cookies(_cookies(spark, folder))[0].select("name", "domain", "path", "value", "source_session")


def session_conflicts(spark, folder):
    return sessions.compose_cookies(_cookies(spark, folder))[1]


def session_filter(spark, folder):
    return sessions.filter_cookies(_cookies(spark, folder), ["example", ".test"]).groupBy("domain").agg(F.count("*").alias("cookies"))


def session_inspect(spark, folder):
    return sessions.inspect(_cookies(spark, folder)).groupBy("session", "value").agg(F.count("*").alias("cookies"))


def replay_scope(spark, folder):
    req = _read(spark, folder, "batch_items").select("batch_id", "item_index", "url", F.concat(F.lit("s"), (F.col("batch_id") % 7).cast("string")).alias("session")).distinct()
    one = _cookies(spark, folder).select("session", "domain").distinct()
    return sessions.replay_scope(req, one)


def cookie_header(spark, folder):
    req = _read(spark, folder, "batch_items").where("url is not null").select("url", F.concat(F.lit("s"), (F.col("batch_id") % 7).cast("string")).alias("session")).distinct()
    return sessions.cookie_header(req, sessions.compose_cookies(_cookies(spark, folder))[0].withColumn("session", F.coalesce("source_session", F.lit("s0"))))


def redact_titles(spark, folder):
    return _read(spark, folder, "documents").where("text is not null").select("doc_id", privacy.redact_column(F.col("text"), ["library card", "token & budget"]).alias("text"))


def authorize_predicates(spark, folder):
    df = privacy.predicates(_read(spark, folder, "source_pages").select("page_id", "content"), ["the"], ["Access denied"])
    return df.select("page_id", "verified")


def envelope(spark, folder):
    df = _read(spark, folder, "source_pages").select("page_id", "url", "sensitive", "content")
    return pages.envelope(df, "get", ["url", "content"]).select("page_id", "envelope")


def plan_validation(spark, folder):
    """Plans built from links: a click on every link, invalid where the text is null."""
    df = _read(spark, folder, "links").where("url is not null").select("url", F.coalesce("text", F.lit("")).alias("text")).distinct()
    action = F.when(F.col("text") == "", F.struct(F.lit("wait").alias("type"), F.lit(None).cast("string").alias("selector"))).otherwise(F.struct(F.lit("click").alias("type"), F.lit("a[href]").alias("selector")))
    plans = df.select("url", "text", F.to_json(F.struct(F.lit(actions.VERSION).alias("schema_version"), F.array(action).alias("actions"))).alias("plan"))
    return actions.validate_plans(plans).groupBy("ok").agg(F.count("*").alias("plans"))


def redact_urls(spark, folder):
    return _read(spark, folder, "source_pages").where("url is not null").select("page_id", U.redact_url(F.col("url")).alias("url"))


def normal_urls(spark, folder):
    return _read(spark, folder, "links").where("url is not null").select("url", U.normal_url(F.col("url")).alias("normal")).distinct()
