"""Queries of the smaller operators: browser rules, cookies, storage, sinks, sources, plans. Whole tables each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import urls as U
from ..operators import actions, artifacts, batch, browser, cache, crawl, fields, links, pages, privacy, sessions
from ..page import Options
from ..session import ensure_checkpoint_dir
from ..sources import readers, sinks
from ..streaming import pages as stream
from .queries import _batch, _cookies, _extract, _link_table, _read, _requests, _runs


def _storage(spark: SparkSession, folder: str) -> DataFrame:
    """Storage rows drawn from links: the origin of the target, an entry for each content type and the text as its value."""
    u = F.col("url")
    df = _read(spark, folder, "links").where("url is not null and source_url is not null")
    return df.select(F.concat(F.lit("s"), (F.length("source_url") % 5).cast("string")).alias("session"), F.concat(U.scheme(u), F.lit("://"), U.host(u)).alias("origin"), F.lit("local").alias("kind"), F.coalesce(U.content_type(U.path(u)), F.lit("none")).alias("name"), F.coalesce(U.path_prefix(U.path(u)), F.lit("")).alias("value"))


def storage_compose(spark, folder):
    merged, _ = sessions.compose_storage(_storage(spark, folder))
    return merged.select("origin", "kind", "name", "value", "source_session")


def storage_conflicts(spark, folder):
    return sessions.compose_storage(_storage(spark, folder))[1]


def storage_filter(spark, folder):
    return sessions.filter_storage(_storage(spark, folder), ["example", "docs.bobabe.invalid"]).groupBy("origin").agg(F.count("*").alias("entries"))


def login_merge(spark, folder):
    """Sessions with even numbers log in again on the ``.test`` sites."""
    all_ = _cookies(spark, folder)
    old, fresh = all_.where("session <> 's0'"), all_.where("session = 's0'")
    return sessions.login_merge(old, fresh, ["test"]).groupBy("session", "domain").agg(F.count("*").alias("cookies"))


def login_merge_storage(spark, folder):
    all_ = _storage(spark, folder)
    return sessions.login_merge_storage(all_.where("session <> 's0'"), all_.where("session = 's0'"), ["test"]).groupBy("session", "origin").agg(F.count("*").alias("entries"))


def cookie_events(spark, folder):
    """Cookies out of JSON records and back."""
    events = _cookies(spark, folder).select(F.to_json(F.struct("name", "value", "domain", "path", (F.length("value") - 2).alias("expires"), F.lit(True).alias("secure"))).alias("cookie"))
    return sessions.cookies_from_events(events).groupBy("name", "domain", "expires", "http_only", "secure").agg(F.count("*").alias("cookies"))


def cookie_records(spark, folder):
    return sessions.cookie_json(_cookies(spark, folder)).groupBy("cookie").agg(F.count("*").alias("rows"))


def cookie_dedupe(spark, folder):
    """Of the cookies of one name, domain and path the one from the earliest session and value."""
    df = _cookies(spark, folder).groupBy("name", "domain", "path", "session").agg(F.min("value").alias("value"))
    return sessions.dedupe_cookies(df, "session").select("name", "domain", "path", "session", "value")


def candidate_origins(spark, folder):
    df = _read(spark, folder, "batch_items").where("url is not null").groupBy("batch_id").agg(F.array_sort(F.collect_set(U.host(F.col("url")))).alias("domains"))
    return df.select("batch_id", F.explode(sessions.candidate_origins(F.col("domains"), F.array(F.lit("HTTPS://Extra.Example")))).alias("origin"))


def login_domains(spark, folder):
    return _read(spark, folder, "source_pages").where("url is not null").select("page_id", F.explode(U.login_domains(F.col("url"))).alias("domain"))


def import_domains(spark, folder):
    """Cookie domains with and without a leading dot against the site above them."""
    h = U.host(F.col("url"))
    df = _read(spark, folder, "source_pages").where(h.isNotNull())
    root = F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)
    return df.select("page_id", U.imported_domain_covers(h, root).alias("plain"), U.imported_domain_covers(F.concat(F.lit("."), h), root).alias("dotted"))


def import_cookies(spark, folder):
    df = _cookies(spark, folder).withColumns({"session_only": F.col("name") == "c1", "expires": F.lit(1800000000).cast("bigint")})
    return browser.imported_cookies(df, ["docs.bobabe.invalid", "test"])[0].select("name", "domain", "path", "value", "expires", "http_only")


def _events(spark, folder):
    """Browser events drawn from crawl items: the kind from the depth, the target from the item."""
    df = _read(spark, folder, "crawl_items").where("url is not null and crawl_id is not null and item_index is not null").groupBy("crawl_id", "item_index").agg(F.min("url").alias("url"), F.min("depth").alias("depth"))
    method = F.when(F.col("depth") == 1, "Page.frameScheduledNavigation").when(F.col("depth") == 3, "Page.javascriptDialogOpening").otherwise("Page.loadEventFired")
    return df.select(F.col("crawl_id").alias("run"), F.col("item_index").alias("pos"), method.alias("method"), F.to_json(F.struct("url")).alias("params"), F.lit("https://docs.bobabe.invalid/").alias("start_url"), F.lit("t1").alias("target_id"))


def browser_events(spark, folder):
    return browser.tracked_events(_events(spark, folder)).select("run", "pos", "method")


def browser_hazards(spark, folder):
    return browser.hazards(_events(spark, folder))


def browser_targets(spark, folder):
    df = _read(spark, folder, "batch_items").where("item_index is not null and batch_id is not null").groupBy("batch_id", "item_index").agg(F.min(F.coalesce("url", F.lit(""))).alias("url"))
    df = df.select(F.col("batch_id").alias("run"), F.col("item_index").alias("pos"), F.when(F.col("item_index") % 3 == 0, "iframe").otherwise("page").alias("type"), "url", F.concat(F.lit("t"), F.col("item_index").cast("string")).alias("target_id"))
    return browser.preferred_target(df)


def screenshot_warnings(spark, folder):
    df = _read(spark, folder, "source_pages").select("page_id", F.array().cast("array<string>").alias("warnings"), "content_format")
    return browser.screenshot_warnings(df, F.coalesce(F.col("content_format") == "json", F.lit(False))).select("page_id", F.size("warnings").cast("bigint").alias("warnings"))


def action_rows(spark, folder):
    """Rows of each run up to its first failure."""
    df = _read(spark, folder, "crawl_items").where("crawl_id is not null and item_index is not null").groupBy("crawl_id", "item_index").agg(F.max("status").alias("status"))
    return actions.until_failure(df, "crawl_id", "item_index").select("crawl_id", "item_index", "status")


def plan_dry_run(spark, folder):
    df = _read(spark, folder, "source_artifacts").select("artifact_id", F.to_json(F.struct(F.lit(actions.VERSION).alias("schema_version"), F.array(F.struct(F.lit("wait").alias("type"), F.lit(5).alias("duration_ms")), F.struct(F.lit("wait").alias("type"), (F.col("artifact_id") % 7).alias("duration_ms"))).alias("actions"))).alias("plan"))
    return actions.dry_run(df, "plan", "artifact_id")


def plan_redaction(spark, folder):
    """Plans that type a word of each artifact's address, sensitive for sensitive artifacts."""
    word = F.regexp_extract(F.coalesce("url", F.lit("")), "/([a-z]+)-", 1)
    plan = F.to_json(F.struct(F.lit(actions.VERSION).alias("schema_version"), F.array(F.struct(F.lit("type").alias("type"), F.lit("input").alias("selector"), word.alias("text"), F.coalesce("sensitive", F.lit(False)).alias("sensitive"))).alias("actions")))
    out = actions.validate_plans(_read(spark, folder, "source_artifacts").select("artifact_id", plan.alias("plan")))
    return out.select("artifact_id", "ok", F.get_json_object("redacted", "$.actions[0].text").alias("text"), F.get_json_object("redacted", "$.actions[0].text_chars").cast("bigint").alias("text_chars"))


def consent_checks(spark, folder):
    df = _read(spark, folder, "crawl_items").where("crawl_id is not null").select("crawl_id", "item_index", F.lit("{}").alias("plan"), F.when(F.col("depth") == 2, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sessions"), (F.col("depth") == 1).alias("current_tab"), F.when(F.col("status") == "failed", 9222).alias("port"))
    return privacy.consent_errors(df).groupBy("consent_error").agg(F.count("*").alias("rows"))


def safe_errors(spark, folder):
    df = _read(spark, folder, "batch_items").select("batch_id", "item_index", F.col("error").alias("message"), (F.col("batch_id") % 2 == 0).alias("sensitive"))
    return privacy.safe_error(df).groupBy("message").agg(F.count("*").alias("rows"))


def secrets(spark, folder):
    c = _cookies(spark, folder).groupBy("session").agg(F.array_sort(F.collect_set(F.struct("value"))).alias("cookies"))
    s = _storage(spark, folder).groupBy("session").agg(F.array_sort(F.collect_set(F.struct("value"))).alias("storage"))
    return c.join(s, "session").select("session", F.explode(privacy.secret_values(F.col("cookies"), F.col("storage"))).alias("secret"))


def artifacts_delete(spark, folder):
    return artifacts.delete(_runs(spark, folder), ["run-1", "run-7", "run-100"], confirmed=True).select("run_id")


def cache_store(spark, folder):
    """Entries of the first half-month, with those fetched later in their place."""
    entry = _requests(spark, folder).select("key", F.col("at").alias("created_at"), "content", F.lit(1).alias("schema_version"))
    cut = F.col("created_at") < F.unix_timestamp(F.lit("2026-01-15 00:00:00").cast("timestamp"))
    return cache.store(cache.latest_entries(entry.where(cut)), entry.where(~cut)).select("key", "created_at", F.char_length("content").cast("bigint").alias("chars"))


def extract_provenance(spark, folder):
    wanted = [fields.Field("site", "metadata", path="$.site"), fields.Field("heads", "headings")]
    out = _extract(wanted, ("markdown", "html", "text"), rows=False)(spark, folder)
    return out.select("page_id", F.posexplode("provenance").alias("pos", "p")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "p.field", "p.kind", "p.source_url", "p.path")


def metadata_records(spark, folder):
    return _read(spark, folder, "source_artifacts").select("artifact_id", sinks.metadata_json(["artifact_id", "sensitive", "url"]).alias("record"))


def error_records(spark, folder):
    df = _read(spark, folder, "batch_items").where("error is not null").select("batch_id", "item_index", sinks.error_record(F.lit("extraction_failed"), F.col("status")).alias("record"))
    return df.distinct()


def debug_traces(spark, folder):
    return _read(spark, folder, "source_artifacts").select("artifact_id", sinks.debug_trace(["artifact_id", "sensitive"]).alias("trace"))


def run_ids(spark, folder):
    return _read(spark, folder, "source_artifacts").select("artifact_id", sinks.run_id(F.col("artifact_id").cast("string"), F.coalesce("url", F.lit("")), suffix="-get").alias("run_id"))


def content_files(spark, folder):
    c = sinks.content_lines(F.col("content"))
    return _read(spark, folder, "source_artifacts").where("content is not null").select("artifact_id", F.sha2(c, 256).alias("digest"), F.octet_length(c).cast("bigint").alias("bytes"))


def _kept_links(spark, folder):
    return links.filter_links(_link_table(spark, folder), any_path=True, max_links=5)


def links_report(spark, folder):
    return sinks.links_markdown(_kept_links(spark, folder), "source_url").select("source_url", "report")


def links_report_json(spark, folder):
    """The JSON reports, read again."""
    read = F.from_json("report", "array<struct<url:string,text:string,same_origin:boolean,same_path:boolean,content_type:string>>")
    return sinks.links_json(_kept_links(spark, folder), "page_id").select(F.col("page_id").alias("source_url"), F.posexplode(read).alias("pos", "link")).select("source_url", F.col("pos").cast("bigint").alias("pos"), "link.*")


def records_report(spark, folder):
    out = _extract([fields.Field("status", "json", path="status")], ("json",), rows=False)(spark, folder)
    return out.select("page_id", sinks.records_markdown().alias("report"), F.get_json_object(sinks.records_json(), "$.values.status").alias("status"))


def batch_unsupported(spark, folder):
    return batch.unsupported(_batch(spark, folder)).select("batch_id", "item_index", "url")


def batch_manifest_lines(spark, folder):
    items = batch.dedupe(_batch(spark, folder), index="item_index", run="batch_id")
    return batch.manifest_lines(items, "batch_id", "item_index").select("batch_id", "index", "item_md")


def url_list(spark, folder):
    """The URLs of all batches as the lines of one list, in the order of batch and item."""
    df = _batch(spark, folder).select(F.concat(F.lit("  "), F.coalesce("url", F.lit("# none"))).alias("value"), (F.col("batch_id") * 1_000_000 + F.col("item_index")).alias("at"))
    return batch.url_lines(df, "value", "at")


def glob_matches(spark, folder):
    u = F.col("url")
    return _read(spark, folder, "links").where("url is not null").select("url", U.glob_match(F.lit("*/docs/*"), u).alias("inside"), U.glob_match(F.lit("*.pdf"), u).alias("ends"), U.glob_match(F.lit("guide"), u).alias("holds")).distinct()


def crawl_scope(spark, folder):
    scope = crawl.Scope("https://docs.bobabe.invalid/guide/index.html", same_path=True, allow_domains=("katroko.test",), exclude=(".pdf",))
    u = U.without_fragment(F.col("url"))
    return _read(spark, folder, "links").where("url is not null").select(u.alias("url"), F.coalesce(scope.condition(u), F.lit(False)).alias("admitted")).distinct()


def crawl_manifest(spark, folder):
    """The manifest of the items of the smallest crawl id, each place once."""
    df = _read(spark, folder, "crawl_items").where("crawl_id is not null and item_index is not null")
    first = df.agg(F.min("crawl_id").alias("c"))
    items = df.join(F.broadcast(first), df["crawl_id"] == first["c"]).groupBy(F.col("item_index").alias("index")).agg(*(F.min(c).alias(c) for c in ("url", "final_url", "depth", "source_url", "status", "error")))
    return crawl.crawl_manifest(items.orderBy("index").limit(100), "https://docs.bobabe.invalid/", 100).select("manifest_md")


def stored_runs(spark, folder):
    """Artifacts as stored runs; every fourth lies outside the store, every fifth has failed."""
    df = _read(spark, folder, "source_artifacts")
    path = F.concat(F.when(F.col("artifact_id") % 4 == 0, "/store/../other/").when(F.col("artifact_id") % 4 == 1, "/store/./runs//").otherwise("/store/runs/"), F.col("artifact_id").cast("string"))
    runs = df.select("artifact_id", (F.col("artifact_id") % 5 != 0).alias("ok"), F.lit("get").alias("command"), "sensitive", path.alias("content_path"))
    texts = df.where("content is not null").select(path.alias("content_path"), "content")
    return readers.run_sources(runs, texts, "/store").select("artifact_id", F.char_length("content").cast("bigint").alias("chars"))


def manifest_items(spark, folder):
    """Batch items as a manifest whose records are missing for every third item."""
    items = _batch(spark, folder).where("url is not null and item_index is not null").select((F.col("batch_id") * 1_000_000 + F.col("item_index")).alias("index"), "url", F.concat(F.lit("/store/./"), F.col("batch_id").cast("string"), F.lit("/"), F.col("item_index").cast("string")).alias("content_path"))
    metadata = items.where("index % 3 <> 0").select(F.replace("content_path", F.lit("/./"), F.lit("/")).alias("content_path"), F.col("url").alias("final_url"), F.lit("markdown").alias("content_format"), F.lit(None).cast("boolean").alias("sensitive"))
    contents = items.select("content_path", F.length("url").cast("string").alias("content"))
    good = readers.manifest_sources(items, metadata, contents).select("index", "content", F.lit(None).cast("string").alias("error"))
    return good.unionByName(readers.manifest_errors(items, metadata).select("index", F.lit(None).cast("string").alias("content"), F.lit("missing").alias("error")))


def prune_result(spark, folder):
    """What a dry run of pruning by number and size would delete."""
    return artifacts.prune_result(_runs(spark, folder), keep_last=25)[1]


def file_entries(spark, folder):
    """The files of each artifact's run; the content of every third lies elsewhere, every fourth is gone."""
    df = _read(spark, folder, "source_artifacts")
    name = F.concat(F.lit("run-"), F.col("artifact_id").cast("string"))
    content = F.when(F.col("artifact_id") % 3 == 0, F.concat(F.lit("/other/./"), name)).otherwise(F.concat(F.lit("/store/"), name, F.lit("/content.md")))
    runs = df.select(name.alias("run_id"), F.to_json(F.struct(F.struct(content.alias("content"), F.array(F.concat(F.lit("/store/"), name, F.lit("/../trace.json"))).alias("debug")).alias("artifacts"))).alias("metadata"))
    files = df.where("artifact_id % 4 <> 0").select(content.alias("path"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("size_bytes"))
    return artifacts.file_entries(runs, files, "/store")


def finalize(spark, folder):
    """Records of artifacts that are there as text, in their last form; the parts that SQL can give."""
    df = _read(spark, folder, "source_artifacts").where("content is not null")
    extracted = df.select("artifact_id", F.coalesce("sensitive", F.lit(False)).alias("sensitive"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), "url", F.coalesce("final_url", "url").alias("final_url"), "content", F.lit(None).cast("map<string,string>").alias("page_metadata"), F.octet_length("content").cast("bigint").alias("source_bytes"), F.lit(False).alias("needs_render"))
    done = pages.finalize(extracted, max_chars=500, debug=True, keep=("artifact_id",))
    read = lambda path, kind: F.get_json_object("envelope", path).cast(kind)
    return done.select("artifact_id", F.substring("content", 1, 40).alias("start"), read("$.data.limits.chars_before", "bigint").alias("chars_before"), read("$.data.usage.estimated_tokens", "bigint").alias("tokens"), F.get_json_object("envelope", "$.data.content").isNotNull().alias("inline"), F.get_json_object("debug_trace", "$.source_bytes").cast("bigint").alias("traced"))


def extract_actions(spark, folder):
    """Extract actions on html pages: every third found no element, every fifth page was gone."""
    df = _read(spark, folder, "source_pages").where("content_format = 'html' and content is not null")
    html = F.when((F.col("page_id") % 3 != 0) & (F.col("page_id") % 5 != 0), F.lit("<article><p>Seen</p></article>"))
    seen = df.select("page_id", "url", html.alias("html"), F.when(F.col("page_id") % 3 == 0, "h1").alias("selector"))
    return actions.extract_results(seen, Options(format="text"), by="page_id").select("page_id", "ok", "content", F.col("error.code").alias("code"))


def _streamed(df: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all files at hand, written to the shared folder batch by batch and read again."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{place}/rows/b{number:09d}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema.add("batch", LongType())).parquet(f"{place}/rows/*")


def stream_extract(spark, folder):
    """Extraction of the html pages as a stream."""
    pages_ = stream.read_pages(spark, f"{folder}/source_page[s].parquet").where("content_format = 'html'")
    return _streamed(stream.extract_stream(pages_, Options(format="text"), keep=("page_id",))).select("page_id", "ok", "source_bytes")


def stream_dedupe(spark, folder):
    pages_ = stream.read_pages(spark, f"{folder}/source_page[s].parquet").where("arrived_at is not null").select("url", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    return _streamed(stream.latest_urls(pages_)).select("url")


def stream_windows(spark, folder):
    """Pages by the day of their arrival; of a window's updates the last counts."""
    pages_ = stream.read_pages(spark, f"{folder}/source_page[s].parquet").select(F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    rows = _streamed(stream.counts(pages_, window="1 day", delay="60 days"), "update")
    return rows.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max_by("pages", "batch").alias("pages"))


QUERIES = {f.__name__: f for f in (
    storage_compose, storage_conflicts, storage_filter, login_merge, login_merge_storage, cookie_events, cookie_records, cookie_dedupe, candidate_origins, login_domains, import_domains, import_cookies,
    browser_events, browser_hazards, browser_targets, screenshot_warnings, action_rows, plan_dry_run, plan_redaction, consent_checks, safe_errors, secrets, artifacts_delete, cache_store, extract_provenance,
    metadata_records, error_records, debug_traces, run_ids, content_files, links_report, links_report_json, records_report, batch_unsupported, batch_manifest_lines, url_list, glob_matches, crawl_scope, crawl_manifest, stored_runs, manifest_items, prune_result, file_entries, finalize, extract_actions, stream_extract, stream_dedupe, stream_windows,
)}
