"""Sources of pages: tables, files, inline texts, URL lists, stored runs, manifests, and HTTP."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.paths import plain_path


def table_pages(spark: SparkSession, path: str, url: str = "url", html: str = "content", where: str | None = None) -> DataFrame:
    """``(url, html)`` of a Parquet table of rendered pages; ``where`` is pushed to the scan."""
    df = spark.read.parquet(path)
    return (df.where(where) if where else df).select(F.col(url).alias("url"), F.col(html).alias("html"))


def file_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(url, html)`` of whole UTF-8 files; the URL is the file's own, with two slashes and the path."""
    return spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "file:///").alias("url"), F.col("value").alias("html"))


def inline_pages(df: DataFrame, text: str = "input") -> DataFrame:
    """``(url, html)`` of inputs that hold the document behind ``raw:`` or ``raw://``."""
    return df.where(F.col(text).startswith("raw:")).select(F.col(text).alias("url"), F.regexp_replace(text, r"(?s)^raw:(?://)?", "").alias("html"))


def url_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(index, url)`` of the lines of URL lists, blank lines and comments dropped."""
    from ..operators.batch import url_lines

    return url_lines(spark.read.text(paths))


def run_sources(runs: DataFrame, contents: DataFrame, root: str, allow_private: bool = False, only_get: bool = False, contained: bool = True) -> DataFrame:
    """Stored runs as sources: successful, content inside the store, sensitive ones only if allowed.

    ``runs`` has ``(run_id, ok, command, sensitive, content_path, url, final_url,
    content_format)``, ``contents`` ``(content_path, content)``. Paths are brought to plain
    form first; a search may also read content that lies elsewhere (``contained=False``).
    """
    home = root.rstrip("/") + "/"
    kept = runs.where(F.col("ok"))
    if contained:
        kept = kept.where(F.coalesce(plain_path(F.col("content_path")).startswith(home), F.lit(False)))
    if not allow_private:
        kept = kept.where(~F.coalesce(F.col("sensitive"), F.lit(False)))
    if only_get:
        kept = kept.where(F.col("command").isNull() | (F.col("command") == "get"))
    return kept.join(contents.select("content_path", "content"), "content_path")


def manifest_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Successful items with content of stored manifests: ``(index, url, content_path)``."""
    schema = "items array<struct<index:bigint,url:string,status:string,content_path:string>>"
    return spark.read.schema(schema).json(paths, multiLine=True).select(F.explode("items").alias("i")).where("i.status = 'ok' and i.content_path is not null").select("i.index", "i.url", "i.content_path")


def manifest_sources(items: DataFrame, metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """``(index, url, final_url, content_format, sensitive, content)`` of manifest items with the records of their runs.

    ``items`` as ``manifest_items`` gives them, ``metadata`` has ``(content_path, final_url,
    content_format, sensitive)``, one row an item. An item whose record names another
    content path, or none, is not the manifest's own and is left out; ``manifest_errors``
    has these.
    """
    record = metadata.select(plain_path(F.col("content_path")).alias("__path"), "final_url", "content_format", F.coalesce("sensitive", F.lit(False)).alias("sensitive"))
    text = contents.select(plain_path(F.col("content_path")).alias("__path"), "content")
    return items.withColumn("__path", plain_path(F.col("content_path"))).join(record, "__path").join(text, "__path").select("index", "url", "final_url", "content_format", "sensitive", "content")


def manifest_errors(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(index, url, error)`` of what a manifest promises and doesn't hold; an empty manifest is an error with neither."""
    known = metadata.select(plain_path(F.col("content_path")).alias("__path")).distinct()
    missing = items.withColumn("__path", plain_path(F.col("content_path"))).join(known, "__path", "left_anti").select("index", "url", F.lit("the record of this item names no such content").alias("error"))
    empty = items.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("string").alias("url"), F.lit("the manifest has no successful items").alias("error"))
    return missing.unionByName(empty)


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = 5


def fetch(df: DataFrame, url: str = "url", user_agent: str = "pagelake/0.1", timeout: float = 60.0, concurrency: int | None = None) -> DataFrame:
    """``(url, final_url, html, status, error)`` by HTTP GET; any status has a body, at most five redirects.

    Rows are spread by URL; each task fetches its rows one by one, so ``concurrency`` tasks
    are at most so many requests at a time. Only http(s) is fetched.
    """
    if concurrency is not None and concurrency < 1:
        raise ValueError("concurrency must be at least 1")

    def one(opener: urllib.request.OpenerDirector, target: str) -> tuple:
        try:
            with opener.open(urllib.request.Request(target, headers={"User-Agent": user_agent}), timeout=timeout) as r:
                return r.geturl(), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status, None
        except urllib.error.HTTPError as r:
            if 300 <= r.code < 400:
                return target, None, r.code, "too many redirects"
            return r.geturl(), r.read().decode("utf-8", "replace"), r.code, None
        except (OSError, ValueError) as error:
            return target, None, None, str(error)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = urllib.request.build_opener(_Redirects)
        for batch in batches:
            targets = batch.column(0).to_pylist()
            rows = [one(opener, t) for t in targets]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.string())))], ["url", "final_url", "html", "status", "error"])

    return df.where(U.input_kind(F.col(url)) == "http").select(F.col(url).alias("url")).repartition(*([concurrency] if concurrency else []), "url").mapInArrow(run, "url string, final_url string, html string, status int, error string")
