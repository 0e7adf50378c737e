"""Sinks: content, records, manifests and reports, as Parquet or as text of fixed shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_id(*parts: Column, suffix: str = "") -> Column:
    """A repeatable run id from the hash of its parts; a retried task names the same run."""
    return F.concat(F.lit("run-"), F.substring(F.sha2(F.concat_ws("\1", *parts), 256), 1, 16), F.lit(suffix))


def metadata_json(columns: list[str]) -> Column:
    """One JSON record of the columns with sorted keys; nulls are written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def error_record(code: Column, message: Column) -> Column:
    """The record of a failed run: empty usage, limits and cache, and the error."""
    usage = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in ("content_bytes", "estimated_tokens")))
    limits = F.struct(F.lit(False).alias("truncated"), F.lit(0).cast("bigint").alias("chars_before"), F.lit(0).cast("bigint").alias("chars_after"))
    cache = F.struct(F.lit("disabled").alias("status"), F.lit(False).alias("eligible"))
    return F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(code.alias("code"), message.alias("message")).alias("error"), usage.alias("usage"), limits.alias("limits"), cache.alias("cache")))


def links_markdown(links: DataFrame, by: str) -> DataFrame:
    """``(by, report)``: ``- [text](url)`` lines sorted by URL; the text falls back to the URL. A page's links are at most 5,000."""
    line = F.struct(F.col("url"), F.concat(F.lit("- ["), F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("url")), F.lit("]("), F.col("url"), F.lit(")")).alias("line"))
    return links.groupBy(by).agg(F.sort_array(F.collect_list(line)).alias("all")).select(by, F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("report"))


def links_json(links: DataFrame, by: str) -> DataFrame:
    """``(by, report)``: a JSON array of a page's links, at most 5,000, sorted by URL."""
    one = F.struct("url", "text", "source_url", "same_origin", "same_path", "content_type")
    return links.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("report"))


def search_json(matches: DataFrame, by: str) -> DataFrame:
    """``(by, report)``: a JSON array of the matches, at most 50 a row, best first."""
    one = F.struct("rank", "section_id", "heading", "score", "snippet", "char_start", "char_end")
    return matches.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("report"))


def records_json(final_url: str = "final_url", values: str = "values_json", error: str = "error") -> Column:
    """One JSON record: where it comes from, the extracted values as they are, and the error if there is one."""
    head = F.to_json(F.struct(F.col(final_url).alias("final_url"), F.col(error).alias("error")))
    return F.concat(F.substring(head, 1, F.length(head) - 1), F.when(F.length(head) > 2, ",").otherwise(""), F.lit('"values":'), F.coalesce(F.col(values), F.lit("null")), F.lit("}"))


def search_markdown(matches: DataFrame, by: str) -> DataFrame:
    """``(by, report)``: a heading and a snippet for each match, best first. Matches are at most 50 a row."""
    one = F.struct("rank", F.concat(F.lit("## "), "heading", F.lit(" ("), "section_id", F.lit(")\n\n"), "snippet").alias("text"))
    return matches.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("all")).select(by, F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("report"))


def records_markdown(title: str = "final_url", values: str = "values_json") -> Column:
    """A heading and a fenced JSON block for each record."""
    return F.concat(F.lit("## "), F.col(title), F.lit("\n\n```json\n"), F.col(values), F.lit("\n```"))


def debug_trace(columns: list[str]) -> Column:
    """Control-plane facts of a run as JSON, with the version of the record."""
    return F.to_json(F.struct(F.lit("pagelake.debug_trace.v1").alias("schema_version"), *sorted(columns)))


def write_content(df: DataFrame, path: str, mode: str = "append") -> None:
    """Content rows as Parquet, unchanged; the text sinks add the final line feed themselves."""
    df.write.mode(mode).parquet(path)


def content_lines(content: Column) -> Column:
    """Content as it is written to a text file: with one line feed at its end."""
    return F.when(content.endswith("\n"), content).otherwise(F.concat(content, F.lit("\n")))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """One column as lines of text files; used for JSON records and reports."""
    df.select(F.col(column).alias("value")).where("value is not null").write.mode(mode).text(path)
