"""Keyword search over the sections of Markdown and text rows; Catalyst expressions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

_BEFORE_HEADING = r"(?<=\n)(?=[\p{IsWhite_Space}&&[^\n]]*#{1,6} )"
_HEADING = r"^[\p{IsWhite_Space}&&[^\n]]*#{1,6} "


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of two and more letters or digits, sorted."""
    return sorted({w.lower() for w in re.findall(r"[^\W_]+", query) if len(w) > 1})


def check_query(query: str, max_results: int, context_chars: int) -> None:
    if not query.strip():
        raise ValueError("the query must not be blank")
    if not 1 <= max_results <= 50:
        raise ValueError("max_results must be from 1 to 50")
    if not 1 <= context_chars <= 2000:
        raise ValueError("context_chars must be from 1 to 2000")


def section_array(content: Column) -> Column:
    """``array<struct<section_id, heading, text, char_start, char_end>>``: cut before each heading line; text before the first is ``Document``."""
    parts = F.filter(F.split(content, _BEFORE_HEADING), lambda p: F.length(p) > 0)
    kind = "array<struct<section_id:string,heading:string,text:string,char_start:bigint,char_end:bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def add(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        line = F.regexp_replace(F.substring_index(part, "\n", 1), "\r$", "")
        heading = F.when(part.rlike(_HEADING), F.regexp_replace(F.regexp_replace(line, r"^#+", ""), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")).otherwise("Document")
        one = F.struct(F.concat(F.lit("section-"), (F.size(acc["out"]) + 1).cast("string")).alias("section_id"), heading.alias("heading"), part.alias("text"), acc["at"].alias("char_start"), end.cast("bigint").alias("char_end"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, zero, add, lambda acc: acc["out"])


def sections(df: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a section, beside the kept columns; null and empty contents have none."""
    return spread(df.select(*keep, content)).select(*keep, F.inline(section_array(F.col(content))))


def _prepared(df: DataFrame) -> DataFrame:
    """Sections with their lower-case forms, and the structured lines (items, table rows, links) without their indent."""
    low = F.lower("text")
    lines = F.split(F.regexp_replace(low, r"(^|\n)[\p{IsWhite_Space}&&[^\n]]+", "$1"), "\n")
    structured = F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.contains("|") | x.contains("["))
    return df.withColumns({"__low": low, "__heading": F.lower("heading"), "__lines": structured})


def _containing(term: str) -> Callable[[Column], Column]:
    return lambda line: line.contains(term)


def score(query: str) -> Column:
    """Relevance of a section as ``_prepared`` gives it."""
    low, heading, text = query.lower(), F.col("__heading"), F.col("__low")
    total = F.when(heading.contains(low), 120).otherwise(0) + F.when(text.contains(low), 60).otherwise(0)
    for term in query_terms(query):
        hits = ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("bigint")
        lines = F.size(F.filter("__lines", _containing(term)))
        total = total + F.when(heading.contains(term), 30).otherwise(0) + F.least(hits, F.lit(8)) * 6 + F.least(lines, F.lit(4)) * 4
    return total.cast("bigint")


def snippet(query: str, context_chars: int) -> Column:
    """The text around the first match, with dots where it goes on."""
    text = F.col("__low")
    places = [F.nullif(F.instr(text, t), F.lit(0)) for t in [query.lower(), *query_terms(query)]]
    at = F.coalesce(F.array_min(F.array(*places)) - 1, F.lit(0))
    half = context_chars // 2
    start, end = F.greatest(at - half, F.lit(0)), F.least(at + half, F.char_length("text"))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(F.col("text"), start + 1, F.greatest(end - start, F.lit(0))), F.when(end < F.char_length("text"), "...").otherwise(""))
    return F.trim(F.regexp_replace(cut, r"\p{IsWhite_Space}+", " "))


def search(df: DataFrame, query: str, max_results: int = 8, context_chars: int = 240, key: str = "page_id", content: str = "content", allow_private: bool = False, sensitive: str | None = None) -> DataFrame:
    """The best sections of each row: score, then place. Sensitive rows are left out unless allowed.

    ``max_results`` is a top-k per row; its window has the row's own key, so a task holds
    one document's sections at a time.
    """
    check_query(query, max_results, context_chars)
    if sensitive and not allow_private:
        df = df.where(~F.coalesce(F.col(sensitive), F.lit(False)))
    scored = _prepared(sections(df, content, (key,))).withColumn("score", score(query)).where("score > 0").drop("__lines", "__heading")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "char_start"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= max_results)
    return best.select(key, F.col("rank").cast("bigint").alias("rank"), "section_id", "heading", "score", snippet(query, context_chars).alias("snippet"), "char_start", "char_end")
