"""Batches of URLs: input lines, dedupe, fail-fast and summaries, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .running import running_before


def url_lines(lines: DataFrame, value: str = "value", order: str | None = None) -> DataFrame:
    """``(index, url)`` of trimmed lines that are neither blank nor comments, numbered from 0 in the order of ``order``."""
    text = F.trim(F.regexp_replace(F.col(value), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
    kept = lines.select(text.alias("url"), (F.col(order) if order else F.monotonically_increasing_id()).alias("__order")).where("url <> '' and not startswith(url, '#')")
    # an id in the order of the file holds the number of its split above the 33rd bit
    return running_before(kept, [], F.lit(1), "__order", None if order else 1 << 33, name="index").select(F.col("index").cast("bigint").alias("index"), "url")


def unsupported(inputs: DataFrame, url: str = "url") -> DataFrame:
    """Inputs of a kind that can't be read; any row here fails the whole batch."""
    return inputs.where(U.input_kind(F.col(url)).isNull())


def _partition(run: str | None) -> list[str]:
    return [run] if run else []


def dedupe(inputs: DataFrame, url: str = "url", index: str = "index", run: str | None = None) -> DataFrame:
    """``status`` and ``reason``: the first place of a URL is pending, later ones are skipped as duplicates; places stay.

    The first place comes from an aggregate, so a URL with a third of all rows is
    combined before it is shuffled. Null URLs count as one.
    """
    keys = [*_partition(run), url]
    first = inputs.groupBy(*keys).agg(F.min(index).alias("__first"))
    first = first.select(*(F.col(k).alias(f"__{k}") for k in keys), "__first")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    test = same[0]
    for t in same[1:]:
        test = test & t
    again = F.col(index) > F.col("__first")
    out = inputs.join(first, test).withColumn("status", F.when(again, "skipped").otherwise("pending")).withColumn("reason", F.when(again, "duplicate"))
    return out.drop("__first", *(f"__{k}" for k in keys))


def fail_fast(items: DataFrame, failed: Column, concurrency: int = 2, index: str = "index", run: str | None = None) -> DataFrame:
    """``status`` and ``reason`` after fail-fast: once a chunk of ``concurrency`` fetched items holds a failure, all later chunks are skipped.

    ``items`` has ``status`` as ``dedupe`` gives it; ``failed`` says how the fetch would end.
    """
    if not 1 <= concurrency <= 8:
        raise ValueError("concurrency must be from 1 to 8")
    part = _partition(run)
    fetched = F.col("status") == "pending"
    out = items.withColumn("__failed", fetched & F.coalesce(failed, F.lit(False)))
    out = running_before(out, part, F.when(fetched, 1).otherwise(0), index, 10_000, name="__rank")
    out = out.withColumn("__chunk", F.when(fetched, F.floor(F.col("__rank") / concurrency)))
    stop = F.min(F.when(F.col("__failed"), F.col("__chunk"))).alias("__stop")
    # one row for each run
    out = out.withColumn("__run", F.struct(*part, F.lit(0)))  # null runs are equal
    out = out.join(out.groupBy("__run").agg(stop), "__run")
    skip = fetched & (F.col("__chunk") > F.col("__stop"))
    status = F.when(skip, "skipped").when(F.col("__failed"), "failed").when(fetched, "ok").otherwise(F.col("status"))
    reason = F.when(skip, "fail_fast").otherwise(F.col("reason"))
    return out.withColumns({"status": status, "reason": reason}).select(*items.columns)


def summary(items: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """Counts of a batch; ``ok`` means that nothing failed, skipped items don't matter."""
    counts = [F.count("*").alias("requested"), *(F.count_if(F.col(status) == s).alias(n) for s, n in (("ok", "succeeded"), ("failed", "failed"), ("skipped", "skipped")))]
    return items.groupBy(*(by or [])).agg(*counts).withColumn("ok", F.col("failed") == 0)


def manifest_lines(items: DataFrame, by: str, index: str = "index") -> DataFrame:
    """``(by, index, item_json, item_md)``: the lines of each run's manifest, for runs of any size."""
    one = F.to_json(F.struct(F.col(index).alias("index"), F.col("url"), F.col("status"), F.col("reason")))
    return items.select(by, F.col(index).alias("index"), one.alias("item_json"), F.concat(F.lit("- "), "status", F.lit(" `"), "url", F.lit("`")).alias("item_md"))


def manifest_parts(items: DataFrame, by: str, index: str = "index", max_items: int = 10_000) -> DataFrame:
    """``(by, part, parts, items, manifest_json, manifest_md)``: the documents of each run, whatever its size.

    A document has the run's summary and its items in order. A part, numbered from 1, holds
    up to ``max_items`` items, so a run within that has its documents in one row; the texts
    of a larger run's parts, joined in order with nothing between them, are its documents.
    ``items`` counts those of the whole run.
    """
    run = F.struct(F.col(by).alias("by"))  # compares null runs as equal
    item = F.struct(F.col(index).alias("index"), F.col("url"), F.col("status"), F.col("reason"))
    # places are from 0; items without one come first, as nulls do
    rows = items.select(run.alias("__run"), F.coalesce(F.col(index), F.lit(-1)).alias("__place"), item.alias("__item"))
    ranked = running_before(rows, ["__run"], F.lit(1), "__place", max_items, ["__item"], name="__rank")
    part = F.floor(F.col("__rank") / max_items)
    listed = ranked.groupBy("__run", part.alias("part")).agg(F.sort_array(F.collect_list("__item")).alias("all"))
    counts = items.groupBy(run.alias("__run")).agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "succeeded"), ("failed", "failed"), ("skipped", "skipped"))))
    # a row for each part, so that the lists of a large run are joined where they are
    counts = counts.withColumn("parts", F.floor((F.col("n") - 1) / max_items) + 1).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    out = listed.join(counts, ["__run", "part"])
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    summary_ = F.to_json(F.struct(F.struct(F.col("n").alias("requested"), "succeeded", "failed", "skipped").alias("summary")), {"pretty": "true"})
    doc = F.to_json(F.struct(F.col("all").alias("items")), {"pretty": "true"})
    opening, closing = '{\n  "items" : [ ', " ]\n}"
    body = doc.substr(F.lit(len(opening) + 1), F.length(doc) - len(opening) - len(closing))
    head = F.when(first, F.concat(summary_.substr(F.lit(1), F.length(summary_) - 2), F.lit(',\n  "items" : [ '))).otherwise(", ")
    line = F.transform("all", lambda i: F.concat(F.lit("- "), i["status"], F.lit(" `"), F.coalesce(i["url"], F.lit("")), F.lit("`")))
    md = F.concat(F.when(first, "").otherwise("\n"), F.array_join(line, "\n"))
    return out.select(F.col("__run")["by"].alias(by), (F.col("part") + 1).alias("part"), "parts", F.col("n").alias("items"), F.concat(head, body, F.when(last, closing).otherwise("")).alias("manifest_json"), md.alias("manifest_md"))
