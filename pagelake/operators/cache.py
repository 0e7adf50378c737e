"""The reusable result cache: keys, lookup with TTL and policy, and storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.urls import fnv1a64
from ..page import Options

POLICIES = ("auto", "refresh", "off")


def _text(url: str, options: Options) -> str:
    named = {"selector": options.selector, "exclude_selector": options.exclude_selector, "wait_for_selector": options.wait_for_selector}
    fields = [("v", "1"), ("url", url), ("format", options.format), *((k, v) for k, v in named.items() if v is not None)]
    for name, value in sorted((f"pagelake.{k}", str(v)) for k, v in options.values):
        fields += [("backend", name), ("value", value)]
    return "".join(f"{k}\0{v}\0" for k, v in fields)


def cache_key(url: str, options: Options = Options()) -> str:
    """The key of a request; it leaves out limits, output and sessions."""
    return fnv1a64(_text(url, options))


def key_column(url: Column, options: Options = Options()) -> Column:
    """``cache_key`` of each URL with the same options."""
    head, tail = _text("\1", options).split("\1")
    return U.fnv1a64_hex(F.concat(F.lit(head), url, F.lit(tail)))


def latest_entries(entries: DataFrame, key: str = "key", version: int = 1) -> DataFrame:
    """One entry a key: the newest of the current version; other versions and entries without content count as absent.

    A maximum over records, so that a hot key is combined before it is shuffled.
    """
    good = entries.where((F.col("schema_version") == version) & F.col("content").isNotNull())
    rest = [c for c in entries.columns if c not in (key, "created_at", "content")]
    best = good.groupBy(key).agg(F.max(F.struct("created_at", "content", *rest)).alias("__e"))
    return best.select(*(F.col(key) if c == key else F.col(f"__e.{c}").alias(c) for c in entries.columns))


def lookup(requests: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int = 86_400, policy: str = "auto", url: str = "url", key: str = "key") -> DataFrame:
    """Requests with ``cache_status``, ``cache_eligible``, ``age_seconds``, ``cache_reason`` and, on a hit, ``cached_content``.

    ``requests`` has ``key``, ``sensitive`` and ``screenshot``; ``entries`` one row a key
    with ``created_at`` (epoch seconds) and ``content``. An entry as old as the TTL is stale, so a TTL of 0 always is.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    bad = (
        F.when(F.lit(policy == "off"), F.struct(F.lit("disabled").alias("status"), F.lit("cache policy is off").alias("reason")))
        .when(F.coalesce(F.col("sensitive"), F.lit(False)), F.struct(F.lit("ineligible").alias("status"), F.lit("session-backed requests are not reusable").alias("reason")))
        .when(F.coalesce(F.col("screenshot"), F.lit(False)), F.struct(F.lit("ineligible").alias("status"), F.lit("screenshots need a live extraction").alias("reason")))
        .when(F.coalesce(~U.scheme(F.col(url)).isin("http", "https"), F.lit(True)), F.struct(F.lit("ineligible").alias("status"), F.lit("only http(s) URLs are cacheable").alias("reason")))
        .when(F.lit(policy == "refresh"), F.struct(F.lit("refresh").alias("status"), F.lit("fresh fetch requested").alias("reason")))
    )
    right = entries.select(F.col(key), F.col("created_at").alias("__created"), F.col("content").alias("__content"))
    age = F.greatest(F.lit(0).cast("bigint"), now.cast("bigint") - F.col("__created"))
    found = F.when(F.col("__created").isNull(), F.struct(F.lit("miss").alias("status"), F.lit("cache entry not found").alias("reason"))).when(age >= ttl_seconds, F.struct(F.lit("stale").alias("status"), F.lit("cache entry is stale").alias("reason"))).otherwise(F.struct(F.lit("hit").alias("status"), F.lit(None).cast("string").alias("reason")))
    out = requests.join(right, key, "left").withColumn("__bad", bad).withColumn("__state", F.coalesce("__bad", found))
    status = F.col("__state.status")
    looked_up = F.col("__bad").isNull()
    return out.withColumns({
        "cache_status": status, "cache_eligible": looked_up | (status == "refresh"), "ttl_seconds": F.lit(ttl_seconds).cast("bigint"), "age_seconds": F.when(looked_up & F.col("__created").isNotNull(), age),
        "cache_reason": F.col("__state.reason"), "cached_content": F.when(status == "hit", F.col("__content")),
    }).drop("__bad", "__state", "__created", "__content")


def store(entries: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``entries`` with those of ``new`` in place of the same keys."""
    return entries.join(new.select(key).distinct(), key, "left_anti").select(*entries.columns).unionByName(latest_entries(new, key).select(*entries.columns))
