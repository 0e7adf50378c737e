"""Pages as a stream: incremental extraction, dedupe, windowed counts, quiet gaps and a TTL cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pages import get
from ..page import Options


def read_pages(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder (or of a pattern for single files) as they arrive; the schema comes from the files that are there."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def extract_stream(pages: DataFrame, options: Options = Options(), url_col: str = "url", html_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Extraction of a stream: the same stateless stage as for a table."""
    return get(pages, options, url_col, html_col, keep)


def latest_urls(pages: DataFrame, time: str = "arrived_at", delay: str = "1 day", url: str = "url") -> DataFrame:
    """The first row of each URL within the watermark; state older than ``delay`` is dropped."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def counts(pages: DataFrame, time: str = "arrived_at", window: str = "1 hour", slide: str | None = None, delay: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Pages per tumbling or sliding window; rows later than ``delay`` are left out."""
    return pages.withWatermark(time, delay).groupBy(F.window(time, window, slide).alias("w"), *by).agg(F.count("*").alias("pages")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "pages")


def quiet_gaps(events: DataFrame, time: str = "ts", by: str = "run", quiet: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Bursts of network events of each run: a burst ends when nothing happens for ``quiet``."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, quiet).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("idle_at"), "events")


CACHE_OUT = "key string, status string, age_seconds bigint"


def cache_stream(requests: DataFrame, ttl_seconds: int = 86_400, key: str = "key", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """``(key, status, age_seconds)`` of each request: a hit while the key's entry is younger than the TTL, else miss or stale, which store a new entry.

    State per key is one timestamp; it expires with the TTL on event time.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        created = state.get[0] if state.exists else None
        rows = sorted(int(t.timestamp()) for b in batches for t in b[time])
        out = []
        for now in rows:
            age = None if created is None else max(0, now - created)
            status = "miss" if age is None else "stale" if age >= ttl_seconds else "hit"
            out.append((keys[0], status, age))
            if status != "hit":
                created = now
        state.update((created,))
        state.setTimeoutTimestamp(max((created + ttl_seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["key", "status", "age_seconds"])
        yield frame.astype({"age_seconds": "Int64"})

    watermarked = requests.withWatermark(time, delay)
    return watermarked.groupBy(key).applyInPandasWithState(step, CACHE_OUT, "created long", "append", GroupStateTimeout.EventTimeTimeout)
