"""Streams give what the same rows give as a table."""

import datetime

from pagelake.streaming import pages as S

SCHEMA = "url string, content string, arrived_at timestamp"


def _at(minute):
    return datetime.datetime(2026, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def _run(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def _folder(spark, tmp_path, name, parts, schema=SCHEMA):
    path = str(tmp_path / name)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_extraction_and_dedupe(spark, tmp_path):
    path = _folder(spark, tmp_path, "pages", [[("https://a.example", "<main><h1>A</h1></main>", _at(0)), ("https://a.example", "<h1>Again</h1>", _at(1))], [("https://b.example", None, _at(2))]])
    got = _run(spark, S.extract_stream(S.read_pages(spark, path), keep=("arrived_at",)).select("final_url", "ok", "content"), "extracted", tmp_path)
    assert ("https://a.example", True, "# A") in got and ("https://b.example", False, None) in got and len(got) == 3
    assert len(_run(spark, S.latest_urls(S.read_pages(spark, path)), "latest", tmp_path)) == 2


def test_windows_and_gaps(spark, tmp_path):
    path = _folder(spark, tmp_path, "counted", [[("u", "c", _at(m)) for m in (0, 10, 59, 61)], [("u", "c", _at(60 * 48))]])
    got = _run(spark, S.counts(S.read_pages(spark, path, 1), delay="1 hour"), "counted", tmp_path)
    assert sorted((r[0].hour, r[2]) for r in got if r[0].day == 1) == [(0, 3), (1, 1)]
    base = datetime.datetime(2026, 1, 1)
    events = [(1, base + datetime.timedelta(milliseconds=m)) for m in (0, 300, 700, 2000)] + [(1, base + datetime.timedelta(hours=1))]
    path = _folder(spark, tmp_path, "events", [events[:4], events[4:]], "run int, ts timestamp")
    got = _run(spark, S.quiet_gaps(S.read_pages(spark, path, 1), delay="1 second"), "gaps", tmp_path)
    assert sorted(r[3] for r in got)[:2] == [1, 3]


def test_cache(spark, tmp_path):
    parts = [[("k", _at(0)), ("j", _at(0))], [("k", _at(5))], [("k", _at(20))]]
    path = _folder(spark, tmp_path, "asked", parts, "key string, ts timestamp")
    got = _run(spark, S.cache_stream(S.read_pages(spark, path), ttl_seconds=600), "cached", tmp_path)
    assert sorted(got, key=str) == [("j", "miss", None), ("k", "hit", 300), ("k", "miss", None), ("k", "stale", 1200)]
