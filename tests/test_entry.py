"""The driver's contract on the smallest tables, where they are at hand."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.catalog.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.catalog.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = db.sql(sql)
    names = sorted(c[0] for c in found.description)
    assert names == sorted(df.columns)
    order = [[c[0] for c in found.description].index(n) for n in names]
    assert sorted(str([r[i] for i in order]) for r in found.fetchall()) == sorted(str([r[n] for n in names]) for r in rows)


def test_commands(spark, tmp_path, capsys):
    from pagelake.__main__ import parser, result

    run = lambda *argv: result(spark, parser().parse_args(list(argv)))
    pages = str(tmp_path / "pages")
    spark.createDataFrame([("https://a.example/", "<main><h1>Home</h1><a href='/b'>next</a></main>"), ("https://a.example/b", "<main><p>end</p></main>")], "url string, html string").write.parquet(pages)
    assert {r.content for r in run("get", pages, "--format", "text").collect()} == {"Home\nnext", "end"}
    assert run("get", "raw:<p>hi</p>").first().content == "hi"
    assert run("map", pages).first().url == "https://a.example/b" and run("map", pages, "--summary").count() == 2
    assert run("crawl", pages, "https://a.example/").count() == 2 and "Fetched: 2" in run("crawl", pages, "https://a.example/", "--manifest").first().manifest_md
    texts = str(tmp_path / "texts")
    spark.createDataFrame([(1, "https://a.example/", None, False, "# Soil\n\nDark soil.", "markdown", None)], "page_id bigint, url string, final_url string, sensitive boolean, content string, content_format string, metadata string").write.parquet(texts)
    assert run("search", texts, "soil").first().heading == "Soil" and run("extract", texts, "headings").first().ok and run("verify", texts, "--contains", "Dark").first().verified
    (tmp_path / "urls.txt").write_text("https://a.example/\nhttps://a.example/\n")
    assert run("batch", str(tmp_path / "urls.txt")).where("status = 'skipped'").count() == 1 and run("batch", str(tmp_path / "urls.txt"), "--manifest").first()["items"] == 2
    runs = str(tmp_path / "runs")
    spark.createDataFrame([(f"run-{i}", i * 100, 5, False, "https://a.example/") for i in range(4)], "run_id string, modified bigint, size_bytes bigint, sensitive boolean, url string").write.parquet(runs)
    assert run("artifacts", runs, "--now", "400").count() == 4 and run("artifacts", runs, "--now", "400", "--keep-last", "1").count() == 3 and run("artifacts", runs, "--now", "400", "--keep-last", "1", "--apply").count() == 1
    assert run("doctor").where("status = 'fail'").count() == 0
