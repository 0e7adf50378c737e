import datetime

import pytest

NOW = datetime.datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def pages(spark):
    """Builds source_pages rows from dicts, with a column whose name clashes with the operators' own."""

    def build(rows, more="key string, class string, n string, rank string"):
        schema = f"page_id bigint, url string, final_url string, content_format string, content string, {more}"
        names = ["page_id", "url", "final_url", "content_format", "content"]
        return spark.createDataFrame([(*(r.get(n) for n in names), "x", "x", "x", "x") for r in rows], schema)

    return build
