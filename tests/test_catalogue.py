"""Every query runs; those with SQL give DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalogue, documents, more, rewriting, trees, wider  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events", "benchmark", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.SQL:
        assert len(got) > 0
        return
    want = con.execute(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_feeds_hold_whole_pages(spark):
    from quire.functions import tree
    from quire.operators import article

    pages = {r.url: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = {u: tree.visible_length(article.clean_fragment(h)) for u, h in pages.items()}
    got = {r.link: r.length for r in catalogue.QUERIES["page_feeds"](spark, SF).collect() if not r.from_page}
    assert len(got) > len(pages) // 2 and got == {u: want[u] for u in got}
