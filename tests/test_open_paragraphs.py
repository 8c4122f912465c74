"""Pages whose paragraphs are left open with an inline element in them: queries give the whole article, as their SQL does."""

import duckdb
import pytest

from quire.operators import article
from quire.plans import catalogue, documents, more, rewriting, trees, wider  # noqa: F401

LONG = "Many words of prose, one after another, that go on and on. " * 12


def page(title, *paragraphs):
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body><nav><a href='/'>Home</a></nav><article><h1>{title}</h1>{''.join(paragraphs)}</article><footer>f</footer></body></html>"


OPEN, SHUT = "<p><b>{}<br>", "<p>{}</p>"
PAGES = [
    # the lead stands before paragraphs that stay open, one in another
    ("https://a.example.org/1", page("The same lead", OPEN.format("The same lead, and little more."), *[SHUT.format("In short."), OPEN.format("In short.")] * 3, *[SHUT.format(LONG)] * 6)),
    # a title is cut at the bar, so the heading stays
    ("https://a.example.org/2", page("A long title | a site", OPEN.format("An opening."), *[SHUT.format("Words without a stop. " * 15)] * 6)),
    ("https://b.example.org/3", page("A plain page", SHUT.format(LONG), SHUT.format("An end."))),
    # with its lead an article is no summary
    ("https://b.example.org/4", page("A page of two", OPEN.format("Lead words. " * 60), *[OPEN.format("In short.")] * 3, *[SHUT.format("Words, words, and words again, and more.")] * 8)),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES, 1)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def same(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet/*.parquet')")
    want = con.execute(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_votes_pass_by_open_paragraphs():
    lead, last = "A lead that is long enough to count.", "The last words, which are long enough, too, and more, and more."
    got = article.extract(f"<html><body><div><h2>Head</h2>{OPEN.format(lead)}{SHUT.format('x')}{OPEN.format('y')}{OPEN.format(last)}{SHUT.format(LONG) * 6}</div></body></html>")["html"]
    assert "Head" in got and lead in got and last in got
    # an inline element around whole paragraphs, and a list in an open one, hold what stands in them
    f = article.Fragment("<div><span><p>a</p></span><p><b>b<ul><li>c</li></ul></div>")
    up = article.holders(f)
    assert [f.tag[up[i]] for i in f.find("p", "ul", "li")] == ["span", "div", "div", "ul"]


def test_article_texts(spark, sf):
    same(spark, sf, "article_texts")


def test_site_books(spark, sf):
    same(spark, sf, "site_books")


def test_short_item_tallies(spark, sf):
    same(spark, sf, "short_item_tallies")


def test_short_item_tallies_count_each_row_once(spark, sf, tmp_path):
    """A page_id that comes again, with the same page or another, or is null, is a row like any other."""
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    again = rows.filter("page_id < 4").unionAll(rows.selectExpr("page_id % 2 + 2", "url", "html").filter("url like '%b.example.org%'")).unionAll(rows.selectExpr("null", "url", "html").limit(2))
    rows.unionAll(again).write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, str(tmp_path), "short_item_tallies")
