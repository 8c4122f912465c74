"""Snapshots that hold an address more than once: every visit that is asked for is read, and none twice."""

import pytest

from quire.functions import tree
from quire.operators import article, crawl, snapshot
from quire.sources import feeds
from tests.test_crawl import PROSE, page, rss
from tests.test_open_paragraphs import same

A = "https://a.example.org"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Two addresses with two pages each: one page of the first refuses, both of the second are there."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(6, f"{A}/1", "Now refused"), (7, f"{A}/1", "Seen at first"), (8, f"{A}/2", "An older title"), (9, f"{A}/2", "A newer title"), (13, f"{A}/3", "Refused"), (20, f"{A}/3", "Refused again")]
    spark.createDataFrame([(i, u, page(t)) for i, u, t in rows], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def test_snapshot_warnings(spark, sf):
    same(spark, sf, "snapshot_warnings")


def test_visits_of_a_snapshot(spark):
    web = spark.createDataFrame([
        (f"{A}/p", 1, 200, "text/html", page("First")), (f"{A}/p", 2, 404, "text/html", None), (f"{A}/p", 3, 200, "text/html", page("Third")),
        (f"{A}/feed", 1, 200, "text/xml", rss(A, [("Old", f"{A}/p", PROSE, "")])), (f"{A}/feed", 2, 200, "text/xml", rss(A, [("New", f"{A}/p", "short", "")])),
    ], "url string, visit long, status int, content_type string, text string").selectExpr("*", "string(null) final_url")
    asks = [("b", i, f"{A}/p", v) for i, v in enumerate((1, 2, 3, 9))]
    out = crawl.ingest(spark.createDataFrame(asks, "book_id string, pos long, url string, visit long"), web)
    assert [(r.request, r.title) for r in out.chapters.orderBy("pos").collect()] == [(0, "First"), (2, "Third")]
    assert [(r.request, r.message) for r in out.warnings.orderBy("request").collect()] == [(1, f"{A}/p: HTTP Error 404"), (3, f"{A}/p: not in the snapshot")]
    # without a visit it is the last one, for what is asked and for the pages of a feed's items
    out = crawl.ingest(spark.createDataFrame([("b", 0, f"{A}/p"), ("b", 1, f"{A}/feed"), ("b", 2, None)], "book_id string, pos long, url string"), web)
    assert [(r.request, r.title, "long prose" in r.html) for r in out.chapters.orderBy("pos").collect()] == [(0, "Third", True), (1, "New", True)]


def test_snapshot_chapters(spark, sf):
    same(spark, sf, "snapshot_chapters")


def test_collected_citations(spark, sf):
    same(spark, sf, "collected_citations")


def test_a_page_and_its_article_are_parsed_once(monkeypatch):
    posts = "".join(f"<li><a href='{A}/post/{i}'>A post with a long title, number {i}</a></li>" for i in range(6))
    head = "<link rel='alternate' type='application/rss+xml' href='/feed'>"
    texts = [page("A title"), page("A list").replace("</title>", f"</title>{head}").replace("<article>", f"<article><ul>{posts}</ul>"), f"<html><head><title>t &amp</title>{head}</head><body><p><b>{PROSE}<img src='a.png'></body></html>", "", None]
    plain = []
    for t in texts:
        doc = article.extract(t, A)
        h = doc["html"]
        plain.append((doc["title"], h, tree.visible_length(h), tree.has_image(h), feeds.discover(t, A), snapshot.list_targets(h, A, crawl.U.INDEX_PATHS)))
    made, init = [], tree.Fragment.__init__
    monkeypatch.setattr(tree.Fragment, "__init__", lambda f, markup: (made.append(markup), init(f, markup))[1])
    got = [crawl.read_page(t, A) for t in texts]
    assert [(d["title"], d["html"], d["length"], d["image"], d["feeds"], d["targets"]) for d in got] == plain
    assert len(made) == 2 * len(texts) and any(d["feeds"] for d in got) and any(d["image"] for d in got)
