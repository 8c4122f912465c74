"""Requests over a small web of pages, feeds, lists and refusals."""

import pytest

from quire.operators import crawl

PROSE = "Some long prose, with commas, and with many words that go on, and on. " * 8


def page(title, body=PROSE, head="", extra=""):
    return f"<html><head><title>{title}</title>{head}</head><body><article><h1>{title}</h1><p>{body}</p>{extra}</article></body></html>"


def rss(site, items, title="The Feed"):
    each = "".join(f"<item><title>{t}</title><link>{link}</link><description>{text}</description><pubDate>{when}</pubDate></item>" for t, link, text, when in items)
    return f"<?xml version='1.0'?><rss version='2.0'><channel><title>{title}</title><link>{site}</link>{each}</channel></rss>"


DAYS = ["Mon, 06 Jan 2025 10:00:00 GMT", "Tue, 07 Jan 2025 10:00:00 GMT", "Wed, 08 Jan 2025 10:00:00 GMT"]
A = "https://a.example.org"
WEB = {
    f"{A}/post": (200, "text/html", page("A Post")),
    f"{A}/feed.xml": (200, "application/rss+xml", rss(A, [("Three", f"{A}/3", PROSE, DAYS[2]), ("One", f"{A}/1", "short", DAYS[0]), ("Two", f"{A}/2", "short too", DAYS[1]), ("Gone", f"{A}/gone", "stub", "")])),
    f"{A}/1": (200, "text/html", page("One")),
    f"{A}/2": (404, "text/html", None),
    "https://b.example.org/": (200, "text/html", page("Home", "x", '<link rel="alternate" type="application/rss+xml" href="/comments/feed"><link rel="alternate" type="application/atom+xml" href="/atom">')),
    "https://b.example.org/atom": (200, "application/atom+xml", "<feed xmlns='http://www.w3.org/2005/Atom'><title>B</title><entry><title>E1</title><link href='https://b.example.org/e1'/><content type='html'>" + PROSE + "</content><published>2025-01-01T00:00:00Z</published></entry></feed>"),
    "https://c.example.org/": (200, "text/html", page("C Home", "hardly anything")),
    "https://c.example.org/rss": (200, "text/xml", rss("https://c.example.org", [("Guessed", "https://c.example.org/g", PROSE, DAYS[0])])),
    "https://medium.com/@who/a-story-0123456789ab": (403, "", None),
    "https://medium.com/feed/@who": (200, "application/rss+xml", rss("https://medium.com/@who", [("Other", "https://medium.com/@who/other-aaaaaaaaaaaa", PROSE, DAYS[0]), ("Story", "https://medium.com/@who/a-story-0123456789ab", PROSE, DAYS[1])])),
    "https://www.lesswrong.com/posts/x/y": (429, "", None),
    "https://www.greaterwrong.com/posts/x/y": (200, "text/html", page("Mirrored")),
    "https://d.example.org/reading": (200, "text/html", page("Reading list", "All of it:", extra="<ul>" + "".join(f'<li><a href="https://d.example.org/p{i}">A long enough title number {i}</a>, and a remark on it of some words</li>' for i in range(6)) + "</ul>")),
    **{f"https://d.example.org/p{i}": (200, "text/html", page(f"Post {i}")) for i in range(5)},
    "https://e.example.org/shell": (200, "text/html", "<html><head><title>E</title></head><body><div></div></body></html>"),
    "https://f.example.org/p?id=7&utm_source=x": (200, "text/html", page("F", "tiny", '<link rel="alternate" type="application/rss+xml" href="/f.xml">')),
    "https://f.example.org/f.xml": (200, "application/rss+xml", rss("https://f.example.org", [("Not this", "https://f.example.org/p?id=8", PROSE, DAYS[0]), ("This", "http://f.example.org/p/?id=7", PROSE, DAYS[1])])),
}


@pytest.fixture(scope="module")
def web(spark):
    return spark.createDataFrame([(u, s, t, None, x) for u, (s, t, x) in WEB.items()], "url string, status int, content_type string, final_url string, text string")


def run(spark, web, urls, **how):
    asks = spark.createDataFrame([("book", i, u) for i, u in enumerate(urls)], "book_id string, pos long, url string")
    out = crawl.ingest(asks, web, **how)
    rows = out.chapters.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    return [(r.request, r.title, r.source) for r in rows], sorted(r.message for r in out.warnings.collect()), rows


def test_routes(spark, web):
    urls = [f"{A}/post", f"{A}/feed.xml", "https://b.example.org/", "https://c.example.org/", "https://medium.com/@who/a-story-0123456789ab", "https://www.lesswrong.com/posts/x/y", "https://d.example.org/reading", "https://e.example.org/shell", "https://f.example.org/p?id=7&utm_source=x", "https://nowhere.example.org/", f"{A}/2", None]
    got, told, rows = run(spark, web, urls)
    assert got == [
        (0, "A Post", f"{A}/post"),
        (1, "One", f"{A}/1"), (1, "Three", f"{A}/3"),
        (2, "E1", "https://b.example.org/e1"),
        (3, "Guessed", "https://c.example.org/g"),
        (4, "Story", "https://medium.com/@who/a-story-0123456789ab"),
        (5, "Mirrored", "https://www.lesswrong.com/posts/x/y"),
        *[(6, f"Post {i}", f"https://d.example.org/p{i}") for i in range(5)],
        (8, "This", "http://f.example.org/p/?id=7"),
    ]
    assert "long prose" in rows[1].html and rows[1].date == "2025-01-06T10:00:00Z"
    assert told == sorted([
        "https://nowhere.example.org/: not in the snapshot", f"{A}/2: HTTP Error 404",
        "https://medium.com/@who/a-story-0123456789ab: imported from its public feed", "https://www.lesswrong.com/posts/x/y: imported from a mirror",
        "https://d.example.org/reading: read as a list of posts; imported 5 linked posts as chapters", "https://d.example.org/p5: no readable article content",
        "https://e.example.org/shell: no readable article content found", "https://f.example.org/p?id=7&utm_source=x: the page held almost no content; imported this post from the site's feed",
        "skipping near-empty feed item: Two", "skipping near-empty feed item: Gone", f"2 of 3 short feed items kept their feed text (first: {A}/2: could not be fetched)",
    ])


def test_orders_and_limits(spark, web):
    titles = lambda **how: [t for _, t, _ in run(spark, web, [f"{A}/feed.xml"], **how)[0]]
    assert titles(order="keep") == ["Three", "One"] and titles(order="desc") == ["Three", "One"] and titles(max_items=1) == ["Three"]
    assert titles(fetch_full=False) == ["Three"]
    assert [t for _, t, _ in run(spark, web, ["https://d.example.org/reading"], max_items=2)[0]] == ["Post 0", "Post 1"]


def test_nothing_asked(spark, web):
    got, told, _ = run(spark, web, [])
    assert got == [] and told == []


def test_citations_and_sources(spark, web):
    links = spark.createDataFrame([(f"{A}/post#part",), (f"{A}/post#part",), (f"{A}/2",), (f"{A}/feed.xml",), ("",), (None,)], "url string")
    assert [tuple(r) for r in crawl.citations(links, web).collect()] == [(f"{A}/post#part", "A Post", None, None, "a.example.org")]
    rows = spark.createDataFrame([("b", 0, "T", "https://www.x.org/a", "Ann", None, "<h2>Own <b>head</b></h2>"), ("b", 1, "", "https://y.org", None, None, "<p>x</p>"), ("b", 2, "F", "file.md", None, None, "")], "book_id string, pos long, title string, source string, author string, date string, html string")
    assert [(r.url, r.title, r.site_name) for r in crawl.chapter_sources(rows).orderBy("pos").collect()] == [("https://www.x.org/a", "T", "x.org"), ("https://y.org", "https://y.org", "y.org")]
    assert [(r.title, r.numbered, r.raw) for r in crawl.matter(rows).orderBy("pos").collect()] == [("Own head", False, True), ("", False, True), ("", False, True)]
