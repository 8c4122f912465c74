"""Literal cases of rules that the sample tables can't show."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quire.functions import markdown, scalar, text, tree, url
from quire.operators import article, books, feeds, layout, links, notes, numbering, sinks
from quire.plans.documents import _sample_pdf
from quire.sources import feeds as feed_source
from quire.sources import files, pdf, word
from quire.streaming import limiter


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) else 'binary'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw,want", [("a  　b\x1cc ", "a b c"), ("​x", "​x"), ("", "")])
def test_white_space(spark, raw, want):
    assert one(spark, text.normalize_ws(F.col("a")), a=raw) == want == tree.fold(raw)


def test_every_letter_that_folds(spark):
    import sys

    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = [(c,) for c in letters if c.casefold() != c] + [(a + c + "𐐀z",) for a in "aßİ" for c in ("Σ", "ﬃ", "ᾳ", "q", "")] + [("",), (None,)]
    got = spark.createDataFrame(rows, "a string").select("a", text.folded(F.col("a")).alias("f")).collect()
    assert len(got) > 1500 and [r.f for r in got] == [None if a is None else a.casefold() for (a,) in rows]


def test_references_are_sorted_by_full_case_folding(spark):
    names = ["straße", "Strasse", "STRAßEN", "ﬁn", "Fin", "fim", "ΣΑΣ", "σας", "Σασ a", "İz", "iz", "Ῥώ", "ꭰ", "Ꭰ", "𐐀b", "𐐨a"]
    rows = [(b, i, n) for b in ("x", "y") for i, n in enumerate(names)]
    out = books.references(spark.createDataFrame(rows, "book string, tie int, n string"), "book", F.col("n"), "tie").collect()
    want = sorted(range(len(names)), key=lambda i: (names[i].casefold(), i))
    for b in ("x", "y"):
        assert [r.tie for r in sorted((r for r in out if r.book == b), key=lambda r: r.place)] == want


@pytest.mark.parametrize("raw,want", [("my-first_post 2", "My First Post 2"), ("iPhone--tips", "IPhone Tips"), ("__", "")])
def test_prettify(spark, raw, want):
    assert one(spark, text.prettify(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw,want", [("IV", 4), ("IIII", 4), ("IC", 99), ("MCMXCIV", 1994), ("12", 12), ("I", 1)])
def test_number_value(spark, raw, want):
    assert one(spark, text.number_value(F.col("a")), a=raw) == want


def test_paragraphs(spark):
    assert one(spark, text.text_to_html(F.col("a")), a="a\r\nb <c>\r\n \r\n\r\n d & e\n") == "<p>a b &lt;c&gt;</p>\n<p>d &amp; e</p>"
    assert one(spark, text.text_to_html(F.col("a")), a=None) == ""
    assert one(spark, text.word_count(F.col("a")), a="<p>one</p>two <b>three</b>") == 3


@pytest.mark.parametrize("raw,want", [("https://www.Example.ORG:80/x", "example.org"), ("http://u:p@a.b/", "a.b"), ("nonsense", ""), ("//cdn.x.org/a", "cdn.x.org")])
def test_host(spark, raw, want):
    assert one(spark, url.host_key(F.col("a")), a=raw) == want


def test_international_hosts(spark):
    import random

    hosts = ["bücher.example", "münchen.de", "straße.de", "例え.テスト", "пример.рф", "παράδειγμα.gr", "a.b", "", "x--ü.ö-ä.org", "ü", "ü.", "ü..x", "ñ" * 70 + ".es", "mañana.com", "𐐨a.org", "日本語。jp", "ümlaut.xn--bcher-kva.de", "üüüüü.ü", "אבג.קום", "مثال.إختبار"]
    r = random.Random(9)
    hosts += ["".join(r.choice("abz09äöüéñçшж中文字日ア한") for _ in range(r.randint(1, 30))) + ".org" for _ in range(300)]
    want = []
    for h in hosts:
        try:
            want.append(h.encode("idna").decode())
        except UnicodeError:
            want.append(h)
    rows = [(f"https://u:p@www.{h.upper() if i % 3 == 0 and h.upper().lower() == h else h}:80/a?b", h) for i, h in enumerate(hosts)]
    got = [r.k for r in spark.createDataFrame(rows, "u string, h string").select(url.site_key(F.col("u")).alias("k")).collect()]
    wrong = [(h, g, w) for h, g, w in zip(hosts, got, want) if g != w]
    assert not wrong
    back = [(h, g) for h, g in zip(hosts, got) if g != h and g.startswith("xn--") and h.count(".") == 1]
    assert len(back) > 200 and all(g.encode().decode("idna") == h.casefold().replace("。", ".") for h, g in back)


def test_item_key(spark):
    key = lambda u: one(spark, url.item_key(F.col("a")), a=u)
    assert key("https://E.org/a/?utm_source=x&p=1&ref=2") == key("http://e.org/a?p=1") != key("http://e.org/a?p=2")
    assert key("http://e.org") == key("https://e.org/")


@pytest.mark.parametrize("raw,want", [("https://e.org/Blog/", True), ("https://e.org", True), ("https://e.org/%62log", True), ("https://e.org/?p=1", False), ("https://e.org/a", False)])
def test_index(spark, raw, want):
    assert one(spark, url.is_index(F.col("a")), a=raw) is want


@pytest.mark.parametrize("a,b,want", [("a.org", "blog.a.org", True), ("a.org", "a.org", True), ("ba.org", "a.org", False), ("", "a.org", False)])
def test_same_site(spark, a, b, want):
    assert one(spark, url.same_site(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize("raw,want", [("Straße und Æon", "strae-und-on"), ("ﬁn Été!", "fin-ete"), ("", "book"), ("日本", "book"), ("x" * 80, "x" * 60)])
def test_slug(raw, want):
    assert scalar.slugify(raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [("Jane Doe", "Doe, J."), ("Jane Q. Doe", "Doe, J. Q."), ("By Jean-Paul Sartre", "Sartre, J.-P."), ("Vincent van Gogh", "van Gogh, V."), ("danah boyd", "danah boyd"), ("Ann Lee and Bo Chu", "Lee, A., & Chu, B."), ("Ann Lee, Bo Chu", "Lee, A., & Chu, B."), ("Doe, Jane", "Doe, Jane"), ("BBC News", "BBC News"), ("Plato", "Plato"), ("A B C D", "A B C D"), ("", None), (None, None)],
)
def test_byline(raw, want):
    assert scalar.byline(raw) == want


@pytest.mark.parametrize("raw,want", [("2026-07-14", "2026-07-14T00:00:00"), ("2026-07-14T10:00:00Z", "2026-07-14T10:00:00+00:00"), ("2026-07-14T10:00:00-0400", "2026-07-14T10:00:00-04:00"), ("July 4, 2020", "2020-07-04T00:00:00"), ("4 July 2020", "2020-07-04T00:00:00"), ("soon", None), (None, None)])
def test_dates(raw, want):
    assert scalar.iso_date(raw) == want


def test_bodies():
    assert scalar.decode_body("“é”".encode("cp1252"), "text/html; charset=iso-8859-1") == "“é”"
    assert scalar.decode_body('<meta charset="cp1251">да'.encode("cp1251"), "") == '<meta charset="cp1251">да'
    assert scalar.decode_body(b"\xff\xfe", "charset=nonsense") == "ÿþ"
    assert scalar.decode_data_uri("data:image/png;base64,aGk=") == (b"hi", "image/png") and scalar.decode_data_uri("data:,a%20b")[0] == b"a b"


def test_trees():
    assert tree.Fragment("a<p>b</p>c").words() == "ab c"
    assert tree.well_formed("<p>a<p>b<br><ul><li>x<li>y</ul></x><!-- c -->&lt;") == "<p>a</p><p>b<br /></p><ul><li>x</li><li>y</li></ul>&lt;"
    assert tree.visible_length("<style>x</style><p> a  b </p>") == 3
    assert not tree.has_image('<img width="1" height="1">') and tree.has_image('<img src="a">')


PAGE = """<html><head><title>A Fine Title Here | Site</title><meta property="og:site_name" content="Site"><meta name="author" content="Jane Doe">
<script type="application/ld+json">{"@graph": [{"@type": "BlogPosting", "datePublished": "2026-07-14"}]}</script></head><body><header>top</header><nav>menu</nav>
<article><h1>A Fine Title Here</h1>%s<div class="share"><a href="https://x.com/s">Share</a></div><img data-src="/lazy.png"><h2>Part</h2><p>See <a href="/more">more</a> and <a href="#gone">gone</a>.</p></article>
<div class="comments"><p>%s</p></div></body></html>""" % ("<p>Prose, with commas, and more of it, on and on, until it is long.</p>" * 5, "x " * 200)


def test_article():
    got = article.extract(PAGE, "https://e.org/a/b")
    assert got["title"] == "A Fine Title Here" and got["author"] == "Jane Doe" and got["date"] == "2026-07-14" and got["site_name"] == "Site"
    assert got["html"].count("<p>Prose") == 5 and 'href="https://e.org/more"' in got["html"] and 'src="https://e.org/lazy.png"' in got["html"]
    for gone in ("Share", "menu", "x x x", "#gone", "<h1", "class="):
        assert gone not in got["html"]
    assert article.extract(None)["title"] == "Untitled" and article.extract("")["html"] == ""


def test_clean_fragments():
    assert article.clean_fragment('hi <b>x</b><p></p><script>1</script><h1 id="a">T</h1>') == "<p>hi <b>x</b></p><h2>T</h2>"
    once = article.clean_fragment(PAGE)
    assert article.clean_fragment(once) == once


def test_chapters_of_markup():
    parts = article.split_chapters(markdown.to_html("pre\n\n# A *x*\n\none\n\n# B\n\n## C\n\ntwo\n\n# empty"), "Front")
    assert [t for t, _ in parts] == ["Front", "A x", "B"] and "<h2>C</h2>" in parts[2][1]


@pytest.mark.parametrize(
    "source,want",
    [
        ("# T #", "<h1>T</h1>"), ("T\n===", "<h1>T</h1>"), ("a\nb", "<p>a\nb</p>"), ("a  \nb", "<p>a<br />\nb</p>"), ("---", "<hr />"), ("> q\nlazy", "<blockquote>\n<p>q\nlazy</p>\n</blockquote>"),
        ("```py\nx<1\n```", '<pre><code class="language-py">x&lt;1</code></pre>'), ("    code", "<pre><code>code</code></pre>"), ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
        ("3. a", '<ol start="3">\n<li>a</li>\n</ol>'), ("**b** *i* ~~d~~ `c*`", "<p><strong>b</strong> <em>i</em> <del>d</del> <code>c*</code></p>"), ("[l](http://e.org)", '<p><a href="http://e.org">l</a></p>'),
        ("<https://e.org>", '<p><a href="https://e.org">https://e.org</a></p>'), (r"\*x\*", "<p>*x*</p>"), ("a < b & c", "<p>a &lt; b &amp; c</p>"), ("x<sup>2</sup>", "<p>x<sup>2</sup></p>"), ("snake_case_name", "<p>snake_case_name</p>"), ("", ""),
    ],
)
def test_markdown(source, want):
    assert markdown.to_html(source) == want


def test_markdown_tables_and_lists():
    assert markdown.to_html("| A | B |\n|:--|--:|\n| 1 | 2 | 3 |") == '<table>\n<thead>\n<tr><th style="text-align:left">A</th><th style="text-align:right">B</th></tr>\n</thead>\n<tbody>\n<tr><td style="text-align:left">1</td><td style="text-align:right">2</td></tr>\n</tbody>\n</table>'
    assert tree.Fragment(markdown.to_html("- a\n  - b\n    - c\n- d")).line() == "a b c d"


RSS = '<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>T</title><link>https://e.org</link><item><title>A &amp;amp; B</title><link>https://e.org/a</link><content:encoded>&lt;p&gt;x&lt;/p&gt;</content:encoded><pubDate>Tue, 14 Jul 2026 10:00:00 +0200</pubDate></item><item><title>C</title></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><author><name>Ann</name></author><entry><title>E</title><link href="https://f.org/e"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>hi</p></div></content><published>2026-01-02T03:04:05Z</published></entry></feed>'


def test_feeds(spark):
    rows = spark.createDataFrame([(1, RSS), (2, ATOM), (3, "<html/>"), (4, None), (5, "<!DOCTYPE x [<!ENTITY a 'b'>]>" + RSS)], "id long, text string")
    got = {}
    for r in feed_source.feed_items(rows, "id", "text").collect():
        got.setdefault(r.id, []).append(r)
    assert [r.title for r in got[1]] == ["A & B", "C"] and got[1][0].html == "<p>x</p>" and got[1][0].date == datetime(2026, 7, 14, 8) and got[1][1].date is None
    assert got[2][0].author == "Ann" and got[2][0].html == "<p>hi</p>"
    assert all(got[k][0].error for k in (3, 4, 5))
    with pytest.raises(ValueError):
        feed_source.safe_xml(("<!-- c --><?p i?><!DOCTYPE x><x/>").encode("utf-16"))
    page = '<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="application/atom+xml" href="/comments/feed"><link rel="alternate" type="application/rss+xml" href="/feed">'
    assert feed_source.discover(page, "https://e.org/x") == ["https://e.org/feed"]
    assert one(spark, feed_source.is_feed(F.col("a"), F.col("b")), a="  <?xml?><rss", b="") and not one(spark, feed_source.is_feed(F.col("a"), F.col("b")), a="<p>rss", b="text/html")


def test_feed_order(spark):
    rows = spark.createDataFrame([("f", i, d) for i, d in enumerate(["2026-01-02", None, "2026-01-01", "2026-01-02"])], "feed string, pos long, date string")
    place = lambda o: [r.pos for r in feeds.reading_order(rows, "feed", "date", "pos", o).orderBy("place").collect()]
    assert place("asc") == [2, 0, 3, 1] and place("desc") == [1, 3, 0, 2] and place("keep") == [0, 1, 2, 3]
    assert {r.pos for r in feeds.most_recent(rows, "feed", "date", "pos", 2).collect()} == {0, 3}


def test_feed_text_choice(spark):
    items = spark.createDataFrame([("a", "short", 5, False, True), ("b", "x" * 400, 400, False, True), ("c", "", 0, True, False), ("d", "", 0, False, True)], "link string, html string, length long, image boolean, wants boolean")
    pages = spark.createDataFrame([("a", "page a", 900, False), ("b", "tiny", 100, False)], "url string, html string, length long, image boolean")
    assert {r.link: (r.html[:6], r.from_page) for r in feeds.choose_text(items, pages).collect()} == {"a": ("page a", True), "b": ("xxxxxx", False), "c": ("", False)}


def test_source_contents(spark):
    toc = lambda t, h: one(spark, numbering.is_source_toc(F.col("t"), F.col("h")), t=t, h=h)
    assert toc("Contents", "<p>One ..... 12</p>") and toc(" TOC ", '<a href="#a">' * 3) and not toc("Contents", "<p>prose</p>") and not toc("One", "a ... 1")


NOTED = '<p>Text<sup><a href="#fn1">1</a></sup> more<sup><a href="#fn1">1</a></sup>.</p><ol class="footnotes"><li id="fn1"><p>1. The note <a href="#r">↩</a></p></li></ol>'


def test_footnotes():
    got = notes.inline_footnotes(NOTED)
    assert got.startswith('<p>Text<span class="footnote">The note') and "<sup>1</sup>." in got and "<ol" not in got
    assert notes.inline_footnotes('<p><a href="#x">1</a></p><h2 id="x">x</h2>') == '<p><a href="#x">1</a></p><h2 id="x">x</h2>'
    assert '<sup class="sidenote-call">1</sup>' in notes.number_sidenotes(got)


LINKED = '<p>a <a href="http://e.org/1">one</a>, <a href="http://e.org/2">two</a>, <a href="http://e.org/1">again</a> <a href="mailto:x@y.z">mail</a></p><h2><a href="http://e.org/3">head</a></h2>'


@pytest.mark.parametrize("mode", ["inline", "aside", "native", "word", "endnote"])
def test_link_notes(mode):
    got, following = notes.annotate(LINKED, 5, mode)
    assert following == 8 and "(<a" in got and notes.call_links(LINKED) == ["http://e.org/1", "http://e.org/2", "http://e.org/1"]
    again, same = notes.annotate(got, 5, mode) if mode != "endnote" else (got, 5)
    assert again == got or mode == "native"
    assert '<h2><a href="http://e.org/3">head</a></h2>' in got


def test_shared_endnotes():
    got, following = notes.annotate(LINKED, 1, "endnote", numbers={"http://e.org/1": 1, "http://e.org/2": 2})
    assert following == 3 and got.count("#ln-1") == 2 and got.count('id="lnref-1"') == 1
    assert notes.endnote(2, "http://e.org/2", marker="bracket").startswith('<p class="endnote" id="ln-2"><a class="linknote-label" href="#lnref-2">[2]</a>')


def test_citations(spark):
    rows = spark.createDataFrame([("Doe, J.", "2026-07-14", "A title", "Site", "u"), (None, None, "Why?", "Site", "u"), ("Site", None, "T", "site.", "u")], "b string, d string, t string, s string, u string")
    got = [r[0] for r in rows.select(links.citation_text(F.col("b"), F.to_date("d"), F.col("t"), F.col("s"), F.col("u"))).collect()]
    assert got == ["Doe, J. (2026, July 14). A title. Site. u", "Why? (n.d.). Site. u", "Site. (n.d.). T. u"]


def test_word_files():
    data = sinks.word("Book & more", "Ann", [("One", "<p>a <b>bold</b> <i>x</i></p><h2>Sub</h2><blockquote>q</blockquote>", "1"), ("Notes", "<p>n</p>", None)])
    got = word.read_word(data)
    assert got["title"] == "Book & more" and got["author"] == "Ann"
    for part in ("<h1>Book &amp; more</h1>", "<h1>1. One</h1>", "<strong>bold</strong>", "<em>x</em>", "<h3>Sub</h3>", "<blockquote><p>q</p></blockquote>", "<h1>Notes</h1>"):
        assert part in got["html"], part
    for bad in (None, b"", b"PK\x03\x04", sinks.package([("a", "b")])):
        with pytest.raises(ValueError):
            word.read_word(bad)


def test_pdf_files(spark):
    from quire.functions.arrow import map_rows

    lines = ["A Heading", "First line of prose that is hy-", "phenated here and goes on (so).", "Last line."]
    rows = spark.createDataFrame([(1, bytearray(_sample_pdf(lines))), (2, bytearray(b"no")), (3, None)], "doc_id long, content binary")
    runs = map_rows(rows, pdf.RUNS, pdf.read_runs, "content")
    assert {r.doc_id: r.error is None for r in runs.collect()} == {1: True, 2: False, 3: False}
    out = pdf.blocks_to_html(pdf.lines(runs.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*"))).collect()
    assert [r.html for r in out] == ["<h1>A Heading</h1>\n<p>First line of prose that is hyphenated here and goes on (so). Last line.</p>"]


def test_books(spark):
    chapters = [("One", "<p>x &amp; y</p>", "1"), ("End", "<p>z</p>", None)]
    assert sinks.epub("T", "A", "en", "2026-01-01", chapters) == sinks.epub("T", "A", "en", "2026-01-01", chapters)
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(sinks.epub("T & U", "A", "en", "2026-01-01", chapters)))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    for n in z.namelist()[1:]:
        ET.fromstring(z.read(n))
    assert "\\chapter{One}" in sinks.latex("T", "A", chapters) and "x \\& y" in sinks.to_tex(chapters[0][1]) and "\\emph{a}" in sinks.to_tex("<p><em>a</em></p>")
    ET.fromstring(sinks.icml("T", chapters))
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    assert scalar.image_size(png) == (3, 2) and one(spark, books.sniff_image(F.col("a"), F.lit("")), a=bytearray(png)) == "image/png"
    assert one(spark, layout.estimate_pages(F.col("w"), F.col("c"), F.lit(250)), w=75000, c=10) % 2 == 0


def test_files(spark, tmp_path):
    (tmp_path / "a-first.md").write_text("# One\n\nx\n\n# Two\n\ny")
    (tmp_path / "b.txt").write_text("plain\ntext\n\nmore")
    (tmp_path / "c.docx").write_bytes(sinks.word("W", "Ann", [("C", "<p>w</p>", None)]))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.html").write_text(PAGE)
    (tmp_path / ".hidden.md").write_text("# no")
    got = files.ingest(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.title for r in got if not r.error] == ["One", "Two", "B", "C", "A Fine Title Here"]
    assert [bool(r.error) for r in got].count(True) == 1


def test_limiter(spark, tmp_path):
    rows = [("a", i, datetime.fromtimestamp(t, timezone.utc)) for i, t in enumerate([0, 1, 2, 9, 10, 11, 12])] + [("b", 100, datetime.fromtimestamp(3, timezone.utc))]
    df = spark.createDataFrame(rows, "client string, event long, ts timestamp")
    got = {r.event: r.accepted for r in limiter.limited(df, "client", "ts", "event", 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 100: True}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "client", "ts", "event", 2, 10)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.event: r.accepted for r in spark.table("limited").collect()} == got
