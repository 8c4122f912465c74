"""Damaged files, deep nesting and nulls: one bad document is a row with an error, never a failed job."""

import hashlib
import io
import random
import re
import zipfile
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quire.functions import markdown, tree
from quire.functions.arrow import map_rows, refusing
from quire.operators import article, books, feeds, layout, sinks
from quire.operators import notes as notes_of
from quire.plans.documents import _sample_pdf
from quire.sources import files, pdf, word
from quire.streaming import limiter

LINES = ["A Heading", "First line of prose that is hy-", "phenated here and goes on (so).", "Last line."]


def damaged(data: bytes, n: int, seed: int):
    rng = random.Random(seed)
    for _ in range(n):
        x = bytearray(data)
        kind = rng.randrange(4)
        if kind == 0:
            x = x[: rng.randrange(len(x))]
        elif kind == 1:
            for _ in range(rng.randint(1, 40)):
                x[rng.randrange(len(x))] = rng.randrange(256)
        elif kind == 2:
            a = rng.randrange(len(x))
            del x[a : a + rng.randint(1, 60)]
        else:
            a = rng.randrange(len(x))
            x[a:a] = x[rng.randrange(len(x)) :][: rng.randint(1, 200)]
        yield bytes(x)


@pytest.mark.parametrize("read,data", [(word.read_word, sinks.word("T", "A", [("One", "<p>x <b>y</b></p><ul><li>z</li></ul>", "1")])), (pdf.read_runs, _sample_pdf(LINES))], ids=["word", "pdf"])
def test_damaged_files_are_refused(read, data):
    good = refused = 0
    for x in damaged(data, 500, 11):
        try:
            assert isinstance(read(x), dict)
            good += 1
        except ValueError:
            refused += 1
    assert good + refused == 500 and refused > 20


def test_a_damaged_file_is_a_row(spark):
    data = sinks.word("T", "A", [("One", "<p>x</p>", "1")])
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([data, *damaged(data, 40, 5)])], "k long, content binary")
    out = map_rows(rows, "html string, title string, author string, description string", word.read_word, "content").collect()
    assert len(out) == 41 and out[0].error is None and all((r.html is None) == (r.error is not None) for r in out)


def test_refusing_names_the_failure():
    with pytest.raises(ValueError, match="ZeroDivisionError"):
        refusing(lambda: 1 / 0)()


def test_deep_nesting():
    deep = 3000
    assert markdown.to_html("> " * deep + "x").count("<blockquote>") == deep
    assert sinks.to_tex("<div><em>" * deep + "x").startswith("\\emph{")
    assert tree.Fragment("<div>" * deep + "x").line() == "x"


def test_markdown_rows():
    assert [markdown.rule_row(r) for r in ("***", " - - -", "__", "-*-", "    ---", "* * *x")] == [True, True, False, False, False, False]
    assert [markdown.heading_row(r) for r in ("# A #", "### b", "#c", "####### d", "#  ")] == [(1, "A"), (3, "b"), None, None, (1, "")]
    assert [markdown.sides_row(r) for r in ("|--|:--:|--:|", ":--|--", "---", "a|--", "|-|--|")] == [["", "center", "right"], ["left", ""], None, None, None]
    item = markdown.item_row("  12) text here")
    assert (item.inset, item.number, item.begins, item.text) == (2, "12", 6, "text here") and markdown.item_row("-x") is None and markdown.item_row("1234567890. x") is None
    assert markdown.to_html("1. a\n2. b\n\n- c\n  - d\n\npara") == "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n<ul>\n<li>c\n<ul>\n<li>d</li>\n</ul></li>\n</ul>\n<p>para</p>"
    assert markdown.to_html("<div>\n**x**\n</div>") == "<div>\n<p><strong>x</strong></p>\n</div>"


def _lzw(data: bytes) -> bytes:
    """An encoder by the format's text, to read back."""
    table, codes, prior = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    size, width = 258, 9
    for i in range(len(data)):
        x = prior + data[i : i + 1]
        if x in table:
            prior = x
            continue
        codes.append((table[prior], width))
        if size < 4096:
            table[x], size = size, size + 1
            width = min(12, max(9, size.bit_length()))
        prior = data[i : i + 1]
    codes += [(table[prior], width), (257, width)]
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_pdf_filters():
    plain = b"BT /F1 11 Tf 72 700 Td (some text and some text again) Tj ET " * 30
    assert pdf._unlzw(_lzw(plain), 1 << 20, 1) == plain
    assert pdf._undifferenced(bytes([5, 1, 1, 9, 0, 255]), 3, 1) == bytes([5, 6, 7, 9, 9, 8])
    source = _sample_pdf(LINES)
    assert [r["text"] for r in pdf.read_runs(source)["runs"]] == LINES and pdf.read_runs(source)["note"] is None
    body = zlib.compress(b"BT /F1 11 Tf 72 700 Td (packed) Tj ET")
    at = source.index(b"<< /Length")
    packed = source[:at] + b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(body), body) + source[source.index(b"endstream") + 9 :]
    assert [r["text"] for r in pdf.read_runs(packed)["runs"]] == ["packed"]


def test_folder_with_all_formats(spark, tmp_path):
    (tmp_path / "b.md").write_text("# One\n\ntext\n\n# Two\n\nmore")
    (tmp_path / "a.pdf").write_bytes(_sample_pdf(LINES))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "d.docx").write_bytes(sinks.word("Doc", "Ann", [("One", "<p>x</p>", None)]))
    (tmp_path / "e.txt").write_text("just text")
    rows = files.ingest(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and [r.path[-5:] for r in rows][:2] == ["a.pdf", "/b.md"]
    first = rows[0]
    assert first.title == "A Heading" and "hyphenated here and goes on (so). Last line." in first.html
    assert [r.error is not None for r in rows if r.path.endswith("c.pdf")] == [True]
    assert [r.title for r in rows if r.path.endswith(".md")] == ["One", "Two"]


def test_null_clients_share_one_log(spark):
    rows = [(None, i, datetime.fromtimestamp(i, timezone.utc)) for i in range(20)] + [(2**53 + 1, 100 + i, datetime.fromtimestamp(i, timezone.utc)) for i in range(5)]
    df = spark.createDataFrame(rows, "client long, event long, ts timestamp")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = limiter.limited(df, "client", "ts", "event", 3, 1000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r.event for r in got if r.accepted) == [0, 1, 2, 100, 101, 102] and {r.client for r in got} == {None, 2**53 + 1}


def test_items_without_a_wish_keep_their_text(spark):
    items = spark.createDataFrame([("a", "x" * 50, 50, False, False), ("b", "y", 50, False, True), (None, "z", 50, False, None)], "link string, html string, length long, image boolean, wants boolean")
    pages = spark.createDataFrame([("a", "page", 900, False), ("b", "page", 900, False)], "url string, html string, length long, image boolean")
    assert sorted((r.link or "", r.from_page) for r in feeds.choose_text(items, pages).collect()) == [("", False), ("a", False), ("b", True)]


def test_layout_measures(spark):
    rows = spark.createDataFrame([("d", 0, i, 700.0 - 14 * i - (20 if i > 3 else 0)) for i in range(8)] + [("e", 0, 0, 700.0)], "doc string, page int, line_no int, y double")
    assert [(r.doc, r.leading) for r in layout.median_leading(rows, "doc", "page", "line_no", "y").collect()] == [("d", 14.0)]
    shares = [spark.range(1).select(layout.lost_share(F.lit(x)).alias("s")).first().s for x in ("ab�", "ab\n", "")]
    assert shares == [0.5, 0.0, 0.0]


def test_copyright_page(spark):
    rows = spark.createDataFrame([("Ann", "2026-07-14", "CC BY", "https://a.example", None), (None, None, None, " ", None), ("Ann", None, None, None, "own one\n\n own two ")], "author string, date string, rights string, source string, own string")
    got = [r.x for r in rows.select(sinks.copyright_page(*map(F.col, rows.columns)).alias("x")).collect()]
    assert got == [["Copyright © 2026 Ann. All rights reserved.", "CC BY", "Originally published at https://a.example.", "Produced with quire."], ["Produced with quire."], ["own one", "own two"]]


PROSE = "<p>" + "Some long prose, with commas, and with many words that go on, and on. " * 5 + "{}</p>"


def test_note_blocks_become_a_list():
    call = '<a href="#footnote-1">1</a> and <a href="#footnote-2">2</a>'
    notes = "".join(f'<div class="footnote"><a id="footnote-{n}" href="#footnote-anchor-{n}">{n}</a><div class="footnote-content"><p>note {n}</p></div></div>' for n in (1, 2))
    got = article.extract(f"<html><body><article>{PROSE.format(call)}{notes}</article></body></html>")["html"]
    assert got.endswith('<ol><li id="footnote-1"><p>note 1</p></li><li id="footnote-2"><p>note 2</p></li></ol>') and 'href="#footnote-2"' in got
    inlined = notes_of.inline_footnotes(got)
    assert inlined.count('<span class="footnote">note') == 2 and "<ol>" not in inlined
    kept = f'<div class="footnotes"><ol><li id="a">x <a id="b">y</a></li></ol></div><p><a href="#a">1</a></p>'
    assert '<li id="a">' in article.clean_fragment(kept)


def test_notes_that_stand_apart_are_adopted():
    marker = '<sup id="ref-1"><a href="#ref-1">1</a></sup>'
    area = '<div class="refs"><div id="reference-item-1"><a href="#ref-1">1.</a><div><p>the note</p></div></div></div>'
    got = article.extract(f"<html><body><article>{PROSE.format(marker)}{PROSE.format('')}</article>{area}</body></html>")["html"]
    assert got.endswith('<ol><li id="ref-1"><p>the note</p></li></ol>') and '<sup><a href="#ref-1">1</a></sup>' in got
    assert '<span class="footnote">the note</span>' in notes_of.inline_footnotes(got)


def test_zip_of_artifacts_is_deterministic():
    a = sinks.package([("x", "y")], "application/epub+zip")
    assert a == sinks.package([("x", "y")], "application/epub+zip") and zipfile.ZipFile(io.BytesIO(a)).namelist() == ["mimetype", "x"]


def test_epub_parts(spark):
    import xml.etree.ElementTree as ET

    chapters = spark.createDataFrame([("b", 0, "One", '<p>x <img src="images/a.png" /></p>', "1"), ("b", 1, "End", "<p>y</p>", None), ("c", 0, "Only", "<p>z</p>", "1")], "book_id string, pos int, title string, html string, display string")
    books = spark.createDataFrame([("b", "T & U", "Ann", "en", "2026-01-01"), ("c", "C", None, None, None)], "book_id string, title string, author string, language string, date string")
    assets = spark.createDataFrame([("b", "cover", bytearray(b"\x89PNG"), "image/png"), ("b", "images/a.png", bytearray(b"\x89PNG2"), "image/png")], "book_id string, name string, data binary, media_type string")
    made = {(r.book_id, r.name): r for r in sinks.artifacts(chapters, books, ("epub", "tex"), assets=assets).collect()}
    assert len(made) == 4 and all(r.error is None for r in made.values())
    z = zipfile.ZipFile(io.BytesIO(made["b", "book.epub"].content))
    names = z.namelist()
    assert {"OEBPS/text/cover.xhtml", "OEBPS/images/cover.png", "OEBPS/text/title.xhtml", "OEBPS/images/a.png", "OEBPS/text/chapter-002.xhtml"} <= set(names)
    assert 'src="../images/a.png"' in z.read("OEBPS/text/chapter-001.xhtml").decode()
    opf = ET.fromstring(z.read("OEBPS/content.opf"))
    refs = [x.get("idref") for x in opf.iter() if x.tag.endswith("itemref")]
    assert refs == ["cover", "title", "c1", "c2"] and "cover-image" in [x.get("properties") for x in opf.iter()]
    for n in names:
        if n.endswith((".xhtml", ".opf", ".ncx")):
            ET.fromstring(z.read(n).replace(b"<!DOCTYPE html>", b""))
    page = sinks.epub("T", "A", "en", "2026-01-01", [("One", "<p>x</p>", None)], rights=["© A"])
    assert "© A" in zipfile.ZipFile(io.BytesIO(page)).read("OEBPS/text/copyright.xhtml").decode()


def test_a_format_that_fails_costs_no_other(spark, monkeypatch):
    chapters = spark.createDataFrame([("b", 0, "One", "<p>x</p>", "1")], "book_id string, pos int, title string, html string, display string")
    books = spark.createDataFrame([("b", "T", "Ann", "en", "not a date")], "book_id string, title string, author string, language string, date string")
    with pytest.raises(ValueError):
        sinks.artifacts(chapters, books, ("epub", "odd"))
    assert [r.error for r in sinks.artifacts(chapters, books, ("epub", "docx", "tex", "icml")).collect()] == [None] * 4


def test_tables_in_tex():
    assert sinks.to_tex("<table><tr><th>a</th><th>b &amp; c</th></tr><tr><td>1</td><td>2</td></tr></table>") == "\\begin{tabular}{ll}\na & b \\& c \\\\\n1 & 2 \\\\\n\\end{tabular}"


def test_files_are_written_inside_their_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"x")), ("c.bin", None), ("../d", bytearray(b"y")), (None, bytearray(b"z"))], "name string, content binary")
    out = {r["name"]: r.error for r in sinks.write_files(rows, f"file://{tmp_path}").collect()}
    assert out["a/b.txt"] is None and out["c.bin"] is None and out["../d"] and out[None]
    assert (tmp_path / "a/b.txt").read_bytes() == b"x" and (tmp_path / "c.bin").read_bytes() == b"" and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a", "c.bin"]


def test_safe_names(spark):
    rows = spark.createDataFrame([(0, "/x/y/a b.txt"), (1, "a b.txt"), (2, "é<>.md"), (3, ""), (4, None), (5, "a b.txt")], "i int, name string").withColumn("k", F.lit(1))
    assert [r.safe for r in books.safe_names(rows, "k", "name", "i").orderBy("i").collect()] == ["a b.txt", "a b-1.txt", "é_.md", "upload.txt", "upload-1.txt", "a b-2.txt"]


def test_page_layout_packages():
    import xml.etree.ElementTree as ET

    chapters = [("One & two", "<p>x <em>y</em></p>" + "<p>some words here</p>" * 400, "1"), ("End", "<blockquote>z</blockquote>", None)]
    data = sinks.idml("T", "A", chapters)
    assert data == sinks.idml("T", "A", chapters)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.namelist()[0] == "mimetype" and z.read("mimetype").decode() == sinks.IDML_TYPE
    trees = {n: ET.fromstring(z.read(n)) for n in z.namelist()[1:]}
    listed = [x.get("src") for x in trees["designmap.xml"].iter() if x.get("src")]
    assert set(listed) == {n for n in trees if n.startswith(("Resources", "Spreads", "Stories"))}
    frames = [x for n in listed if n.startswith("Spreads") for x in trees[n].iter("TextFrame")]
    assert len(frames) % 2 == 0 and [f.get("NextTextFrame") for f in frames] == [f.get("Self") for f in frames[1:]] + ["n"]
    used = {x.get("AppliedParagraphStyle") for x in trees["Stories/Story_story.xml"].iter("ParagraphStyleRange")}
    assert used <= {x.get("Self") for x in trees["Resources/Styles.xml"].iter("ParagraphStyle")}
    assert sinks.paragraph_styles("classic")["Body"] == {"size": 11.0, "leading": 15.95, "before": 0.0, "after": 0.0, "align": "LeftJustified"}


@pytest.mark.parametrize("theme,base", [("classic", 11), ("vsi", 10), ("tufte", 10), ("memoir2", 12)])
def test_tex_books(theme, base):
    done = sinks.latex("T & U", "Ann", [("One", "<p>x</p>", "1"), ("End", "<p>y</p>", None)], theme, "de-AT", ["© Ann"], ["<p>Ann. (2020). <em>T</em>.</p>"])
    assert done.startswith(f"\\documentclass[{base}pt") and "[ngerman]{babel}" in done and done.count("{") == done.count("}")
    for part in ("\\title{T \\& U}", "\\chapter{One}", "\\chapter*{End}", "\\chapter*{References}", "© Ann", "\\emph{T}", "\\end{document}"):
        assert part in done, part
    assert ("\\fontsize{8.5}" in done) == (theme == "vsi") and f"paperwidth={sinks.TRIMS[next(t[1] for t in sinks.THEMES if t[0] == theme)][0]:.2f}in" in done


def test_word_files_come_back():
    markup = (
        '<p>a <strong>b</strong> <a href="https://x.example/?a=1&amp;b=2">link</a> c<span class="footnote">a <em>note</em></span>.</p>'
        "<ul><li>one<ol><li>first</li><li>second</li></ol></li><li>two</li></ul><ol><li>other</li></ol>"
        "<table><tr><th>h</th><td>1 &lt; 2</td></tr><tr><td>x</td><td>y</td></tr></table><blockquote><p>said</p></blockquote><pre>code  here</pre><hr /><h2>Head</h2>stray <em>text</em>"
    )
    data = sinks.word("T", "A", [("One", markup, "1")])
    salt = hashlib.sha1(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).hexdigest()[:6]
    got = word.read_word(data)["html"].replace(f"-{salt}-", "-")
    for part in (
        '<p>a <strong>b</strong> <a href="https://x.example/?a=1&amp;b=2">link</a> c<sup id="fnref-1"><a href="#fn-1">1</a></sup>.</p>',
        "<ul><li>one<ol><li>first</li><li>second</li></ol></li><li>two</li></ul>", "<ol><li>other</li></ol>",
        "<table><tr><td>h</td><td>1 &lt; 2</td></tr><tr><td>x</td><td>y</td></tr></table>", "<blockquote><p>said</p></blockquote>", "<pre><code>code  here</code></pre>", "<hr />", "<h3>Head</h3>", "<p>stray <em>text</em></p>",
        '<ol class="footnotes"><li id="fn-1"><p>a <em>note</em></p>',
    ):
        assert part in got, (part, got)
    assert sinks.word("T", "A", [("D", "<div><em>" * 3000 + "x", None)])


def test_word_endnotes():
    source = zipfile.ZipFile(io.BytesIO(sinks.word("T", "A", [("One", '<p>a<span class="footnote">foot</span> b</p>', None)])))
    files = {n: source.read(n) for n in source.namelist()}
    files["word/document.xml"] = files["word/document.xml"].replace(b"</w:body>", b'<w:p><w:r><w:t>c</w:t><w:endnoteReference w:id="7"/><w:endnoteReference w:id="8"/></w:r></w:p></w:body>')
    space = b'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files["word/endnotes.xml"] = b'<w:endnotes %s><w:endnote w:id="7"><w:p><w:r><w:t>end </w:t></w:r><w:hyperlink r:id="k"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p></w:endnote><w:endnote w:id="8" w:type="separator"/></w:endnotes>' % space
    files["word/_rels/endnotes.xml.rels"] = b'<Relationships><Relationship Id="k" Target="https://n.example"/></Relationships>'
    got = re.sub("-[0-9a-f]{6}-", "-", word.read_word(sinks.package(list(files.items())))["html"])
    assert '<li id="fn-1"><p>foot</p>' in got and '<li id="fn-2"><p>end <a href="https://n.example">link</a></p>' in got and "fn-3" not in got


def test_pdf_fonts():
    assert [pdf.glyph_text(x) for x in ("A", "eacute", "germandbls", "fi", "uni00E9", "uni00410042", "u1F600", "quoteright", "g123", "a.alt", "unit")] == ["A", "é", "ß", "fi", "é", "AB", "\U0001f600", "’", "", "a", ""]
    source = _sample_pdf(["x"])
    named = source.replace(b"/BaseFont /Helvetica >>", b"/BaseFont /Own /Encoding << /Differences [120 /eacute 121 /fi] >> /FontDescriptor << /MissingWidth 250 >> >>")
    (run,) = pdf.read_runs(named)["runs"]
    assert run["text"] == "é" and abs(run["x1"] - run["x0"] - 0.25 * run["size"]) < 1e-6
    font = pdf._Font(pdf.Pdf(source), {"DescendantFonts": [{"DW": 800, "W": [3, [100, 200], 10, 12, 700]}]})
    assert (font.widths, font.default) == ({3: 100, 4: 200, 10: 700, 11: 700, 12: 700}, 800)


def test_scratch_tables_are_cleared(spark):
    import os

    from quire import runtime

    table = runtime.materialize(spark.range(3), "three")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://").replace("file:", ""))
    assert table.count() == 3 and os.path.isdir(folder) and spark.sparkContext.applicationId in folder
    assert runtime.clear(spark) and not os.path.exists(folder)
    runtime.ship(spark)
    assert spark.conf.get(runtime.BATCH_KEY) == str(runtime.BATCH_ROWS)
