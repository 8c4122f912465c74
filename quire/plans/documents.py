"""Queries whose work is in trees, names and binary formats, with the SQL of what the sample tables must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markdown, scalar, tree
from quire.functions.arrow import map_rows
from quire.operators import article, books, links, notes, numbering, sinks
from quire.operators.feeds import choose_text, wants_page
from quire.plans.catalogue import _CHAPTERS, _ESCAPE, _HOST, _UNESCAPE, _WS, query, table
from quire.sources import feeds as feed_source
from quire.sources import pdf, word
from quire.streaming import limiter


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, event_id, rn, [t] AS log, true AS accepted FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.rn, CASE WHEN len(f.l) < 3 THEN list_append(f.l, o.t) ELSE f.l END, len(f.l) < 3
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1, LATERAL (SELECT list_filter(r.log, lambda x: o.t - x < 86400) AS l) f
) SELECT user_id, event_id, accepted FROM r""")
def rate_limited(spark, sf_dir):
    return limiter.limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, window=86400)


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'book' ELSE s END AS slug FROM (SELECT doc_id,
  substr(trim(regexp_replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS s FROM documents)""")
def doc_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "^([^\\n]*)", 1).alias("line"))
    return map_rows(rows, "slug string", lambda x: {"slug": scalar.slugify(x)}, "line").drop("error")


# The sample's pages have one article each; a heading that repeats the title goes.
_ARTICLES = rf"""r AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS a, {_WS.format(_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS t FROM pages),
h AS (SELECT *, CASE WHEN contains(t, ' | ') AND length(split_part(t, ' | ', 1)) >= 10 THEN split_part(t, ' | ', 1) ELSE t END AS title, {_WS.format(_UNESCAPE.format("regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1 FROM r),
articles AS (SELECT page_id, url, title, {_WS.format(_UNESCAPE.format("regexp_replace(CASE WHEN lower(h1) = lower(title) THEN regexp_replace(a, '(?s)^<h1>.*?</h1>', '') ELSE a END, '<[^>]+>', ' ', 'g')"))} AS words FROM h)"""


@query(f"WITH {_ARTICLES} SELECT page_id, title, words, CAST(length(words) AS BIGINT) AS visible FROM articles")
def article_texts(spark, sf_dir):
    """The title and visible text of each page's article."""
    return with_texts(table(spark, sf_dir, "pages")).select("page_id", "title", "words", "visible")


def with_texts(pages):
    """The other columns of pages, one row for each, with the article and its words."""
    found = _extracted(pages).withColumn("words", links.visible(F.col("html")))
    return found.withColumn("visible", F.length("words").cast("long"))


def _extracted(pages):
    return map_rows(pages, "title string, html string, author string, date string, site_name string", lambda url, html: article.extract(html, url), "url", "html")


@query()
def extract_articles(spark, sf_dir):
    return _extracted(table(spark, sf_dir, "pages"))


@query()
def clean_pages(spark, sf_dir):
    def rule(html, url):
        clean = article.clean_fragment(html, url)
        return {"html": clean, "visible": tree.visible_length(clean), "image": tree.has_image(clean)}

    return map_rows(table(spark, sf_dir, "pages"), "html string, visible long, image boolean", rule, "html", "url")


@query(f"""WITH l AS (SELECT doc_id, (u - 1) // 5 AS pos, u, trim(l[u]) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_WS.format("substr(arg_min(line, u), 1, 40)")} AS title, coalesce(string_agg('<p>' || {_ESCAPE.format("line")} || '</p>', chr(10) ORDER BY u) FILTER (line <> ''), '') AS html FROM l GROUP BY doc_id, pos""")
def split_chapters(spark, sf_dir):
    """Every fifth line of a document is a Markdown heading, all its signs escaped; chapters are what follows each."""
    plain = lambda c: F.regexp_replace(F.trim(c), r"([\\`*_{}\[\]()#+.!|~<>-])", r"\\$1")
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 5 == 0, F.concat(F.lit("# "), plain(F.substring(F.trim(l), 1, 40)), F.lit("\n\n"), plain(l))).otherwise(plain(l)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("md"))
    parts = map_rows(rows, "parts array<struct<title:string,html:string>>", lambda md: {"parts": [{"title": t, "html": h} for t, h in article.split_chapters(markdown.to_html(md), "Preface")]}, "md")
    return parts.select("doc_id", F.posexplode("parts").alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), "p.title", "p.html")


@query(rf"""WITH {_ARTICLES}, c AS (SELECT {_HOST.format("url")} AS book_id, page_id, title, NOT (lower(trim(title)) IN {numbering.UNNUMBERED} OR starts_with(lower(trim(title)), 'appendix ') OR starts_with(lower(trim(title)), 'appendix:')) AS numbered, CAST(len(list_filter(string_split(words, ' '), lambda w: w <> '')) AS BIGINT) AS words FROM articles)
SELECT book_id, page_id, title, words, CASE WHEN numbered THEN CAST(sum(CASE WHEN numbered THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS seq FROM c""")
def site_books(spark, sf_dir):
    """Pages to articles, sites to books: numbered chapters with word counts."""
    from quire.functions.text import word_count
    from quire.functions.url import host_key

    pages = table(spark, sf_dir, "pages").withColumn("book_id", host_key(F.col("url")))
    found = map_rows(pages, "title string, html string, author string, date string, site_name string", lambda url, html: article.extract(html, url), "url", "html")
    out = numbering.chapter_sequence(found.select("book_id", "page_id", "title", word_count(F.col("html")).alias("words")), "book_id", "page_id", ~numbering.is_furniture(F.col("title")))
    return out.select("book_id", "page_id", "title", "words", F.col("seq").cast("long").alias("seq"))


FEED_ITEMS = 20


@query()
def page_feeds(spark, sf_dir):
    """Each site's pages written as feeds of some FEED_ITEMS whole pages, read back as items, and judged by the feed policy."""
    from quire.functions.text import escape_html
    from quire.functions.url import host_key

    pages = table(spark, sf_dir, "pages").withColumn("host", host_key(F.col("url")))
    # pages are dealt to as many lots as hold FEED_ITEMS each: a site has no more in a lot, and no group or task grows with it
    lots = max(1, pages.count() // FEED_ITEMS)
    rows = pages.withColumn("feed_id", F.concat_ws(" ", F.pmod(F.xxhash64("page_id"), F.lit(lots)).cast("string"), "host"))
    item = F.concat(F.lit("<item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), escape_html(F.col("url")), F.lit("</link><description>"), escape_html(F.col("html")), F.lit("</description></item>"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("x")))), lambda p: p["x"]), "")
    docs = rows.groupBy("feed_id", "host").agg(F.concat(F.lit("<rss><channel><title>"), F.col("host"), F.lit("</title><link>https://"), F.col("host"), F.lit("/</link>"), text, F.lit("</channel></rss>")).alias("feed"))
    items = feed_source.feed_items(docs, "feed_id", "feed").filter("error is null").withColumn("host", F.element_at(F.split("feed_id", " "), 2))
    clean = map_rows(items.select("host", "pos", "title", "link", "html"), "html string, length long, image boolean", lambda h: {"html": (c := article.clean_fragment(h)), "length": tree.visible_length(c), "image": tree.has_image(c)}, "html").drop("error")
    clean = clean.withColumn("wants", wants_page(F.col("link"), F.concat(F.lit("https://"), "host", F.lit("/feed")), F.col("host"), F.lit(""), F.col("length"), None))
    fetched = map_rows(table(spark, sf_dir, "pages").select("url", F.col("html").alias("raw"), F.col("url").alias("base")), "html string, length long, image boolean", lambda raw, base: {"html": (h := article.extract(raw, base)["html"]), "length": tree.visible_length(h), "image": tree.has_image(h)}, "raw", "base")
    return choose_text(clean, fetched).select("host", "pos", "title", "link", "length", "from_page")


_SHAPES = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'-0400'", "'on' d.M.yyyy")


@query("""SELECT event_id, CASE WHEN event_id % 8 < 5 THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN event_id % 8 = 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN event_id % 8 = 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S-04:00') END AS date FROM events""")
def parse_dates(spark, sf_dir):
    """The times of events written in seven forms that are read, and one that is not."""
    raw = F
    for k, shape in enumerate(_SHAPES):
        raw = raw.when(F.col("event_id") % len(_SHAPES) == k, F.date_format("ts", shape))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("value"))
    return map_rows(rows, "date string", lambda v: {"date": scalar.iso_date(v)}, "value").drop("error")


@query(r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: length(x) > 2 AND regexp_matches(x, '^[A-Za-z]')), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))) AS w FROM documents),
n AS (SELECT doc_id, w[1] AS a, w[2] AS b, w[3] AS c FROM w WHERE len(w) >= 3 AND len(list_filter(w[1:3], lambda x: list_contains(string_split('ORGANISATION', ' '), lower(x)) OR lower(x) = 'and')) = 0)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN b || ', ' || a[1] || '.' WHEN 1 THEN b || ', ' || a[1] || '., & ' || a || ', ' || c[1] || '.'
  WHEN 2 THEN 'van ' || b || ', ' || a[1] || '.' ELSE c || ', ' || a[1] || '.-' || b[1] || '.' END AS byline FROM n""".replace("ORGANISATION", " ".join(sorted(scalar.ORGANISATION))))
def apa_bylines(spark, sf_dir):
    """The first words of each document as names: one author, two, one with a particle, one with a hyphen."""
    words = F.transform(F.filter(F.split("text", "[^\\p{L}]+"), lambda x: (F.length(x) > 2) & x.rlike("^[A-Za-z]")), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.length(x)))))
    a, b, c = (F.get("w", F.lit(i)) for i in range(3))
    name = F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" ", a, b)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("By "), a, F.lit(" "), b, F.lit(" and "), c, F.lit(" "), a))
    name = name.when(F.col("doc_id") % 4 == 2, F.concat(a, F.lit(" van "), b)).otherwise(F.concat(a, F.lit("-"), b, F.lit(" "), c))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter(F.size("w") >= 3)
    odd = F.exists(F.slice("w", 1, 3), lambda x: F.lower(x).isin(*scalar.ORGANISATION, "and"))
    rows = rows.filter(~odd).select("doc_id", name.alias("value"))
    return map_rows(rows, "byline string", lambda v: {"byline": scalar.byline(v)}, "value").drop("error")


_CALLS = rf"""p AS (SELECT page_id, {_HOST.format("url")} AS host, len(regexp_extract_all(html, '(?is)<a\b[^>]*?href="/')) AS calls FROM pages),
s AS (SELECT *, coalesce(sum(calls) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM p)"""


def _called(spark, sf_dir):
    """Each page's whole markup with absolute addresses; the number of its calls, and the number at which they start in its site."""
    from quire.functions.url import host_key, origin
    from quire.operators import scan

    html = F.regexp_replace("html", F.lit('(?is)(<a\\b[^>]*?href=")/'), F.concat(F.lit("$1"), origin(F.col("url")), F.lit("/")))
    pages = table(spark, sf_dir, "pages").select(host_key(F.col("url")).alias("host"), "page_id", html.alias("html"))
    calls = map_rows(pages, "calls long", lambda m: {"calls": len(notes.call_links(m))}, "html").drop("error")
    return pages, scan.running(calls, ["host"], ["page_id"], exclusive=True, start=F.col("calls")).withColumn("start", F.col("start") + 1)


@query(f"WITH {_CALLS} SELECT host, page_id, CAST(calls AS BIGINT) AS calls, CAST(start AS BIGINT) AS start FROM s")
def link_calls(spark, sf_dir):
    """Phase one: the calls of each page and where its site's numbering stands."""
    return _called(spark, sf_dir)[1]


@query(rf"""WITH {_CALLS} SELECT host, page_id, CAST(start + calls AS BIGINT) AS next, CAST(calls AS BIGINT) AS labels, CASE WHEN calls > 0 THEN 'L' || CAST(start AS BIGINT) END AS first_label FROM s""")
def link_notes(spark, sf_dir):
    """Phase two: each whole page written with endnote calls; the digest has its next number, labels and first label."""

    def rule(html, start):
        done, after = notes.annotate(html, start, "endnote")
        labels = tree.Fragment(done)
        found = [labels.line(i) for i in labels.find("a") if (labels.attrs[i].get("href") or "").startswith("#ln-")]
        return {"next": after, "labels": len(found), "first_label": found[0] if found else None}

    pages, calls = _called(spark, sf_dir)
    return map_rows(pages.join(calls.drop("calls"), ["host", "page_id"]), "next long, labels long, first_label string", rule, "html", "start").drop("error")


@query()
def book_artifacts(spark, sf_dir):
    """Each conversation as EPUB, Word, TeX and InCopy files."""
    from quire.plans.catalogue import _chapters

    rows = _chapters(spark, sf_dir)
    heads = rows.groupBy("conv_id").agg(F.min_by("title", "turn").alias("title"), F.lit("A. Author").alias("author"), F.lit("en").alias("language"), F.lit("2026-01-01").alias("date"))
    made = sinks.artifacts(rows.select("conv_id", F.col("turn").alias("pos"), "title", "html", "display"), heads, ("epub", "docx", "tex", "icml"), "conv_id")
    return made.select("conv_id", "name", F.length("content").cast("long").alias("bytes"), F.sha1("content").alias("sha1"))


@query(f"""WITH {_CHAPTERS}, t AS (SELECT conv_id, arg_min(title, turn) AS title FROM chapters GROUP BY 1),
c AS (SELECT conv_id, string_agg('<h1>' || CASE WHEN seq IS NOT NULL THEN CAST(CAST(seq AS BIGINT) AS VARCHAR) || '. ' ELSE '' END || {_ESCAPE.format("trim(title)")} || '</h1>' || coalesce(chr(10) || html, ''), chr(10) ORDER BY turn) AS body FROM chapters GROUP BY 1)
SELECT conv_id, '<h1>' || {_ESCAPE.format("trim(title)")} || '</h1>' || chr(10) || body AS html, title, 'A. Author' AS author FROM t JOIN c USING (conv_id)""")
def word_round_trip(spark, sf_dir):
    """Conversations written as Word files and read back as markup."""
    from quire.plans.catalogue import _chapters

    rows = _chapters(spark, sf_dir)
    heads = rows.groupBy("conv_id").agg(F.min_by("title", "turn").alias("title"), F.lit("A. Author").alias("author"), F.lit("en").alias("language"), F.lit("2026-01-01").alias("date"))
    made = sinks.artifacts(rows.select("conv_id", F.col("turn").alias("pos"), "title", "html", "display"), heads, ("docx",), "conv_id")
    return map_rows(made.select("conv_id", "content"), "html string, title string, author string, description string", word.read_word, "content").drop("description", "error")


def _sample_pdf(lines: list[str]) -> bytes:
    """A file with a heading and the lines below it, on as many pages as they need; text is as in cp1252."""
    esc = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    pages = [lines[i : i + 40] for i in range(0, len(lines), 40)]
    kids = b" ".join(b"%d 0 R" % (4 + 2 * n) for n in range(len(pages)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for n, own in enumerate(pages):
        rows = b"".join(b"BT /F1 %d Tf 72 %d Td (%s) Tj ET\n" % ((20, 720, esc(t)) if not n and not i else (11, 700 - 14 * i, esc(t))) for i, t in enumerate(own))
        parts += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * n), b"<< /Length %d >>\nstream\n%s\nendstream" % (len(rows), rows)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@query(f"""WITH l AS (SELECT item_id, string_split(regexp_replace(text, '(.{{20,60}}?) ', '\\1' || chr(10), 'g'), chr(10)) AS l FROM benchmark)
SELECT item_id AS doc_id, CASE WHEN len(l) = 1 THEN '<p>' || {_ESCAPE.format("trim(l[1])")} || '</p>' ELSE '<h1>' || {_ESCAPE.format("trim(l[1])")} || '</h1>' || chr(10) || '<p>' || {_ESCAPE.format("array_to_string(list_transform(l[2:], lambda x: trim(x)), ' ')")} || '</p>' END AS html FROM l""")
def pdf_layout(spark, sf_dir):
    """Benchmark texts set as PDF pages, read as runs, and laid out by the relational plan."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.split(F.regexp_replace("text", "(.{20,60}?) ", "$1\n"), "\n").alias("lines"))
    files = map_rows(rows, "content binary", lambda x: {"content": _sample_pdf(x)}, "lines").drop("error")
    runs = map_rows(files, pdf.RUNS, pdf.read_runs, "content").select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    return pdf.blocks_to_html(pdf.lines(runs))
