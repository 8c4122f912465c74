"""Rules that rewrite or read markup, addresses and bytes of one document, with SQL for what they must give.

The sample has no notes, pictures, lists of posts or feeds; each query makes them out of the columns there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalar, tree
from quire.functions import text as T
from quire.functions import url as U
from quire.functions.arrow import map_rows
from quire.operators import article, notes
from quire.operators import snapshot as S
from quire.plans.catalogue import _ESCAPE, _HOST, _UNESCAPE, _WS, query, table
from quire.sources import feeds as feed_source

_LINE = "trim(split_part(text, chr(10), 1))"
_SAFE = _ESCAPE.format(_LINE)


def _first_lines(spark, sf_dir):
    line = F.trim(F.regexp_extract("text", "^([^\\n]*)", 1))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", line.alias("line"), T.escape_html(line).alias("safe"))


@query(rf"""SELECT page_id, CAST(length({_WS.format(_UNESCAPE.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?[ab]\b[^>]*>', '', 'g'), '<[^>]+>', ' ', 'g')"))}) AS BIGINT) AS visible, false AS image FROM pages""")
def visible_lengths(spark, sf_dir):
    """The characters that a reader of each page sees, scripts and styles left out, and whether it has a picture."""
    return map_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "visible long, image boolean", lambda h: {"visible": tree.visible_length(h), "image": tree.has_image(h)}, "html").drop("error")


@query(f"""SELECT doc_id, '<p>' || {_SAFE} || '<span class="footnote">Note ' || doc_id || ' of <em>' || lang || '</em></span> and again<sup>1</sup>, not <a href="#none">2</a></p>' AS html,
'<p>' || {_SAFE} || '<sup class="sidenote-call">1</sup><span class="footnote"><sup class="sidenote-mark">1</sup>Note ' || doc_id || ' of <em>' || lang || '</em></span> and again<sup>1</sup>, not <a href="#none">2</a></p>' AS numbered FROM documents""")
def inlined_notes(spark, sf_dir):
    """A note that is called twice moves to its first call; the list, its label and its way back go; then it is numbered."""
    d = _first_lines(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    html = F.concat(F.lit("<p>"), "safe", F.lit('<sup><a href="#fn1">1</a></sup> and again<sup><a href="#fn1">1</a></sup>, not <a href="#none">2</a></p><ol class="footnotes"><li id="fn1"><p>1. Note '), i, F.lit(" of <em>"), "lang", F.lit('</em> <a href="#fnref1">↩</a></p></li></ol>'))

    def rule(markup):
        done = notes.inline_footnotes(markup)
        return {"html": done, "numbered": notes.number_sidenotes(done)}

    return map_rows(d.select("doc_id", html.alias("m")), "html string, numbered string", rule, "m").drop("error")


@query(f"""SELECT doc_id, '<p>' || {_SAFE} || '</p><ol><li id="note-1"><p>' || lang || '</p></li></ol>' AS html FROM documents""")
def gathered_notes(spark, sf_dir):
    """A block that defines one footnote becomes an item of a list that its call still finds."""
    d = _first_lines(spark, sf_dir)
    html = F.concat(F.lit("<p>"), "safe", F.lit('<a href="#note-1"></a></p><div class="footnote"><a id="note-1" href="#back">1</a><div class="footnote-content"><p>'), "lang", F.lit("</p></div></div>"))
    rows = map_rows(d.select("doc_id", html.alias("m")), "html string", lambda m: {"html": article.clean_fragment(m)}, "m").drop("error")
    return rows.withColumn("html", F.replace("html", F.lit('<a href="#note-1"></a>'), F.lit("")))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches({_LINE}, '^\\p{{L}}[\\p{{L}}\\p{{N}}]+') THEN '<p><span class="lettrine">' || substr({_LINE}, 1, 1) || '</span><span class="lettrine-run">' || regexp_extract(substr({_LINE}, 2), '^[\\p{{L}}\\p{{N}}]+') || '</span>' || {_ESCAPE.format(f"regexp_replace(substr({_LINE}, 2), '^[\\p{{L}}\\p{{N}}]+', '')")} || '</p>' ELSE '<p>' || {_SAFE} || '</p>' END AS html FROM documents""")
def lettrines(spark, sf_dir):
    """The opening word of each document as a dropped initial and a run-in."""
    d = _first_lines(spark, sf_dir).select("doc_id", F.concat(F.lit("<p>"), "safe", F.lit("</p>")).alias("m"))
    return map_rows(d, "html string", lambda m: {"html": S.lettrine(m)}, "m").drop("error")


_NAME = "'images/img-' || substr(sha1(text), 1, 12) || '.png'"


@query(f"""SELECT doc_id, 'download' AS policy, '<p>a</p>' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<figure><img src="' || {_NAME} || '" /><figcaption>c</figcaption></figure>' END AS html FROM documents
UNION ALL SELECT doc_id, 'strip', '<p>a</p>' FROM documents UNION ALL SELECT doc_id, 'link', '<p>a</p><figure><img src="https://x.example/' || doc_id || '" /><figcaption>c</figcaption></figure>' FROM documents""")
def picture_policies(spark, sf_dir):
    """Pictures under the three policies; every third could not be loaded, and its figure goes with it."""
    docs = table(spark, sf_dir, "documents")
    address = F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string"))
    chapters = docs.select(F.lit("b").alias("book_id"), F.col("doc_id").alias("pos"), F.concat(F.lit('<p>a</p><figure><img src="'), address, F.lit('" /><figcaption>c</figcaption></figure>')).alias("html"))
    loaded = docs.select(address.alias("url"), F.lit("image/png").alias("media_type"), F.when(F.col("doc_id") % 3 != 0, F.col("text").cast("binary")).alias("data"))
    out = None
    for policy in ("download", "strip", "link"):
        done, _ = S.apply_images(chapters, loaded, policy)
        done = done.select(F.col("pos").alias("doc_id"), F.lit(policy).alias("policy"), "html")
        out = done if out is None else out.unionByName(done)
    return out


@query(f"""WITH l AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents), o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM l WHERE n >= 5)
SELECT 'https://www.' || source || '.example/reading' AS url, pos, 'https://' || source || '.example/post/' || doc_id AS target FROM o WHERE pos < 7""")
def listed_posts(spark, sf_dir):
    """One page for each source that lists its documents as posts of its site: the first seven of each list."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    item = F.concat(F.lit('<li><a href="https://'), "source", F.lit(".example/post/"), F.col("doc_id").cast("string"), F.lit('#top">A title that is long enough</a>, a remark</li>'))
    rows = d.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x")))).alias("items"))
    html = F.concat(F.lit("<h2>All</h2><ul>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</ul>"))
    pages = rows.select(F.concat(F.lit("https://www."), "source", F.lit(".example/reading")).alias("url"), html.alias("html"))
    out = S.list_pages(pages, most=7)
    return out.select("url", F.col("pos").cast("long").alias("pos"), F.regexp_replace("target", "#top$", "").alias("target"))


@query("SELECT page_id, page_id % 6 IN (0, 1, 2, 4) AS is_feed FROM pages")
def sniffed_feeds(spark, sf_dir):
    """Bodies that are feeds by content type or by their opening, and two kinds that are not."""
    k = F.col("page_id") % 6
    body = F.when(k == 0, F.concat(F.lit("  <?xml version='1.0'?>\n<rss>"), "html")).when(k == 1, F.concat(F.lit("<feed xmlns='x'>"), "html")).when(k == 4, F.lit("<RDF:rdf>")).when(k == 5, F.concat(F.lit("<?xml version='1.0'?><book>"), F.lit("x" * 600), F.lit("<rss>"))).otherwise(F.col("html"))
    kind = F.when(k == 2, "application/RSS+xml; charset=utf-8").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", feed_source.is_feed(body, kind).alias("is_feed"))


@query(r"""SELECT page_id, array_to_string([regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/feed.xml', 'https://other.example/atom'], ' ') AS feeds FROM pages""")
def discovered_feeds(spark, sf_dir):
    """Feeds that a page's head names: relative and absolute ones, each once, no feed of comments."""
    links = '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="ALTERNATE" type="application/atom+xml; x" href="https://other.example/atom"><link rel="alternate" type="application/rss+xml" href="/comments/feed"><link rel="alternate" type="text/html" href="/x"><link rel="alternate home" type="application/rss+xml" href="/feed.xml">'
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit(links), "html").alias("html"))
    return map_rows(pages, "feeds string", lambda h, u: {"feeds": " ".join(feed_source.discover(h, u))}, "html", "url").drop("error")


@query(r"""SELECT doc_id, 'https://medium.com/feed/@' || source AS feed, lpad(to_hex(doc_id), 12, '0') AS story, 'https://www.greaterwrong.com/posts/' || doc_id || '/x?y=1' AS mirror FROM documents""")
def detours(spark, sf_dir):
    """Where texts are read whose own pages turn automated readers away: a platform's feed, a mirror."""
    i = F.col("doc_id").cast("string")
    ident = F.lower(F.lpad(F.hex("doc_id"), 12, "0"))
    story = S.story_feed(F.concat(F.lit("https://Medium.com/@"), "source", F.lit("/a-story-"), ident, F.lit("?source=rss")))
    mirror = S.mirror(F.concat(F.lit("https://www.lesswrong.com/posts/"), i, F.lit("/x?y=1")))
    return table(spark, sf_dir, "documents").select("doc_id", story["feed"].alias("feed"), F.upper(story["story"]).alias("story"), mirror.alias("mirror"))


@query("SELECT doc_id, sha1(CASE WHEN doc_id % 3 = 1 THEN regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g') ELSE text END) AS text_sha1 FROM documents")
def decoded_bodies(spark, sf_dir):
    """Bodies in UTF-8 and Latin-1, named by the header, by the page or not at all."""
    k = F.col("doc_id") % 3
    data = F.when(k == 1, F.unhex(F.hex(F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "ISO-8859-1")))).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=UTF-8").when(k == 1, 'text/html; charset="iso-8859-1"').otherwise("text/html")
    rows = table(spark, sf_dir, "documents").select("doc_id", data.alias("data"), kind.alias("kind"))
    out = map_rows(rows, "text string", lambda d, t: {"text": scalar.decode_body(d, t)}, "data", "kind")
    return out.select("doc_id", F.sha1("text").alias("text_sha1"))


@query("SELECT doc_id, sha1(text) AS data_sha1, CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS media_type FROM documents")
def decoded_uris(spark, sf_dir):
    """Data addresses in base64 with a type, and percent-encoded without one."""
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\\r\\n]", "")
    uri = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), coded)).otherwise(F.concat(F.lit("data:,"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))))

    def rule(u):
        data, kind = scalar.decode_data_uri(u)
        return {"data": data, "media_type": kind}

    out = map_rows(table(spark, sf_dir, "documents").select("doc_id", uri.alias("u")), "data binary, media_type string", rule, "u")
    return out.select("doc_id", F.sha1("data").alias("data_sha1"), "media_type")


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4000 + 1 ELSE 0 END AS width, CASE WHEN doc_id % 4 < 3 THEN doc_id % 70 + 1 ELSE 0 END AS height FROM documents")
def image_sizes(spark, sf_dir):
    """Widths and heights by the heads of PNG, GIF and JPEG data; other data has neither: zeros."""
    w, h = F.col("doc_id") % 4000 + 1, F.col("doc_id") % 70 + 1
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    little = lambda c: F.concat(F.substring(two(c), 3, 2), F.substring(two(c), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(w), four(h))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.lit("000000"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), two(h), two(w), F.lit("0300"))
    data = F.when(F.col("doc_id") % 4 == 0, png).when(F.col("doc_id") % 4 == 1, gif).when(F.col("doc_id") % 4 == 2, jpeg).otherwise("00")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.unhex(data).alias("d"))
    return map_rows(rows, "width long, height long", lambda d: dict(zip(("width", "height"), scalar.image_size(d) or (0, 0))), "d").drop("error")


@query(f"SELECT page_id, {_HOST.format('url')} AS host, 'http://h.example/' || CAST(page_id AS VARCHAR) || '/%C3%A9%20x%2F?a=%7Eb&c=%C3%B1#t' AS quoted FROM pages")
def requoted_addresses(spark, sf_dir):
    """Raw characters of an address are percent-encoded, escapes that are there stay."""
    raw = F.concat(F.lit("http://h.example/"), F.col("page_id").cast("string"), F.lit("/é x%2F?a=%7Eb&c=ñ#t"))
    rows = table(spark, sf_dir, "pages").select("page_id", U.host_key(F.col("url")).alias("host"), raw.alias("u"))
    return map_rows(rows, "quoted string", lambda u: {"quoted": scalar.requote(u)}, "u").drop("error")
