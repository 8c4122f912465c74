"""Further rules of books, assets, links and themes as queries with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books, layout, numbering, sinks
from quire.plans.catalogue import _CHAPTERS, _COUNT, _LINKS, _chapters, _links, query, table

_THEMES = [(t, *map(float, sinks.TRIMS[trim]), float(size[:-2]), leading) for t, trim, size, leading in sinks.THEMES]


@query(f"""WITH t(theme, width, height, size, factor) AS (VALUES {", ".join(f"('{t}', {w}::DOUBLE, {h}::DOUBLE, {s}::DOUBLE, {v}::DOUBLE)" for t, w, h, s, v in _THEMES)})
SELECT theme, CASE WHEN height >= 8.5 THEN 0.83 ELSE 0.75 END AS top, CASE WHEN height >= 8.5 THEN 0.78 ELSE 0.7 END AS bottom, CASE WHEN width >= 6 THEN 0.85 ELSE 0.75 END AS inner_margin,
  CASE WHEN width >= 6 THEN 0.6 ELSE 0.55 END AS outer_margin, round(size * factor, 4) AS leading_pt FROM t""")
def theme_margins(spark, sf_dir):
    """Themes as a constant dimension; margins by the page's size."""
    t = spark.createDataFrame(_THEMES, "theme string, width double, height double, size double, leading double")
    tall, broad = F.col("height") >= 8.5, F.col("width") >= 6
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    return t.select("theme", pick(tall, 0.83, 0.75).alias("top"), pick(tall, 0.78, 0.7).alias("bottom"), pick(broad, 0.85, 0.75).alias("inner_margin"), pick(broad, 0.6, 0.55).alias("outer_margin"), F.round(F.col("size") * F.col("leading"), 4).alias("leading_pt"))


@query(f"""WITH {_CHAPTERS}, b AS (SELECT conv_id, count(*) AS n, sum({_COUNT.format("coalesce(html, '')")}) AS words FROM chapters GROUP BY conv_id),
p AS (SELECT conv_id, CAST(ceil(words / 250.0 * 1.3) + 2 + ceil(n * 1.5) + 2 AS BIGINT) AS n FROM b) SELECT conv_id, CAST(greatest(n + n % 2, 4) AS BIGINT) AS pages FROM p""")
def page_estimates(spark, sf_dir):
    b = _chapters(spark, sf_dir, numbers=False).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(T.word_count(F.col("html"))).alias("words"))
    return b.select("conv_id", layout.estimate_pages(F.col("words"), F.col("n"), F.lit(250.0)).cast("long").alias("pages"))


@query("SELECT doc_id, sha1('data:text/plain;base64,' || to_base64(encode(text))) AS uri_sha1 FROM documents")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(books.data_uri(F.unhex(F.hex("text")), F.lit("text/plain"))).alias("uri_sha1"))


@query("SELECT doc_id, sha1(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_sha1 FROM documents")
def xml_escapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(T.escape_xml(F.col("text"))).alias("escaped_sha1"))


_TOCS = [(1, "Contents", "<p>One ..... 12</p>"), (2, " TOC ", '<a href="#a">A</a><a href="#b">B</a><a href="#c">C</a>'), (3, "Contents", "<p>plain prose</p>"), (4, "Chapter", "One .... 3"), (5, "Table of Contents", '<a href="#a">A</a><a href="/b">B</a>')]


@query(f"""WITH t(pos, title, html) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, a, b in _TOCS)})
SELECT CAST(pos AS BIGINT) AS pos, lower(trim(title)) IN {numbering.CONTENTS} AND (regexp_matches(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\.{{3,}}\\s*\\d') OR len(regexp_extract_all(html, '(?i)<a\\b[^>]*href="#')) >= 3) AS is_toc FROM t""")
def source_tocs(spark, sf_dir):
    t = spark.createDataFrame(_TOCS, "pos long, title string, html string")
    return t.select("pos", numbering.is_source_toc(F.col("title"), F.col("html")).alias("is_toc"))


@query("""WITH f AS (SELECT conv_id, 0 AS part, turn, role FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, 1, turn, role FROM conversations WHERE role <> 'system' UNION ALL
  SELECT conv_id, 2, 0, 'references' FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) - 1 AS pos FROM f""")
def matter_order(spark, sf_dir):
    """Front matter, chapters and back matter as one union-all with positions counted anew."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("pos"), "role")
    back = t.select("book_id").distinct().select("book_id", F.lit(0).cast("long").alias("pos"), F.lit("references").alias("role"))
    out = books.append(t.filter("role = 'system'"), t.filter("role <> 'system'"), back)
    return out.select(F.col("book_id").alias("conv_id"), "role", "pos")


@query(f"""WITH {_LINKS}, k AS (SELECT host, target, page_id * 1000000 + pos AS place, regexp_replace(regexp_replace(target, '#.*$', ''), '/+$', '') AS key FROM links)
SELECT host, arg_min(target, place) AS target, count(*) AS uses FROM k GROUP BY host, key""")
def distinct_targets(spark, sf_dir):
    """Targets that differ by more than an anchor or a last slash; the first one stays."""
    key = F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "/+$", "")
    return _links(spark, sf_dir).withColumn("key", key).groupBy("host", "key").agg(F.min_by("target", F.struct("page_id", "pos")).alias("target"), F.count("*").alias("uses")).drop("key")


_ANCHORS = r"anchors AS (SELECT DISTINCT page_id, name FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<[a-z][^>]*?\\b(?:id|name)=\"([^\"]*)\"', 1)) AS name FROM pages) WHERE name <> '')"


@query(rf"""WITH {_LINKS},
places AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS place FROM pages), {_ANCHORS}
SELECT page_id, pos, href FROM links l WHERE starts_with(href, '#') AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.page_id = l.page_id AND a.name = substr(href, 2))
UNION ALL SELECT page_id, pos, href FROM links WHERE NOT starts_with(href, '#') AND regexp_replace(regexp_replace(target, '[?#].*$', ''), '/+$', '') NOT IN (SELECT place FROM places)""")
def dangling_references(spark, sf_dir):
    """References of all pages that lead nowhere: to an anchor that their page lacks, or to a page that is not in the table."""
    rows = _links(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    inside = rows.filter(F.startswith("href", F.lit("#"))).withColumn("name", F.expr("substring(href, 2)"))
    anchors = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<[a-z][^>]*?\b(?:id|name)="([^"]*)"'), F.lit(1))).alias("name")).filter("name <> ''")
    place = lambda c: F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "/+$", "")
    outside = rows.filter(~F.startswith("href", F.lit("#"))).withColumn("place", place("target"))
    known = pages.select(place("url").alias("place")).distinct()
    lost = inside.join(anchors, ["page_id", "name"], "left_anti").select("page_id", "pos", "href")
    return lost.unionByName(outside.join(known, "place", "left_anti").select("page_id", "pos", "href"))


@query("""WITH l AS (SELECT doc_id, u - 1 AS line_no, l[u] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
f AS (SELECT *, length(line) < 200 AS short, lag(length(line) < 200) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM l)
SELECT doc_id, line_no, CAST(CASE WHEN short THEN sum(CASE WHEN short AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) ELSE 0 END AS BIGINT) AS run FROM f""")
def list_runs(spark, sf_dir):
    """Islands of short lines get ids that are unique in the document, as contiguous lists do."""
    rows = layout.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text").withColumn("line_no", F.col("line_no").cast("long"))
    out = numbering.renumber_runs(rows, "doc_id", "line_no", F.length("line") < 200)
    return out.select("doc_id", "line_no", F.coalesce("run", F.lit(0)).cast("long").alias("run"))


@query("""SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'title' WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'opens' ELSE 'goes on' END AS kind FROM conversations""")
def turn_openers(spark, sf_dir):
    """Which turns open a part: a lag over the book's order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    kind = F.when(F.lag("turn").over(w).isNull(), "title").when(F.lag("role").over(w) != F.col("role"), "opens").otherwise("goes on")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"))
