"""Queries over pages as rows of nodes, and closures over their links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import closure, dom
from quire.plans.catalogue import _LINES, _LINKS, _UNESCAPE, _lines, _links, query, table
from quire.runtime import materialize

# some headings of these pages end in "&amp" without its semicolon, which HTML reads as the sign too
_SHOWN = _UNESCAPE.format("regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&amp([^;]|$)', '&amp;\\1', 'g')")
_CHARS = f"CAST(length(regexp_replace({_SHOWN}, '\\s', '', 'g')) AS BIGINT)"
_COMMAS = f"CAST(length({_SHOWN}) - length(translate({_SHOWN}, ',、', '')) AS BIGINT)"


def _elements(spark, sf_dir):
    """Every element of every page with the measures of its subtree, written once."""
    return materialize(dom.measured(dom.nodes(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id"), "elements")


# In these pages only paragraphs vote: an article's text is cut at <p>.  A bold run that is never closed keeps its paragraph open, and
# all later paragraphs lie inside it; else </p> ends both.
@query(rf"""WITH art AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages),
seg AS (SELECT page_id, i - 1 AS j, s[i] AS t, len(s) AS n FROM (SELECT page_id, string_split(inner_html, '<p>') AS s, unnest(range(1, len(string_split(inner_html, '<p>')) + 1)) AS i FROM art)),
part AS (SELECT page_id, j, contains(t, '<b>') AND NOT contains(t, '</p>') AS open, {_CHARS.format("t")} AS c, {_COMMAS.format("t")} AS k FROM seg),
span AS (SELECT *, sum(c) OVER w AS rest_c, sum(k) OVER w AS rest_k FROM part WINDOW w AS (PARTITION BY page_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
block AS (SELECT page_id, j, CASE WHEN open THEN rest_c ELSE c END AS chars, 1 + least(CASE WHEN open THEN rest_c ELSE c END / 100, 3) + CASE WHEN open THEN rest_k ELSE k END AS w FROM span WHERE j > 0),
voter AS (SELECT * FROM block WHERE chars >= {dom.LEAST}),
near AS (SELECT v.page_id, v.j, v.w, o.j AS o, row_number() OVER (PARTITION BY v.page_id, v.j ORDER BY o.j DESC) AS r, o.rest_c FROM voter v JOIN span o ON o.page_id = v.page_id AND o.open AND o.j < v.j AND o.j > 0),
depth AS (SELECT v.page_id, v.j, v.w, 2 * count(n.o) + 1 AS level FROM voter v LEFT JOIN near n ON n.page_id = v.page_id AND n.j = v.j GROUP BY ALL),
given AS (SELECT page_id, 'b' AS tag, 2 * o + 1 AS place, rest_c AS chars, 2 * r - 1 AS level, w FROM near UNION ALL SELECT page_id, 'p', 2 * o, rest_c, 2 * r, w FROM near
  UNION ALL SELECT d.page_id, 'article', 0, a.c, level, w FROM depth d JOIN (SELECT page_id, sum(c) AS c FROM part GROUP BY 1) a ON a.page_id = d.page_id),
score AS (SELECT page_id, tag, place, any_value(chars) AS chars, count(*) AS blocks, sum(w / ([1.0, 2.0, 6.0, 9.0, 12.0])[level]) AS score FROM given WHERE level <= 5 GROUP BY page_id, tag, place)
SELECT page_id, tag, blocks, round(score, 6) AS score, CAST(chars AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(score, 9) DESC, place) AS n FROM score) WHERE n = 1""")
def article_votes(spark, sf_dir):
    """The element that the blocks of each page vote for most: votes, link shares and the choice are aggregates over rows of nodes."""
    chosen = dom.best(dom.votes(_elements(spark, sf_dir), "page_id"), "page_id")
    return chosen.select("page_id", "tag", "blocks", F.round("score", 6).alias("score"), "chars")


_BODY = "regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_LIST = "list_aggregate(list_transform(regexp_extract_all(body, '{0}', 1), lambda t: " + _CHARS.format("t") + "), 'sum')"


@query(rf"""WITH b AS (SELECT page_id, {_BODY} AS body FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(body, '<[a-zA-Z]')) + 2 AS BIGINT) AS elements, CAST(len(regexp_extract_all(body, '<a href=')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(body, '(?s)<h1>(.*?)</h1>', 1)) AS BIGINT) AS headings, CAST(coalesce({_LIST.format("(?s)<h1>(.*?)</h1>")}, 0) AS BIGINT) AS heading_chars FROM b""")
def page_elements(spark, sf_dir):
    """What one table of elements tells of each page: elements, links, headings and the text of these."""
    every = _elements(spark, sf_dir)
    counts = every.filter("tag <> '#root'").groupBy("page_id").agg(F.count("*").alias("elements"))
    linked = dom.links(every, "page_id").groupBy("page_id").agg(F.count("*").alias("links"))
    heads = dom.headings(every, "page_id").groupBy("page_id").agg(F.count("*").alias("headings"), F.sum("chars").alias("heading_chars"))
    out = counts.join(linked, "page_id", "left").join(heads, "page_id", "left")
    return out.select("page_id", "elements", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "headings", "heading_chars")])


_STEPS = """target AS (SELECT DISTINCT host, target FROM links), turn AS (SELECT host, target, coalesce(lead(target) OVER w, first_value(target) OVER w) AS next FROM target WINDOW w AS (PARTITION BY host ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
step AS (SELECT host || ' ' || target AS source, host || ' ' || next AS next FROM turn WHERE length(target) % 4 <> 0)"""


@query(rf"""WITH RECURSIVE {_LINKS}, {_STEPS},
walk AS (SELECT source, next AS here, 1 AS hops FROM step UNION ALL SELECT w.source, s.next, w.hops + 1 FROM walk w JOIN step s ON s.source = w.here WHERE w.hops <= 10),
ends AS (SELECT source, max(hops) AS hops, arg_max(here, hops) AS here FROM walk GROUP BY source)
SELECT source, CASE WHEN hops <= 10 THEN here END AS final, CAST(CASE WHEN hops <= 10 THEN hops ELSE 0 END AS BIGINT) AS hops, CASE WHEN hops > 10 THEN 'more than 10 steps' END AS error FROM ends""")
def redirect_targets(spark, sf_dir):
    """Where the links of each site end up, if each target whose length isn't divisible by four redirects to the next one of its site, the last to the first."""
    targets = _links(spark, sf_dir).select("host", "target").distinct()
    order = Window.partitionBy("host").orderBy("target")
    after = F.coalesce(F.lead("target").over(order), F.first("target").over(order))
    steps = targets.withColumn("next", after).filter(F.length("target") % 4 != 0)
    return closure.followed(steps.select(F.concat_ws(" ", "host", "target").alias("source"), F.concat_ws(" ", "host", "next").alias("next")), "source", "next").withColumn("hops", F.coalesce("hops", F.lit(0)).cast("long"))


@query(rf"""WITH RECURSIVE {_LINES}, own AS (SELECT doc_id, line_no, length(line) % 5 AS kind, length(line) AS n FROM lines),
base AS (SELECT doc_id, line_no, line_no - 1 - kind AS parent, CASE WHEN n % 3 = 0 THEN n END AS size, CASE WHEN n % 7 = 0 THEN n END AS lead FROM own),
walk AS (SELECT doc_id, line_no, parent, size, lead, 0 AS d FROM base UNION ALL SELECT w.doc_id, w.line_no, b.parent, coalesce(w.size, b.size), coalesce(w.lead, b.lead), d + 1 FROM walk w JOIN base b ON b.doc_id = w.doc_id AND b.line_no = w.parent WHERE d < 63)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(coalesce(any_value(size), 0) AS BIGINT) AS size, CAST(coalesce(any_value(lead), 0) AS BIGINT) AS lead FROM (SELECT *, max(d) OVER (PARTITION BY doc_id, line_no) AS deepest FROM walk) WHERE d = deepest GROUP BY doc_id, line_no""")
def inherited_styles(spark, sf_dir):
    """Lines as styles: each is based on a line up to five before it, and takes size and leading from the nearest that sets them."""
    n = F.length("line")
    rows = _lines(spark, sf_dir).select("doc_id", "line_no", F.struct("doc_id", "line_no").alias("style"), F.struct("doc_id", (F.col("line_no") - 1 - n % 5).alias("line_no")).alias("parent"), F.when(n % 3 == 0, n).alias("size"), F.when(n % 7 == 0, n).alias("lead"))
    return closure.inherited(rows, "style", "parent", ["size", "lead"]).select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("line_no", "size", "lead")])
