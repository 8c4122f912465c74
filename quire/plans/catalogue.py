"""The queries over the driver's tables, each with the SQL that DuckDB runs for the same rows.

Every link of the sample pages stands in their navigation, which extraction drops; the link
queries read raw pages with resolved addresses and show the numbering rules, not extraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import url as U
from quire.operators import books, feeds, layout, links, numbering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- SQL fragments -----------------------------------------------------------------------------

_HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"
_WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&')"
_COUNT = r"CAST(len(list_filter(regexp_split_to_array(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')) AS BIGINT)"
_LINKS = rf"""
links AS (
  SELECT host, page_id, u - 1 AS pos, origin, l[u] AS href,
    CASE WHEN regexp_matches(l[u], '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l[u] WHEN starts_with(l[u], '/') THEN origin || l[u] ELSE l[u] END AS target
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS u FROM (
    SELECT page_id, {_HOST.format("url")} AS host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
      regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"', 1) AS l FROM pages))
)"""
_DAY = "CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('day', ts) END"
_LINES = "lines AS (SELECT doc_id, source, u - 1 AS line_no, l[u] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS u FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))"
_PARAGRAPHS = r"list_transform(list_filter(list_transform(regexp_split_to_array({0}, '\n\s*\n+'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> ''), lambda b: regexp_replace(b, '\s*\n\s*', ' ', 'g'))"
_ESCAPE = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = links.hrefs(pages, [U.host_key(F.col("url")).alias("host"), F.col("page_id"), F.col("url")], "html")
    return links.resolved(rows, "url")


def _events(spark, sf_dir):
    day = F.when(F.col("event_type") != "error", F.date_trunc("day", "ts"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", day.alias("day"))


def _lines(spark, sf_dir):
    return layout.lines(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def _chapters(spark, sf_dir, html=True, numbers=True):
    """Conversations as books: a turn is a chapter, a system turn is matter.  Numbers, and bodies of chapters, where they are wanted."""
    t = table(spark, sf_dir, "conversations")
    title = F.substring(T.normalize_ws(F.regexp_extract("text", "^([^\\n]*)", 1)), 1, 40)
    rows = t.select("conv_id", "turn", "role", title.alias("title"), *[T.text_to_html(F.col("text")).alias("html")] * html)
    return numbering.chapter_sequence(rows, "conv_id", "turn", F.col("role") != "system") if numbers else rows


_CHAPTERS = rf"""chapters AS (
  SELECT conv_id, turn, role <> 'system' AS numbered, substr({_WS.format(r"regexp_extract(text, '^([^\n]*)', 1)")}, 1, 40) AS title,
    list_aggregate(list_transform({_PARAGRAPHS.format("text")}, lambda p: '<p>' || {_ESCAPE.format("p")} || '</p>'), 'string_agg', chr(10)) AS html,
    CASE WHEN role <> 'system' THEN sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END AS seq
  FROM conversations)"""

# -- scalar functions and scans ------------------------------------------------------------------


@query(f"SELECT page_id, {_WS.format(_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", links.page_title(F.col("html")).alias("title"))


@query(f"WITH {_LINKS} SELECT page_id, pos, href FROM links")
def page_links(spark, sf_dir):
    return links.hrefs(table(spark, sf_dir, "pages"), [F.col("page_id")], "html")


@query(f"SELECT page_id, {_HOST.format('url')} AS host FROM pages")
def host_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.host_key(F.col("url")).alias("host"))


@query(rf"""SELECT page_id, concat_ws(' ', lower(regexp_extract(url, '(?:^[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), CASE WHEN p = '' THEN '/' ELSE p END,
  coalesce(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|source=|ref=|mc_cid=|mc_eid=)'))), '&'), '')) AS key
FROM (SELECT page_id, url, regexp_replace(regexp_replace({_PATH.format("url")}, ';[^/]*$', ''), '/+$', '') AS p, {_QUERY.format("url")} AS q FROM pages)""")
def url_item_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.item_key(F.col("url")).alias("key"))


_SAMPLE_URLS = ("https://a.example.org", "https://a.example.org/", "https://a.example.org/Blog/", "https://a.example.org/%62log", "https://a.example.org/blog/my-post", "https://a.example.org/?p=12", "https://a.example.org/index.html#top", "https://a.example.org/archives/?", "https://a.example.org/news+more")


@query(f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest({list(_SAMPLE_URLS)}))
SELECT url, {_QUERY.format("url")} = '' AND lower(regexp_replace(url_decode({_PATH.format("url")}), '^/+|/+$', '', 'g')) IN {U.INDEX_PATHS} AS is_index FROM u""")
def index_url_flags(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url").unionAll(spark.createDataFrame([(x,) for x in _SAMPLE_URLS], "url string"))
    return urls.select("url", U.is_index(F.col("url")).alias("is_index"))


@query(rf"""WITH h AS (SELECT DISTINCT {_HOST.format("url")} AS host FROM pages), s AS (SELECT host AS site FROM h UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM h)
SELECT host, site FROM h, s WHERE host <> '' AND site <> '' AND (host = site OR ends_with(host, '.' || site) OR ends_with(site, '.' || host))""")
def same_site_pairs(spark, sf_dir):
    """An equi-join on the domains above each host, in both directions; no pair is tried that doesn't match."""
    h = table(spark, sf_dir, "pages").select(U.host_key(F.col("url")).alias("host")).distinct()
    s = h.select(F.col("host").alias("site")).union(h.select(F.regexp_replace("host", "^[^.]*\\.", ""))).distinct()
    up = h.select("host", F.explode(U.suffixes(F.col("host"))).alias("site")).join(s, "site").select("host", "site")
    down = s.select("site", F.explode(U.suffixes(F.col("site"))).alias("host")).join(h, "host").select("host", "site")
    return up.union(down).distinct().filter("host <> '' and site <> ''")


@query(rf"""SELECT doc_id, coalesce(list_aggregate(list_transform({_PARAGRAPHS.format("text")}, lambda p: '<p>' || {_ESCAPE.format("p")} || '</p>'), 'string_agg', chr(10)), '') AS html,
  coalesce(list_aggregate(list_transform({_PARAGRAPHS.format("replace(text, chr(10), chr(10) || chr(10))")}, lambda p: '<p>' || {_ESCAPE.format("p")} || '</p>'), 'string_agg', chr(10)), '') AS html_by_line FROM documents""")
def text_to_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_to_html(F.col("text")).alias("html"), T.text_to_html(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("html_by_line"))


@query(f"SELECT doc_id, {_COUNT.format("'<p>' || text || '</p>'")} AS words FROM documents")
def doc_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.concat(F.lit("<p>"), "text", F.lit("</p>"))).alias("words"))


@query(r"""SELECT doc_id, list_aggregate(list_transform(list_filter(regexp_split_to_array(regexp_replace(source || '_' || lang || '--first-part', '[-_]+', ' ', 'g'), '\s+'), lambda w: w <> ''),
  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS title FROM documents""")
def prettify_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prettify(F.concat("source", F.lit("_"), "lang", F.lit("--first-part"))).alias("title"))


@query("SELECT name, CAST(min(doc_id) AS BIGINT) AS first, count(*) AS uses FROM (SELECT doc_id, 'images/img-' || substr(sha1(text), 1, 12) || '.txt' AS name FROM documents) GROUP BY name")
def asset_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("book"), "doc_id", books.asset_name(F.col("text").cast("binary"), F.lit(".txt")).alias("name"))
    return books.distinct_assets(d, "book", "name", "doc_id").select("name", "first", "uses")


@query(f"SELECT doc_id, CAST(length({_WS.format('text')}) AS BIGINT) AS visible FROM documents WHERE length({_WS.format('text')}) < {feeds.NEAR_EMPTY}")
def near_empty_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize_ws(F.col("text"))).cast("long").alias("visible"))
    return d.filter(F.col("visible") < feeds.NEAR_EMPTY)


# -- feeds ---------------------------------------------------------------------------------------


@query(f"""SELECT * FROM (SELECT user_id, event_id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC NULLS LAST, event_id) AS rank
  FROM (SELECT *, {_DAY} AS day FROM events)) WHERE rank <= 5""")
def top_n_recent(spark, sf_dir):
    top = feeds.most_recent(_events(spark, sf_dir), "user_id", "day", "event_id", 5)
    return top.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY day ASC NULLS LAST, event_id) AS ascending,
  row_number() OVER (PARTITION BY user_id ORDER BY day DESC NULLS FIRST, event_id DESC) AS descending, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS kept
  FROM (SELECT *, {_DAY} AS day FROM events)""")
def feed_order_desc(spark, sf_dir):
    e = _events(spark, sf_dir)
    for order, name in (("auto", "ascending"), ("desc", "descending"), ("keep", "kept")):
        e = feeds.reading_order(e, "user_id", "day", "event_id", order).withColumnRenamed("place", name)
    return e.drop("day")


@query("SELECT key, CASE WHEN min(lang) = max(lang) THEN max(lang) END AS hint, count(*) AS n FROM (SELECT sha1(text) AS key, lang FROM documents) GROUP BY key")
def unanimous_value(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha1("text").alias("key"), "lang")
    return feeds.unanimous(d, "key", "lang")


@query(rf"""WITH p AS (SELECT {_HOST.format("url")} AS host, substr(regexp_extract(url, '([^/]*)$', 1), 1, 1) AS tail, page_id FROM pages),
g AS (SELECT host || ':' || (page_id % 3) AS feed, host, CASE WHEN page_id % 2 = 0 THEN host ELSE 'feeds.example' END AS site FROM p)
SELECT feed, CASE WHEN min(host) = max(host) AND count(host) >= 2 AND NOT (min(host) = min(site) OR ends_with(min(host), '.' || min(site)) OR ends_with(min(site), '.' || min(host))) THEN min(host) ELSE '' END AS host
FROM g GROUP BY feed""")
def majority_host(spark, sf_dir):
    host = U.host_key(F.col("url"))
    items = table(spark, sf_dir, "pages").select(F.concat(host, F.lit(":"), (F.col("page_id") % 3).cast("string")).alias("feed"), "url", F.when(F.col("page_id") % 2 == 0, host).otherwise("feeds.example").alias("site"))
    return feeds.majority_host(items, "feed", "url", "site")


@query("SELECT source, arg_min(v, doc_id) AS hint, min(doc_id) AS at FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || doc_id END AS v FROM documents) WHERE v IS NOT NULL GROUP BY source")
def first_source_hint(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.col("doc_id").cast("string"))).alias("v"))
    return feeds.first_hint(d, "source", "v", "doc_id")


# -- numbering -----------------------------------------------------------------------------------


@query(f"WITH {_CHAPTERS} SELECT conv_id, turn, CAST(coalesce(seq, 0) AS BIGINT) AS seq, CAST(CAST(seq AS BIGINT) AS VARCHAR) AS display FROM chapters")
def chapter_numbering(spark, sf_dir):
    return _chapters(spark, sf_dir, html=False).select("conv_id", "turn", F.coalesce("seq", F.lit(0)).alias("seq"), "display")


@query(f"""WITH {_CHAPTERS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry,
  CASE WHEN seq IS NOT NULL THEN CAST(CAST(seq AS BIGINT) AS VARCHAR) || '. ' || title ELSE title END AS label FROM chapters WHERE title <> ''""")
def book_toc(spark, sf_dir):
    return books.contents(_chapters(spark, sf_dir, html=False), "conv_id", "turn", "title", "display")


@query(f"""WITH {_CHAPTERS} SELECT conv_id, count(*) FILTER (numbered) AS chapters, count(*) FILTER (NOT numbered) AS matter,
  CAST(sum({_COUNT.format("coalesce(html, '')")}) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(coalesce(html, ''), '(?i)<img\\b'))) AS BIGINT) AS images FROM chapters GROUP BY conv_id""")
def book_stats(spark, sf_dir):
    return books.stats(_chapters(spark, sf_dir, numbers=False), "conv_id", F.col("role") != "system", "html")


@query(f"""WITH {_CHAPTERS} SELECT conv_id, string_agg('<section id="chapter-' || turn || '">' || CASE WHEN seq IS NOT NULL THEN '<p class="chapter-number">Chapter ' || CAST(seq AS BIGINT) || '</p>' ELSE '' END
  || '<h1>' || {_ESCAPE.format("title")} || '</h1>' || coalesce(html, '') || '</section>', '' ORDER BY turn) AS html FROM chapters GROUP BY conv_id""")
def print_html(spark, sf_dir):
    section = F.concat(F.lit('<section id="chapter-'), F.col("turn").cast("string"), F.lit('">'), books.chapter_head(F.col("display"), F.col("title")), F.col("html"), F.lit("</section>"))
    return books.print_html(_chapters(spark, sf_dir), "conv_id", "turn", section)


_TITLES = [
    ("roman", ["INTRODUCTION", "I. First Steps", "II. The Road", "III. Home", "IV. After", "REFERENCES"]),
    ("arabic", ["Preface", "1. One", "2. Two", "3.  Three"]),
    ("single", ["Opening", "1. Only", "Closing"]),
    ("odyssey", ["2001. A Space Tale", "2010. Another", "Notes"]),
    ("skips", ["I. One", "III. Three", "Appendix: Tables", "appendix B"]),
    ("none", ["Foreword", "IV Drips", "I met a traveller", "Index"]),
    ("long", [f"{n}. Part" for n in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI")] + ["Glossary"]),
]


def _title_rows():
    return [(book, i, t) for book, titles in _TITLES for i, t in enumerate(titles)]


_VALUE = "CASE {0} WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END"


@query(rf"""WITH t(book, pos, title) AS (VALUES {", ".join(f"('{b}', {i}, '{t}')" for b, i, t in _title_rows())}),
m AS (SELECT *, regexp_extract(title, '^\s*(\d{{1,4}}|[IVXLCDM]{{1,8}})\.\s+(\S.*)$', 1) AS fig, regexp_extract(title, '^\s*(\d{{1,4}}|[IVXLCDM]{{1,8}})\.\s+(\S.*)$', 2) AS rest FROM t),
v AS (SELECT *, CASE WHEN fig = '' THEN NULL WHEN regexp_matches(fig, '^[0-9]+$') THEN CAST(fig AS BIGINT)
  ELSE CAST(list_sum(list_transform(range(1, length(fig) + 1), lambda i: CASE WHEN {_VALUE.format("fig[i + 1]")} > {_VALUE.format("fig[i]")} THEN -{_VALUE.format("fig[i]")} ELSE {_VALUE.format("fig[i]")} END)) AS BIGINT) END AS value FROM m),
r AS (SELECT *, count(value) OVER (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rank FROM v),
b AS (SELECT book, count(value) >= 2 AND coalesce(bool_and(value = rank) FILTER (value IS NOT NULL), false) AS typed FROM r GROUP BY book)
SELECT r.book, CAST(pos AS BIGINT) AS pos, CASE WHEN typed AND fig <> '' THEN rest ELSE title END AS title,
  CASE WHEN typed THEN fig <> '' ELSE NOT (lower(trim(title)) IN {numbering.UNNUMBERED} OR starts_with(lower(trim(title)), 'appendix ') OR starts_with(lower(trim(title)), 'appendix:')) END AS numbered,
  CASE WHEN typed AND fig <> '' THEN fig END AS number FROM r JOIN b ON r.book = b.book""")
def typed_figures(spark, sf_dir):
    return numbering.classify(spark.createDataFrame(_title_rows(), "book string, pos long, title string"), "book", "pos")


@query(f"WITH {_LINKS} SELECT host, page_id, pos, target, row_number() OVER (PARTITION BY host ORDER BY page_id, pos) AS number, 'L' || row_number() OVER (PARTITION BY host ORDER BY page_id, pos) AS label FROM links")
def link_numbers(spark, sf_dir):
    n = numbering.link_numbers(_links(spark, sf_dir), "host", ["page_id", "pos"])
    return n.select("host", "page_id", "pos", "target", "number", T.link_label(F.col("number")).alias("label"))


_FIRST = f"{_LINKS}, firsts AS (SELECT host, target, row_number() OVER (PARTITION BY host ORDER BY f) AS number FROM (SELECT host, target, min(CAST(page_id AS HUGEINT) * 1000000 + pos) AS f FROM links GROUP BY ALL))"


@query(f"WITH {_FIRST} SELECT l.host, l.page_id, l.pos, l.target, number FROM links l JOIN firsts f ON l.host = f.host AND l.target = f.target")
def endnote_numbers(spark, sf_dir):
    return numbering.endnote_numbers(_links(spark, sf_dir), "host", "target", ["page_id", "pos"]).select("host", "page_id", "pos", "target", "number")


@query(f"""WITH {_FIRST} SELECT host, number, target, '<p class="endnote" id="ln-' || number || '"><a class="linknote-label" href="#lnref-' || number || '">L' || number || '</a> <a class="linknote-url" href="' || {_ESCAPE.format("target")} || '">' || {_ESCAPE.format("target")} || '</a></p>' AS html FROM firsts""")
def endnote_list(spark, sf_dir):
    n = numbering.endnotes(_links(spark, sf_dir), "host", "target", ["page_id", "pos"])
    number, target = F.col("number").cast("string"), T.escape_html(F.col("target"))
    html = F.concat(F.lit('<p class="endnote" id="ln-'), number, F.lit('"><a class="linknote-label" href="#lnref-'), number, F.lit('">'), T.link_label(F.col("number")), F.lit('</a> <a class="linknote-url" href="'), target, F.lit('">'), target, F.lit("</a></p>"))
    return n.select("host", "number", "target", html.alias("html"))


_CITED = "cites AS (SELECT DISTINCT target, host AS site, regexp_replace(target, '^.*/', '') AS title FROM links WHERE length(target) % 2 = 0)"


def _citations(rows):
    known = rows.filter(F.length("target") % 2 == 0).select("target", F.col("host").alias("site"), F.regexp_replace("target", "^.*/", "").alias("title")).distinct()
    return known


@query(f"""WITH {_LINKS}, {_CITED} SELECT l.host, l.page_id, l.pos, l.target, CASE WHEN c.target IS NULL THEN l.target ELSE CASE WHEN regexp_matches(c.title, '[.?!…]$') THEN c.title ELSE c.title || '.' END || ' (n.d.). '
  || CASE WHEN regexp_matches(c.site, '[.?!…]$') THEN c.site ELSE c.site || '.' END || ' ' || l.target END AS note FROM links l LEFT JOIN cites c ON l.target = c.target""")
def citation_join(spark, sf_dir):
    """The known half of the targets stands for fetched citations; the rest keep the bare address."""
    rows = _links(spark, sf_dir)
    known = _citations(rows).withColumn("note", links.citation_text(F.lit(None).cast("string"), F.lit(None).cast("date"), F.col("title"), F.col("site"), F.col("target")))
    return links.cite(rows, known.select("target", "note"), url="target").select("host", "page_id", "pos", "target", F.coalesce("note", "target").alias("note"))


@query(f"WITH {_LINKS}, all_cites AS (SELECT DISTINCT target, host AS site, regexp_replace(target, '^.*/', '') AS title FROM links) SELECT site, target, title, row_number() OVER (PARTITION BY site ORDER BY replace(replace(lower(title), 'ß', 'ss'), 'ς', 'σ'), target) AS place FROM all_cites")
def references_sorted(spark, sf_dir):
    """Every target that a site's pages cite, in the order of a reference list."""
    cited = _links(spark, sf_dir).select("target", F.col("host").alias("site"), F.regexp_replace("target", "^.*/", "").alias("title")).distinct()
    return books.references(cited, "site", F.col("title"), "target")


# -- layout --------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT source, key, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, lower(trim(regexp_replace(line, '[0-9]', '#', 'g'))) AS key FROM lines) WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark, sf_dir):
    return layout.repeated_lines(_lines(spark, sf_dir), "source", "doc_id", "line", 3)


@query(f"""WITH {_LINES}, s AS (SELECT source, length(line) AS size, sum(length(line)) AS weight FROM lines GROUP BY 1, 2),
r AS (SELECT *, sum(weight) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS run, sum(weight) OVER (PARTITION BY source) AS total FROM s)
SELECT source, CAST(min(size) AS BIGINT) AS body FROM r WHERE 2 * run >= total GROUP BY source""")
def body_size_median(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("source", F.length("line").cast("long").alias("size"), F.length("line").cast("long").alias("chars"))
    return layout.weighted_median(rows, "source", "size", "chars")


@query(f"WITH {_LINES}, b AS (SELECT DISTINCT source, CAST(length(line) // 400 AS BIGINT) AS bucket FROM lines WHERE length(line) >= 400) SELECT source, bucket, CAST(least(dense_rank() OVER (PARTITION BY source ORDER BY bucket DESC), 6) AS BIGINT) AS level FROM b")
def heading_ranks(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("bucket", F.floor(F.length("line") / 400))
    return layout.heading_ranks(rows, "source", "bucket", F.length("line") >= 400)


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM lines WHERE length(line) >= 200)
SELECT doc_id, CAST(min(line_no) AS BIGINT) AS start, CAST(max(line_no) AS BIGINT) AS "end", count(*) AS length FROM k GROUP BY doc_id, block""")
def heading_runs(spark, sf_dir):
    return layout.islands(_lines(spark, sf_dir), "doc_id", "line_no", F.length("line") >= 200)


@query(f"""WITH {_LINES}, n AS (SELECT source, length(line) // 10 AS margin, count(*) AS n, min(doc_id * 100000 + line_no) AS first FROM lines GROUP BY 1, 2)
SELECT source, CAST(arg_max(margin, n * 1000000000000 - first) AS BIGINT) AS mode FROM n GROUP BY source""")
def modal_margin(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("source", F.floor(F.length("line") / 10).alias("margin"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("at"))
    return layout.modal(rows, "source", "margin", "at")


@query(rf"""WITH i AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda x: true) AS items,
  length({_WS.format(_UNESCAPE.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"))}) AS text FROM pages)
SELECT page_id, CAST(len(items) AS BIGINT) AS items, CAST(len(list_filter(items, lambda x: regexp_matches(x, '(?i)<a\b'))) AS BIGINT) AS linked,
  CAST(coalesce(list_sum(list_transform(list_filter(items, lambda x: regexp_matches(x, '(?i)<a\b')), lambda x: length({_WS.format(_UNESCAPE.format(r"regexp_replace(x, '<[^>]+>', ' ', 'g')"))}))), 0) AS BIGINT) AS linked_text, CAST(text AS BIGINT) AS text FROM i""")
def link_list_ratios(spark, sf_dir):
    return links.list_ratios(table(spark, sf_dir, "pages"), "page_id", "html")
