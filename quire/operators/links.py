"""Links of pages: extraction by pattern, link lists, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_ws, terminal_period, unescape_named
from quire.functions.url import absolute

HREF = '(?is)<a\\b[^>]*?href="([^"]*)"'
LIST_MIN, ITEM_SHARE, TEXT_SHARE, TEXT_MIN = 5, 0.5, 0.5, 8
# The names of months in citations.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def page_title(html: Column) -> Column:
    return normalize_ws(unescape_named(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))


def hrefs(pages: DataFrame, key: list[Column], html: str) -> DataFrame:
    """One row for each link, with its place on the page."""
    return pages.select(*key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(HREF), 1)).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def resolved(links: DataFrame, base: str) -> DataFrame:
    return links.withColumn("target", absolute(F.col(base), F.col("href")))


def cite(links: DataFrame, citations: DataFrame, target: str = "target", url: str = "url") -> DataFrame:
    """Links with their citation's columns; note is the citation, or the bare address."""
    return links.join(citations.withColumnRenamed(url, target), target, "left")


def visible(html: Column) -> Column:
    """Text between tags, white space folded; a tag counts as a space."""
    return normalize_ws(unescape_named(F.regexp_replace(html, "<[^>]+>", " ")))


def list_ratios(pages: DataFrame, key: str, html: str) -> DataFrame:
    """items, linked items, their text and the page's text: the figures of the link-list test."""
    body = F.regexp_replace(F.regexp_replace(F.col(html), "(?is)<script.*?</script>", ""), "(?is)<style.*?</style>", "")
    items = F.regexp_extract_all(F.col(html), F.lit("(?is)<li\\b[^>]*>(.*?)</li>"), 1)
    linked = F.filter(items, lambda x: x.rlike("(?i)<a\\b"))
    size = F.aggregate(F.transform(linked, lambda x: F.length(visible(x))), F.lit(0), lambda a, b: a + b)
    return pages.select(key, F.size(items).cast("long").alias("items"), F.size(linked).cast("long").alias("linked"), size.cast("long").alias("linked_text"), F.length(visible(body)).cast("long").alias("text"))


def is_link_list(items: Column, linked: Column, linked_text: Column, text: Column, targets: Column) -> Column:
    return (text >= 1) & (items >= LIST_MIN) & (linked >= ITEM_SHARE * items) & (linked_text >= TEXT_SHARE * text) & (targets >= LIST_MIN)


def date_part(date: Column) -> Column:
    months = F.array(*[F.lit(m) for m in MONTHS])
    shown = F.concat(F.lit("("), F.year(date).cast("string"), F.lit(", "), F.element_at(months, F.month(date)), F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(")"))
    return F.coalesce(shown, F.lit("(n.d.)"))


def citation_text(byline: Column, date: Column, title: Column, site: Column, url: Column) -> Column:
    """Author. (Date). Title. Site. URL; without an author the title leads; a site that is the author is left out."""
    bare = lambda c: F.rtrim(F.lower(c), F.lit("."))
    own = F.when(byline.isNull() | (bare(byline) != bare(site)), site)
    lead = F.when(byline.isNotNull(), F.concat(terminal_period(byline), F.lit(" "), date_part(date), F.lit("."), F.lit(" ")))
    after = F.when(byline.isNull(), F.concat(F.lit(" "), date_part(date), F.lit(".")))
    tail = F.when(own.isNotNull() & (own != ""), F.concat(F.lit(" "), terminal_period(own)))
    return F.concat(F.coalesce(lead, F.lit("")), terminal_period(title), F.coalesce(after, F.lit("")), F.coalesce(tail, F.lit("")), F.lit(" "), url)
