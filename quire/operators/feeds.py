"""Feed policy: which items, in which order, and whose text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.url import host_key, is_index, same_site

SUMMARY, FULL_PAGE, NEAR_EMPTY = 500, 300, 40


def most_recent(items: DataFrame, feed: str, date: str, pos: str, n: int) -> DataFrame:
    """The n most recent items of each feed; undated last, ties in document order.  rank says which."""
    w = Window.partitionBy(feed).orderBy(F.col(date).desc_nulls_last(), F.col(pos))
    return items.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def reading_order(items: DataFrame, feed: str, date: str, pos: str, order: str = "auto") -> DataFrame:
    """place: auto and asc by date, undated last; desc the exact reverse; keep as in the document."""
    by = {
        "auto": [F.col(date).asc_nulls_last(), F.col(pos).asc()],
        "asc": [F.col(date).asc_nulls_last(), F.col(pos).asc()],
        "desc": [F.col(date).desc_nulls_first(), F.col(pos).desc()],
        "keep": [F.col(pos).asc()],
    }[order]
    return items.withColumn("place", F.row_number().over(Window.partitionBy(feed).orderBy(*by)).cast("long"))


def unanimous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The only non-empty value of each key, else null."""
    v = F.when(F.col(value) != "", F.col(value))
    return rows.groupBy(key).agg(F.when(F.min(v) == F.max(v), F.max(v)).alias("hint"), F.count("*").alias("n"))


def majority_host(items: DataFrame, feed: str, link: str, site: str) -> DataFrame:
    """The one foreign host that all items of a feed link to (two links at least), else an empty string."""
    rows = items.select(feed, F.col(site).alias("site"), F.when(F.col(link) != "", host_key(F.col(link))).alias("host"))
    h = F.when(F.col("host") != "", F.col("host"))
    by = rows.groupBy(feed).agg(F.min(h).alias("low"), F.max(h).alias("high"), F.count("host").alias("linked"), F.min("site").alias("site"))
    good = (F.col("low") == F.col("high")) & (F.col("linked") >= 2) & ~same_site(F.col("low"), F.col("site"))
    return by.select(feed, F.when(good, F.col("low")).otherwise(F.lit("")).alias("host"))


def first_hint(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The first value in order that is there."""
    there = F.col(value).isNotNull() & (F.col(value) != "")
    return rows.groupBy(key).agg(F.min_by(F.col(value), F.when(there, F.col(pos))).alias("hint"), F.min(F.when(there, F.col(pos))).alias("at"))


def wants_page(link: Column, feed_url: Column, site_host: Column, foreign_host: Column, length: Column, fetch_full: bool | None, auto_full: bool = True) -> Column:
    """Is the item's own page worth reading?  fetch_full None: only for short items of this site."""
    plain = lambda u: F.regexp_replace(u, "/+$", "")
    usable = link.isNotNull() & (link != "") & (plain(link) != plain(feed_url)) & ~is_index(link)
    if fetch_full is not None or not auto_full:
        return usable if fetch_full else F.lit(False)
    foreign = (foreign_host != "") & (length < NEAR_EMPTY) & (host_key(link) == foreign_host)
    return usable & (length < SUMMARY) & (same_site(host_key(link), site_host) | foreign)


def page_wins(page_length: Column, page_image: Column, item_length: Column, item_image: Column, forced: Column) -> Column:
    """A page's text replaces the feed's if it is longer, no stub, and not traded for an image."""
    enough = forced | (page_length >= FULL_PAGE) | (item_length < NEAR_EMPTY)
    return (page_length > item_length) & enough & ~((item_length < NEAR_EMPTY) & item_image & ~page_image)


def choose_text(items: DataFrame, pages: DataFrame, link: str = "link", url: str = "url", forced: bool = False) -> DataFrame:
    """Items with the text that goes into the book: left join to the fetched pages (url, html, length, image).

    items has link, html, length, image and wants; near-empty results without an image are dropped.  Items that
    want no page take no part in the join.
    """
    p = pages.select(F.col(url).alias("page_url"), F.col("html").alias("page_html"), F.col("length").alias("page_length"), F.col("image").alias("page_image"))
    wanting = F.coalesce(F.col("wants"), F.lit(False)) & F.col(link).isNotNull()
    rows = items.filter(wanting).join(p, F.col(link) == F.col("page_url"), "left").unionByName(items.filter(~wanting), allowMissingColumns=True)
    wins = F.coalesce(page_wins(F.col("page_length"), F.col("page_image"), F.col("length"), F.col("image"), F.lit(forced)), F.lit(False))
    rows = rows.withColumns({"from_page": wins, "html": F.when(wins, F.col("page_html")).otherwise(F.col("html")), "length": F.when(wins, F.col("page_length")).otherwise(F.col("length")), "image": F.when(wins, F.col("page_image")).otherwise(F.col("image"))})
    return rows.filter((F.col("length") >= NEAR_EMPTY) | F.col("image")).drop("page_url", "page_html", "page_length", "page_image")
