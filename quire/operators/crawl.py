"""Web addresses as chapters, over a snapshot of what a crawler fetched.

requests: book_id, pos, url.  snapshot: url, status, content_type, final_url, text; what it lacks could not be
fetched.  A snapshot that holds an address more than once tells its visits apart by a column visit; a request
that has this column too means that visit, and all else that is read is the last visit of its address.  Every address takes one route, decided by columns: it is a feed; a story platform that publishes
its texts in a feed; a page that stands on a mirror; an index page whose site has a feed; a short page whose
site's feed has its text; a page that lists the site's own posts; or an article.  A fetch is a join, so each
address is read once, whoever asks for it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import tree, url as U
from quire.functions.arrow import map_rows
from quire.operators import article, feeds, snapshot as S
from quire.runtime import materialize
from quire.sources import feeds as source

DISCOVERED = 3  # feeds that a page names and that are tried
ASK = ["book_id", "request"]
REFUSED = (403, 406, 429)


class Ingested(NamedTuple):
    """chapters: book_id, request, part, pos, title, html, source, author, date; warnings: book_id, request, message."""

    chapters: DataFrame
    warnings: DataFrame


def fetched(rows: DataFrame, web: DataFrame, address: str) -> DataFrame:
    """rows with status, content_type, final_url and text of an address; without text where the fetch failed or is not there.

    web may have visits: those that rows name are taken, else the last of each address.
    """
    w = web.select(F.col("url").alias("web_url"), "status", "content_type", F.coalesce("final_url", "url").alias("final_url"), F.when(F.col("status") < 400, F.coalesce("text", F.lit(""))).alias("text"), *[F.col(c).alias("web_visit") for c in _visit(web)])
    there = F.col(address) == F.col("web_url")
    if _visit(web):
        if not _visit(rows):
            last = web.groupBy(F.col("url").alias("last_url")).agg(F.max("visit").alias("visit"))
            rows = rows.join(last, F.col(address) == F.col("last_url"), "left").drop("last_url")
        there &= F.col("visit") == F.col("web_visit")
    return rows.join(w, there, "left").drop("web_url", *(["visit", "web_visit"] if _visit(web) else []))


def _visit(rows: DataFrame) -> list[str]:
    return ["visit"] if "visit" in rows.columns else []


def read_page(text: str | None, base: str | None) -> dict:
    """What ``articles`` makes of one page: the page is parsed once, and its article once."""
    page = tree.Fragment(text)
    named = source.discover(page, base or "")  # before the article is cut out of the page
    doc = article.extract(page, base or "")
    doc["date"] = (article.parse_date(doc["date"]) or None) if doc["date"] else None
    doc["date"] = doc["date"].isoformat() if doc["date"] else None
    own = tree.Fragment(doc["html"])
    return doc | {"length": tree.visible_length(own), "image": tree.has_image(own), "feeds": named, "targets": S.list_targets(own, base or "", U.INDEX_PATHS)}


def articles(rows: DataFrame) -> DataFrame:
    """rows (with text and final_url) and title, html, author, date, length, image, the feeds named in the head, and the posts listed."""
    made = "title string, html string, author string, date string, site_name string, length long, image boolean, feeds array<string>, targets array<string>"
    return map_rows(rows.withColumn("base", F.col("final_url")), made, read_page, "text", "base").drop("error")


def _clean(items: DataFrame) -> DataFrame:
    def rule(html, base):
        c = article.clean_fragment(html, base)
        return {"html": c, "length": tree.visible_length(c), "image": tree.has_image(c)}

    return map_rows(items.withColumn("base", F.coalesce(F.when(F.col("link") != "", F.col("link")), "feed_final")), "html string, length long, image boolean", rule, "html", "base").drop("error")


def _candidates(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """Feeds that a request may be served by: feed_url, rank, and the route by which it would be."""
    feed = source.is_feed(F.col("text"), F.coalesce("content_type", F.lit("")))
    direct = asked.filter(F.col("text").isNotNull() & feed).select(*ASK, F.col("url").alias("feed_url"), F.lit(0).alias("rank"), F.lit("feed").alias("route"))
    short = pages.select(*ASK, F.col("url").alias("story_url")).filter(F.col("length") < feeds.FULL_PAGE)
    moved = pages.filter((F.col("length") < feeds.FULL_PAGE) & (F.col("final_url") != F.col("url"))).select(*ASK, F.col("final_url").alias("story_url"))
    refused = asked.filter("status = 403").select(*ASK, F.col("url").alias("story_url"))
    stories = refused.select("*", F.lit(1).alias("rank")).unionByName(short.select("*", F.lit(1).alias("rank"))).unionByName(moved.select("*", F.lit(2).alias("rank")))
    stories = stories.select(*ASK, S.story_feed(F.col("story_url"))["feed"].alias("feed_url"), "rank", F.lit("story").alias("route")).filter("feed_url is not null")
    some = pages.withColumn("index", U.is_index(F.col("final_url"))).filter((F.col("length") < feeds.FULL_PAGE) | F.col("index"))
    route = F.when(F.col("index"), "index").otherwise("item")
    named = some.select(*ASK, "index", route.alias("route"), F.posexplode(F.slice("feeds", 1, DISCOVERED)).alias("rank", "feed_url")).withColumn("rank", F.col("rank") + 10)
    guess = F.array(*[F.concat(F.rtrim(F.col("final_url"), F.lit("/")), F.lit("/"), F.lit(p)) for p in source.COMMON_PATHS])
    guessed = some.filter(F.col("index") & (F.size("feeds") == 0)).select(*ASK, "index", route.alias("route"), F.posexplode(guess).alias("rank", "feed_url")).withColumn("rank", F.col("rank") + 10)
    return direct.unionByName(stories).unionByName(named.unionByName(guessed).drop("index"))


def _story(url: Column) -> Column:
    return S.story_feed(url)["story"]


def ingest(requests: DataFrame, web: DataFrame, order: str = "auto", max_items: int = 0, fetch_full: bool | None = None) -> Ingested:
    """The chapters of all requests in order, and what went wrong or was done in another way.

    order: auto, asc, desc or keep; max_items: the most recent items of a feed, or the first posts of a list (0: all);
    fetch_full: read the pages of feed items always, never, or (None) where the feed gives a summary.  A null or
    repeated address is a request like any other; an empty table gives empty tables.
    """
    asked = fetched(requests.select("book_id", F.col("pos").cast("long").alias("request"), "url", *_visit(requests)), web, "url").drop("visit")
    mirrored = asked.filter(F.col("status").isin(*REFUSED)).select(*ASK, "url", S.mirror(F.col("url")).alias("mirror")).filter("mirror is not null")
    mirrored = fetched(mirrored, web, "mirror").filter("text is not null").withColumn("mirrored", F.lit(True)).drop("mirror", "status", "content_type")
    is_page = F.col("text").isNotNull() & ~source.is_feed(F.col("text"), F.coalesce("content_type", F.lit("")))
    own = asked.filter(is_page).withColumn("mirrored", F.lit(False)).drop("status", "content_type")
    pages = materialize(articles(own.unionByName(mirrored)), "pages")
    pages = pages.filter(~F.col("mirrored") | (F.col("length") >= feeds.NEAR_EMPTY))

    # the feeds that live, and for each request the first of its candidates
    wanted = materialize(_candidates(asked, pages.filter("not mirrored")), "candidates")
    live = fetched(wanted.select("feed_url").distinct(), web, "feed_url").filter(F.col("text").isNotNull() & source.is_feed(F.col("text"), F.coalesce("content_type", F.lit(""))))
    items = materialize(source.feed_items(live, "feed_url", "text").join(live.select("feed_url", F.col("final_url").alias("feed_final")), "feed_url"), "items")
    state = items.groupBy("feed_url").agg(F.max("error").alias("error"), F.count("pos").alias("n"), F.first("feed_final").alias("feed_final"))
    # a feed asked for by name counts even when it is empty; others need items
    usable = (F.col("n") > 0) | ((F.col("route") == "feed") & F.col("error").isNull())
    first = wanted.join(state, "feed_url").filter(usable).groupBy(*ASK).agg(F.min_by(F.struct("feed_url", "route", "n"), "rank").alias("c")).select(*ASK, "c.*")
    asks = asked.select(*ASK, "url", "final_url")
    taken = first.join(asks, ASK).join(items.withColumnRenamed("error", "feed_error"), "feed_url").filter("pos is not null")
    key = U.item_key
    fits = F.when(F.col("route") == "story", _story(F.col("url")).isNull() | F.coalesce(F.col("link").contains(_story(F.col("url"))), F.lit(False)))
    fits = fits.when(F.col("route") == "item", (F.col("link") != "") & ((key(F.col("link")) == key(F.col("final_url"))) | (key(F.col("link")) == key(F.col("url"))))).otherwise(F.lit(True))
    taken = taken.filter(fits)
    once = Window.partitionBy(*ASK).orderBy((key(F.col("link")) != key(F.col("final_url"))).cast("int"), "pos")
    taken = materialize(taken.withColumn("k", F.row_number().over(once)).filter((F.col("route") != "item") | (F.col("k") == 1)).drop("k"), "taken")
    by_feed = materialize(taken.select(*ASK, "route").distinct(), "by-feed")

    # a feed's items: the most recent ones, cleaned, with their pages where these hold more
    ask = F.struct(*ASK)
    hosts = feeds.majority_host(taken.withColumns({"ask": ask, "site": U.host_key(F.coalesce(F.when(F.col("feed_link") != "", F.col("feed_link")), "feed_final"))}), "ask", "link", "site")
    kept = taken.withColumn("ask", ask)
    kept = feeds.most_recent(kept, "ask", "date", "pos", max_items) if max_items else kept.withColumn("rank", F.lit(0).cast("long"))
    kept = feeds.reading_order(kept, "ask", "date", "pos", order).join(hosts.withColumnRenamed("host", "foreign_host"), "ask").drop("ask", "rank")
    clean = materialize(_clean(kept), "clean")
    site = U.host_key(F.coalesce(F.when(F.col("feed_link") != "", F.col("feed_link")), "feed_final"))
    auto = F.col("route").isin("feed", "index")
    wants = F.when(auto | F.lit(fetch_full is True), feeds.wants_page(F.col("link"), F.col("feed_final"), site, F.col("foreign_host"), F.col("length"), fetch_full)).otherwise(F.lit(False))
    clean = clean.withColumn("wants", F.coalesce(wants, F.lit(False)))
    posts = fetched(clean.filter("wants").select("link").distinct(), web, "link")
    read = materialize(articles(posts.filter("text is not null")).select("link", "html", "length", "image"), "item-pages")
    chosen = feeds.choose_text(clean.withColumnRenamed("length", "own_length").withColumn("length", F.col("own_length")), read.withColumnRenamed("link", "url"), forced=fetch_full is True)
    when = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ssXXX")
    from_feeds = chosen.select(*ASK, F.col("place").alias("part"), "title", "html", F.coalesce(F.when(F.col("link") != "", F.col("link")), "feed_final").alias("source"), "author", when.alias("date"))

    # pages that no feed claims: lists of posts, then articles
    rest = pages.join(by_feed.select(*ASK), ASK, "left_anti")
    lists = rest.filter(~F.col("mirrored") & (F.size("targets") > 0)).select(*ASK, "final_url", "url", F.posexplode(F.slice("targets", 1, max_items) if max_items else F.col("targets")).alias("part", "link"))
    listed = materialize(articles(fetched(lists.drop("final_url"), web, "link")).withColumn("good", F.col("length") >= feeds.NEAR_EMPTY), "listed")
    posts_of = listed.filter("good").select(*ASK, F.col("part").cast("long").alias("part"), "title", "html", F.col("link").alias("source"), "author", "date")
    read_lists = listed.groupBy(*ASK, "url").agg(F.count_if("good").alias("n")).filter("n > 0")
    single = rest.join(read_lists.select(*ASK), ASK, "left_anti")
    from_pages = single.filter(F.col("length") >= feeds.NEAR_EMPTY).select(*ASK, F.lit(0).cast("long").alias("part"), "title", "html", F.col("url").alias("source"), "author", "date")
    every = materialize(from_feeds.unionByName(posts_of).unionByName(from_pages), "chapters")
    places = every.select(*ASK, "part").withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("request", "part")).cast("long") - 1)
    chapters = every.join(places, [*ASK, "part"])

    # what the reader should know
    say = lambda rows, *text: rows.select(*ASK, F.concat(*text).alias("message"))
    c, lit = F.col, F.lit
    lost = asked.filter("text is null").join(by_feed.select(*ASK), ASK, "left_anti").join(pages.filter("mirrored").select(*ASK), ASK, "left_anti")
    why = F.when(c("status").isNull(), lit("not in the snapshot")).otherwise(F.concat(lit("HTTP Error "), c("status").cast("string")))
    hint = F.when(c("status").isin(*REFUSED), lit("; the site may refuse automated readers, its feed may not")).otherwise(lit(""))
    near = (c("length") < feeds.NEAR_EMPTY) & ~c("image")
    gone = clean.join(chosen.select(*ASK, "pos"), [*ASK, "pos"], "left_anti")
    fetches = posts.select("link", c("text").isNull().alias("failed")).join(read.select("link", c("length").alias("page_length")), "link", "left")
    teasers = clean.filter(c("wants") & (c("own_length" if "own_length" in clean.columns else "length") < feeds.SUMMARY)).join(fetches, "link")
    stub = c("failed") | (c("page_length") < feeds.NEAR_EMPTY)
    told = F.when(c("failed"), F.concat("link", lit(": could not be fetched"))).otherwise(F.concat("link", lit(": no readable article text")))
    tally = teasers.groupBy(*ASK).agg(F.count_if(stub).alias("stubs"), F.count("*").alias("short"), F.min_by(told, F.when(stub, c("place"))).alias("first")).filter("stubs > 0")
    warnings = [
        say(lost, "url", lit(": "), why, hint),
        say(first.filter("n = 0"), "feed_url", lit(": feed has no items")),
        say(by_feed.filter("route = 'story'").join(asks, ASK), "url", lit(": imported from its public feed")),
        say(by_feed.filter("route = 'item'").join(asks, ASK), "url", lit(": the page held almost no content; imported this post from the site's feed")),
        say(pages.filter("mirrored"), "url", lit(": imported from a mirror")),
        say(gone.filter(near), lit("skipping near-empty feed item: "), "title"),
        say(tally, c("stubs").cast("string"), lit(" of "), c("short").cast("string"), lit(" short feed items kept their feed text (first: "), "first", lit(")")),
        say(read_lists, "url", lit(": read as a list of posts; imported "), c("n").cast("string"), lit(" linked posts as chapters")),
        say(listed.filter(~F.coalesce("good", F.lit(False))).join(read_lists.select(*ASK), ASK), "link", lit(": no readable article content")),
        say(single.filter(c("length") < feeds.NEAR_EMPTY), "url", lit(": no readable article content found")),
    ]
    out = warnings[0]
    for w in warnings[1:]:
        out = out.unionByName(w)
    return Ingested(chapters.select(*ASK, "part", "pos", "title", "html", "source", "author", "date"), out.filter("message is not null"))


def citations(links: DataFrame, web: DataFrame, url: str = "url") -> DataFrame:
    """url, title, author, date and site_name of each distinct address (and visit, if links has it) whose page is there, is HTML and has a title.

    Addresses are fetched without their fragment; those that give no citation are absent.
    """
    wanted = links.select(F.col(url).alias("url"), *_visit(links)).filter("url is not null and url <> ''").distinct().withColumn("page", F.regexp_replace("url", "#.*$", ""))
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce("content_type", F.lit("")), "^([^;]*)", 1)))
    html = kind.contains("html") | ((kind == "") & F.substring("text", 1, 1024).rlike("(?i)<(!doctype|html)\\b"))
    got = articles(fetched(wanted, web, "page").filter(F.col("text").isNotNull() & html))
    return got.filter("title is not null and title not in ('', 'Untitled')").select("url", "title", "author", "date", F.coalesce("site_name", F.nullif(U.host_key(F.col("url")), F.lit(""))).alias("site_name"))


def chapter_sources(chapters: DataFrame) -> DataFrame:
    """book_id, pos, url, title, author, date, site_name of the chapters that came from the web."""
    src = F.trim("source")
    return chapters.filter(src.rlike("^https?://")).select("book_id", "pos", src.alias("url"), F.coalesce(F.when(F.col("title") != "", F.col("title")), src).alias("title"), "author", "date", F.nullif(U.host_key(src), F.lit("")).alias("site_name"))


def matter(chapters: DataFrame, detect_titles: bool = True) -> DataFrame:
    """Chapters as front or back matter: unnumbered, raw, titled by their own first heading or not at all."""
    head = F.regexp_extract("html", r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1>", 2)
    title = F.trim(F.regexp_replace(F.regexp_replace(head, "<[^>]+>", ""), r"\s+", " ")) if detect_titles else F.lit("")
    return chapters.withColumns({"title": title, "numbered": F.lit(False), "number": F.lit(None).cast("string"), "raw": F.lit(True)})
