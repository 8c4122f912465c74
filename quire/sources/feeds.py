"""Syndication feeds: RSS 2.0, RSS 1.0 and Atom as rows of items."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.tree import Fragment, fold, parsed
from quire.operators.article import parse_date
from quire.runtime import ship

# Addresses where sites commonly keep their feed, in the order they are tried.
COMMON_PATHS = ("feed", "rss.xml", "rss", "atom.xml", "index.xml", "feed.xml", "blog-feed.xml", "feeds/posts/default")


def safe_xml(data: str | bytes) -> ET.Element:
    """An element tree; a document type is refused before any entity of it is read."""
    text = data if isinstance(data, str) else data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    rest = text.lstrip("﻿ \t\r\n")
    while rest.startswith(("<?", "<!--")):
        end = "?>" if rest.startswith("<?") else "-->"
        rest = rest.partition(end)[2].lstrip()
    if re.match(r"<!DOCTYPE", rest, re.I):
        raise ValueError("a document type is not accepted")
    return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text.lstrip("﻿")))


def is_feed(text: Column, content_type: Column) -> Column:
    """By content type, or an XML opening with a feed's name in the first 512 characters."""
    head = F.lower(F.substring(F.ltrim(text), 1, 512))
    return F.lower(content_type).rlike("(application|text)/(rss|atom)\\+xml") | (head.rlike("^(<\\?xml|<rss|<feed|<rdf)") & head.rlike("<rss|<feed|rdf"))


def _date(text: str) -> datetime | None:
    when = None
    try:
        when = parsedate_to_datetime(text)
    except (TypeError, ValueError, IndexError):
        when = parse_date(text)
    if when is None:
        return None
    return when.astimezone(timezone.utc) if when.tzinfo else when.replace(tzinfo=timezone.utc)


def parse_feed(text: str) -> tuple[dict, list[dict]]:
    """The feed's title, link and author, and its items in document order; ValueError if it is none."""
    try:
        root = safe_xml(text)
    except ET.ParseError as e:
        raise ValueError(str(e)) from None
    name = lambda x: x.tag.rpartition("}")[2].lower()
    kids = lambda x, *n: [c for k in n for c in x if name(c) == k]
    first = lambda x, *n: next((t for c in kids(x, *n) if (t := fold("".join(c.itertext())))), "")
    if name(root) not in ("rss", "rdf", "feed"):
        raise ValueError(f"{name(root)} is no feed")
    atom = name(root) == "feed"
    channel = root if atom else (kids(root, "channel") or [root])[0]

    def link(x):
        if not atom:
            return first(x, "link") or next((c.get("href") or "" for c in kids(x, "link")), "")
        own = [c for c in kids(x, "link") if c.get("href")]
        return next((c.get("href") for c in own if c.get("rel", "alternate") == "alternate"), own[0].get("href") if own else "")

    def body(x):
        for c in kids(x, "content", "summary") if atom else kids(x, "encoded", "description"):
            if atom and c.get("type") == "xhtml":
                for e in c.iter():
                    e.tag = e.tag.rpartition("}")[2]
                return "".join(ET.tostring(k, encoding="unicode") for k in (c[0] if len(c) else c))
            if (c.text or "").strip():
                return c.text
        return ""

    def author(x):
        return next((first(a, "name") or fold("".join(a.itertext())) for a in kids(x, "author", "creator")), "")

    items = []
    for pos, x in enumerate(kids(root, "entry") if atom else kids(channel, "item") or kids(root, "item")):
        when = first(x, "published", "updated") if atom else first(x, "pubdate", "date", "published")
        items.append({"pos": pos, "title": unescape(first(x, "title")) or "Untitled", "link": link(x), "html": body(x), "author": author(x) or (author(channel) if atom else None) or None, "date": _date(when) if when else None})
    return {"title": unescape(first(channel, "title")), "link": link(channel), "author": author(channel) or None}, items


def discover(page: Fragment | str | None, base: str = "") -> list[str]:
    """Feeds that a page names in its head, without comment feeds, each once, in order."""
    f, out = parsed(page), {}
    for i in f.find("link"):
        a = f.attrs[i]
        to = (a.get("href") or "").strip()
        if "alternate" in (a.get("rel") or "").lower().split() and re.search(r"application/(rss|atom)\+xml", a.get("type") or "", re.I) and to and "comment" not in to.lower():
            out[urljoin(base, to)] = None
    return list(out)


ITEM = pa.struct([("pos", pa.int64()), ("title", pa.string()), ("link", pa.string()), ("html", pa.string()), ("author", pa.string()), ("date", pa.timestamp("us", "UTC"))])


def feed_items(feeds: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each item: key, feed_title, feed_link, error, pos, title, link, html, author, date.

    A text that is no feed has one row with its error.
    """
    ship(feeds.sparkSession)

    def run(batches):
        for batch in batches:
            heads, items, errors = [], [], []
            for x in batch["text"].to_pylist():
                try:
                    head, found = parse_feed(x or "")
                    heads.append(head), items.append(found), errors.append(None)
                except ValueError as e:
                    heads.append({}), items.append([]), errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([h.get("title") for h in heads], pa.string()), pa.array([h.get("link") for h in heads], pa.string()), pa.array(errors, pa.string()), pa.array(items, pa.list_(ITEM))], ["key", "feed_title", "feed_link", "error", "items"])

    kind = feeds.schema[key].dataType.simpleString()
    rows = feeds.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, feed_title string, feed_link string, error string, items array<struct<pos:long,title:string,link:string,html:string,author:string,date:timestamp>>")
    return rows.select(F.col("key").alias(key), "feed_title", "feed_link", "error", F.explode_outer("items").alias("i")).select(key, "feed_title", "feed_link", "error", "i.*")
