"""Pages, pictures and lists over snapshot tables: what a crawl would fetch is a join here."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import map_rows
from quire.functions.tree import Fragment, fold, parsed
from quire.functions.url import host_key, netloc, path
from quire.operators.links import ITEM_SHARE, LIST_MIN, TEXT_MIN, TEXT_SHARE

# Endings of media types, and hosts whose pages are read elsewhere.
ENDINGS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg"}
MIRRORS = (("lesswrong.com", "www.greaterwrong.com"),)


def mirror(url: Column) -> Column:
    """The same page on a mirror, for hosts that turn automated readers away; else null."""
    out = F
    for host, other in MIRRORS:
        out = out.when(host_key(url) == host, F.regexp_replace(url, "^([^:]+:)?//[^/?#]*", f"$1//{other}"))
    return out


def story_feed(url: Column) -> Column:
    """For story platforms that publish whole texts in feeds: struct of the feed's address and the story's id."""
    host, parts = F.lower(netloc(url)), F.filter(F.split(path(url), "/"), lambda s: s != "")
    first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    main, own = host.isin("medium.com", "www.medium.com"), host.endswith(".medium.com")
    feed = F.when(main & (first != "") & ~first.isin("feed", "p", "m"), F.concat(F.lit("https://medium.com/feed/"), first)).when(~main & own, F.concat(F.lit("https://"), host, F.lit("/feed")))
    slug = F.when(main, second).otherwise(first)
    ident = F.regexp_extract(slug, "-([0-9a-f]{8,16})$", 1)
    return F.struct(feed.alias("feed"), F.when(feed.isNotNull() & (ident != ""), ident).alias("story"))


def _host(url: str) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return re.sub(r"^www\.", "", m[1].lower()) if m else ""


def _kin(a: str, b: str) -> bool:
    return bool(a and b) and (a == b or a.endswith("." + b) or b.endswith("." + a))


def list_targets(markup: Fragment | str | None, page: str, index_paths: tuple[str, ...]) -> list[str]:
    """Posts of the page's own site, if its leaf list items lead to them and hold most of its text; else nothing."""
    f, site = parsed(markup), _host(page)
    whole = len(f.line())
    leaves = [i for i in f.find("li") if not f.find("li", root=i)]

    def posts(i: int) -> list[str]:
        out = []
        for a in f.find("a", root=i):
            to = f.attrs[a].get("href") or ""
            m = re.match(r"https?://[^/?#]*([^?#]*)(\?[^#]*)?", to)
            listing = m and not m[2] and m[1].strip("/").lower() in index_paths
            if m and not listing and _kin(_host(to), site) and to.rstrip("/") != page.rstrip("/") and len(f.line(a)) >= TEXT_MIN:
                out.append(to)
        return out

    found = {i: p for i in leaves if (p := posts(i))}
    text = sum(len(f.line(i)) for i in found)
    if not site or not whole or len(leaves) < LIST_MIN or len(found) < ITEM_SHARE * len(leaves) or text < TEXT_SHARE * whole:
        return []
    first: dict[str, str] = {}
    for p in found.values():
        for to in p:
            first.setdefault(to.split("#")[0].rstrip("/"), to)
    return list(first.values()) if len(first) >= LIST_MIN else []


def list_pages(pages: DataFrame, url: str = "url", html: str = "html", most: int = 0) -> DataFrame:
    """url, pos and target of each post that a list page leads to, the first ``most`` in list order."""
    from quire.functions.url import INDEX_PATHS

    rows = map_rows(pages.select(F.col(url).alias("url"), F.col(url).alias("page"), F.col(html).alias("html")), "targets array<string>", lambda page, markup: {"targets": list_targets(markup, page, INDEX_PATHS)}, "page", "html")
    out = rows.select("url", F.posexplode("targets").alias("pos", "target"))
    return out.filter(F.col("pos") < most) if most else out


def image_sources(markup: str | None) -> list[str]:
    f = Fragment(markup)
    return [f.attrs[i].get("src") or "" for i in f.find("img")]


def rewrite_images(markup: str | None, names: dict[str, str]) -> str:
    """Pictures get their asset's name; those without one go, and with them figures that keep a caption only."""
    f = Fragment(markup)
    for i in f.find("img"):
        name = names.get(f.attrs[i].get("src") or "")
        if name:
            f.attrs[i] = {**f.attrs[i], "src": name}
            continue
        f.drop(i)
        figure = next((a for a in f.parents(i) if f.tag[a] == "figure"), None)
        if figure is None:
            continue
        rest = [c for c in f.children(figure) if f.tag[c] != "figcaption"]
        if all(not f.line(c) and not f.find("img", "video", "audio", "iframe", "embed", "object", "svg", "canvas", root=c) and f.tag[c] not in ("video", "audio", "iframe", "embed", "object", "svg", "canvas") for c in rest):
            f.drop(figure)
    return f.html().strip()


def apply_images(chapters: DataFrame, snapshot: DataFrame, policy: str = "download", key: tuple[str, ...] = ("book_id", "pos"), html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Chapters with their pictures under the policy (link, strip, download), and the assets (name, media_type, data).

    snapshot: url, media_type and data of what could be loaded.  Each address is looked up once.
    """
    if policy == "link":
        return chapters, snapshot.limit(0).select(F.lit("").alias("name"), "media_type", "data")
    if policy == "strip":
        return map_rows(chapters, f"{html} string", lambda x: {html: rewrite_images(x, {})}, html).drop("error"), snapshot.limit(0).select(F.lit("").alias("name"), "media_type", "data")
    endings = F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv])
    name = F.concat(F.lit("images/img-"), F.substring(F.sha1("data"), 1, 12), F.coalesce(F.try_element_at(endings, F.col("media_type")), F.lit(".bin")))
    named = snapshot.filter("data is not null").select("url", "media_type", "data", name.alias("name"))
    used = map_rows(chapters.select(*key, F.col(html).alias("m")), "src array<string>", lambda x: {"src": image_sources(x)}, "m").select(*key, F.explode("src").alias("url")).distinct()
    known = used.join(named.select("url", "name"), "url")
    maps = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("url", "name"))).alias("names"))
    rows = chapters.join(maps, list(key), "left")
    out = map_rows(rows, f"{html} string", lambda x, n: {html: rewrite_images(x, dict(n or {})) if n or "<img" in (x or "") else x}, html, "names").drop("error")
    first = Window.partitionBy("name").orderBy("url")
    assets = named.join(known.select("url").distinct(), "url", "left_semi").withColumn("k", F.row_number().over(first)).filter("k = 1").select("name", "media_type", "data")
    return out, assets


def lettrine(markup: str | None) -> str:
    """The opening word of the first paragraph as a dropped initial and a run-in, if it opens with a plain word."""
    f = Fragment(markup)
    p = next((i for i in f.children(0) if f.tag[i] == "p"), None)
    if p is None or p + 1 >= f.stop[p] or f.tag[p + 1]:
        return markup or ""
    m = re.match(r"\s*([^\W\d_])([^\W_]+)", f.text[p + 1])
    if not m:
        return markup or ""
    f.before[p + 1] = f'<span class="lettrine">{m[1]}</span><span class="lettrine-run">{entities.escape(m[2], quote=False)}</span>'
    f.text[p + 1] = f.text[p + 1][m.end() :]
    return f.html()


def folded(markup: str | None) -> str:
    return fold(Fragment(markup).words())
