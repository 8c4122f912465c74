"""Books as groups of chapters: statistics, contents, print HTML, assets, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import escape_html, folded, word_count


def stats(chapters: DataFrame, book: str, numbered: Column, html: str) -> DataFrame:
    """chapters, matter (parts without a number), words and images of each book."""
    images = F.regexp_count(F.col(html), F.lit("(?i)<img\\b")).cast("long")
    return chapters.groupBy(book).agg(
        F.count_if(numbered).alias("chapters"), F.count_if(~numbered).alias("matter"), F.sum(word_count(F.col(html))).alias("words"), F.sum(images).alias("images")
    )


def contents(chapters: DataFrame, book: str, pos: str, title: str, display: str) -> DataFrame:
    """One entry for each titled chapter, in order."""
    titled = chapters.filter(F.col(title) != "")
    label = F.when(F.col(display).isNotNull(), F.concat(F.col(display), F.lit(". "), F.col(title))).otherwise(F.col(title))
    return titled.select(book, F.row_number().over(Window.partitionBy(book).orderBy(pos)).cast("long").alias("entry"), label.alias("label"))


def chapter_head(display: Column, title: Column) -> Column:
    number = F.when(display.isNotNull(), F.concat(F.lit('<p class="chapter-number">'), F.lit("Chapter "), display, F.lit("</p>"))).otherwise(F.lit(""))
    return F.concat(number, F.lit("<h1>"), escape_html(title), F.lit("</h1>"))


def print_html(chapters: DataFrame, book: str, pos: str, fragment: Column) -> DataFrame:
    """The fragments of each book in order, as one string; only a book's own rows meet."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos), fragment.alias("html"))))
    return chapters.groupBy(book).agg(F.array_join(F.transform(parts, lambda p: p["html"]), "").alias("html"))


def asset_name(data: Column, extension: Column) -> Column:
    return F.concat(F.lit("images/img-"), F.substring(F.sha1(data), 1, 12), extension)


def data_uri(data: Column, media_type: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))


def sniff_image(data: Column, content_type: Column) -> Column:
    """The media type by leading bytes, else by an SVG opening, else the given type's image kind."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.lower(F.decode(F.substring(data, 1, 256), "ISO-8859-1"))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.ltrim(text).startswith("<svg") | (F.ltrim(text).startswith("<?xml") & text.contains("<svg")), "image/svg+xml")
        .when(content_type.startswith("image/"), F.regexp_extract(content_type, "^([^; ]+)", 1))
    )


def distinct_assets(assets: DataFrame, book: str, name: str, pos: str) -> DataFrame:
    """The first of equal names in each book, and how many share it."""
    return assets.groupBy(book, name).agg(F.min(pos).alias("first"), F.count("*").alias("uses"))


def references(citations: DataFrame, book: str, text: Column, tie: str) -> DataFrame:
    """place of each entry in its book's list, by its text without regard to case: full case folding."""
    return citations.withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy(folded(text), tie)).cast("long"))


def inline_assets(chapters: DataFrame, assets: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """Chapters whose pictures carry their data: sources that name an asset (name, data, media_type) become data URIs.

    Only the assets that a chapter uses travel to it; other sources stay as they are.
    """
    names = F.regexp_extract_all(F.col(html), F.lit('(?i)<img\\b[^>]*?\\bsrc="([^"]*)"'), 1)
    used = chapters.select(*key, F.explode(F.array_distinct(names)).alias("name"))
    known = used.join(assets.select("name", data_uri(F.col("data"), F.col("media_type")).alias("uri")), "name")
    maps = known.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("name", "uri"))).alias("uris"))
    text = F.aggregate(F.coalesce("uris", F.array().cast("array<struct<name:string,uri:string>>")), F.col(html), lambda h, u: F.replace(h, F.concat(F.lit('src="'), u["name"], F.lit('"')), F.concat(F.lit('src="'), u["uri"], F.lit('"'))))
    return chapters.join(maps, key, "left").withColumn(html, text).drop("uris")


def keep_jobs(jobs: DataFrame, server: str, at: list[str], finished: Column, most: int = 20) -> DataFrame:
    """The jobs a server keeps: beyond ``most``, the oldest finished ones go; those that still run always stay."""
    order = Window.partitionBy(server).orderBy(*at)
    total = F.count("*").over(Window.partitionBy(server))
    done = F.sum(finished.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return jobs.withColumns({"total": total, "done": done}).filter(~finished | (F.col("done") > F.col("total") - most)).drop("total", "done")


def append(*parts: DataFrame, book: str = "book_id", pos: str = "pos") -> DataFrame:
    """Union-all in the order given, positions counted anew through each book."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn(pos, F.row_number().over(Window.partitionBy(book).orderBy("part", pos)).cast("long") - 1).drop("part")


def safe_names(rows: DataFrame, key: str, name: str, pos: str, fallback: str = "upload.txt") -> DataFrame:
    """safe: the base name with odd characters as low lines; names that come again in a key get -1, -2 ... before the ending."""
    base = F.regexp_replace(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(fallback)), "^.*/", "")
    base = F.trim(F.regexp_replace(base, "(?U)[^\\w.\\- ]+", "_"))
    base = F.when(base == "", fallback).otherwise(base)
    again = F.row_number().over(Window.partitionBy(key, "base").orderBy(pos)) - 1
    stem, ending = F.regexp_extract("base", "^(.+?)(\\.[^.]*)?$", 1), F.regexp_extract("base", "^(.+?)(\\.[^.]*)?$", 2)
    safe = F.when(F.col("again") == 0, F.col("base")).otherwise(F.concat(stem, F.lit("-"), F.col("again").cast("string"), ending))
    return rows.withColumn("base", base).withColumn("again", again).withColumn("safe", safe).drop("base", "again")
