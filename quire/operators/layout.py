"""Layout statistics over the lines of a document: furniture, body size, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row for each line: the keys, line_no from 0, and line."""
    return docs.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def furniture_key(line: Column) -> Column:
    """Digits become #, lower case, outer blanks go: what page heads and feet share."""
    return F.lower(F.trim(F.regexp_replace(line, "[0-9]", "#")))


def repeated_lines(rows: DataFrame, group: str, page: str, line: str, least: Column | int) -> DataFrame:
    """Keys that stand on at least so many pages of their group.

    Pages are counted once for each key by a distinct aggregation, whose first step is local.
    """
    keyed = rows.select(group, page, furniture_key(F.col(line)).alias("key")).filter("key <> ''").distinct()
    return keyed.groupBy(group, "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= (F.lit(least) if isinstance(least, int) else least))


def weighted_median(rows: DataFrame, group: str, size: str, weight: str) -> DataFrame:
    """The first size at which twice the running weight reaches the total; sizes are summed before the window."""
    by = rows.groupBy(group, size).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(group)
    run = by.withColumns({"run": F.sum("weight").over(w.orderBy(size).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("weight").over(w)})
    return run.filter("2 * run >= total").groupBy(group).agg(F.min(size).alias("body"))


def heading_ranks(rows: DataFrame, group: str, bucket: str, body: Column, most: int = 6) -> DataFrame:
    """Distinct sizes above the body, the largest first: level 1 to most."""
    sizes = rows.filter(body).select(group, bucket).distinct()
    level = F.least(F.dense_rank().over(Window.partitionBy(group).orderBy(F.col(bucket).desc())), F.lit(most))
    return sizes.withColumn("level", level.cast("long"))


def islands(rows: DataFrame, key: str, pos: str, flag: Column) -> DataFrame:
    """Runs of neighbouring rows with the flag: key, start, end and length."""
    kept = rows.filter(flag).select(key, F.col(pos).cast("long").alias("p"))
    block = F.col("p") - F.row_number().over(Window.partitionBy(key).orderBy("p"))
    return kept.withColumn("block", block).groupBy(key, "block").agg(F.min("p").alias("start"), F.max("p").alias("end"), F.count("*").alias("length")).drop("block")


def modal(rows: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """The commonest value of each group; the one seen first wins ties."""
    by = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return by.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("mode"))


def estimate_pages(words: Column, chapters: Column, words_per_page: Column) -> Column:
    """An even number of pages, at least four, with room to spare."""
    n = F.ceil(words / words_per_page * 1.3) + 2 + F.ceil(chapters * 1.5) + 2
    return F.greatest(n + F.pmod(n, F.lit(2)), F.lit(4))


def median_leading(rows: DataFrame, group: str, page: str, line_no: str, y: str) -> DataFrame:
    """The median distance down from a line to the next one on its page; groups without two lines on a page have none."""
    order = Window.partitionBy(group, page).orderBy(line_no)
    gaps = rows.select(group, (F.lag(y).over(order) - F.col(y)).alias("gap")).filter("gap > 0")
    return gaps.groupBy(group).agg(F.median("gap").alias("leading"))


def lost_share(text: Column) -> Column:
    """The share of characters that a font gave no meaning: replacement and private-use ones, and controls but white space."""
    lost = F.length(text) - F.length(F.regexp_replace(text, "[\\x{FFFD}\\x{E000}-\\x{F8FF}\\x00-\\x08\\x0E-\\x1F]", ""))
    return F.when(F.length(text) > 0, lost / F.length(text)).otherwise(F.lit(0.0))


def drop_generated(blocks: DataFrame, doc: str, pos: str, tag: str, text: str) -> DataFrame:
    """Blocks without what a book's writer sets anew: a chapter label right before a heading, a heading of contents with
    nothing under it, and the colophon."""
    order = Window.partitionBy(doc).orderBy(pos)
    heading = F.col(tag).rlike("^h[1-6]$")
    follows = F.lead(heading).over(order)
    plain = F.lower(F.trim(F.col(text)))
    label = plain.rlike("^chapter\\s+([0-9]+|[ivxlcdm]+)\\.?$") & F.coalesce(follows, F.lit(False))
    empty = heading & plain.isin("contents", "table of contents") & F.coalesce(follows, F.lit(True))
    return blocks.withColumn("generated", label | empty | (plain == "produced with quire.")).filter(~F.col("generated")).drop("generated")
