"""Numbers that run through a book: chapters, links and notes.

A book is a key; its order is an explicit position.  Numbers are running sums in two levels (``scan``), so one very large book is
numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import scan

# Titles of parts that carry no number, and titles of contents pages.
UNNUMBERED = ("introduction", "conclusion", "preface", "foreword", "prologue", "epilogue", "afterword", "acknowledgments", "acknowledgements", "references", "bibliography", "works cited", "notes", "glossary", "index", "abstract", "dedication", "appendix", "appendices")
CONTENTS = ("contents", "table of contents", "toc")
ROMAN = "IVXLCDM"


def chapter_sequence(chapters: DataFrame, book: str, pos: str, numbered: Column, number: Column | None = None) -> DataFrame:
    """seq: the running count of numbered chapters, null for others; display: the typed number or seq."""
    extra = {"is_numbered": numbered} | ({} if number is None else {"typed_number": number})
    counted = scan.running(chapters.withColumns(extra), [book], [pos], seq=numbered)
    seq = F.when(F.col("is_numbered"), F.col("seq"))
    shown = seq.cast("string") if number is None else F.coalesce("typed_number", seq.cast("string"))
    return counted.withColumns({"seq": seq, "display": F.when(F.col("is_numbered"), shown)}).drop(*extra)


def typed_figure(title: Column) -> tuple[Column, Column]:
    """The figure that a title begins with and the words after it, nulls where it has none: a number, a dot, a blank."""
    lead = lambda c: F.regexp_replace(c, "^\\s+", "")
    head, tail = lead(F.substring_index(title, ".", 1)), F.substr(title, F.locate(".", title) + 1)
    arabic = F.length(head).between(1, 4) & (F.translate(head, "0123456789", "") == "")
    roman = F.length(head).between(1, 8) & (F.translate(head, ROMAN, "") == "")
    rest = lead(tail)
    found = (F.locate(".", title) > 0) & (arabic | roman) & (rest != tail) & (rest != "")
    return F.when(found, head), F.when(found, rest)


def is_furniture(title: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return t.isin(*UNNUMBERED) | t.startswith("appendix ") | t.startswith("appendix:")


def classify(chapters: DataFrame, book: str, pos: str, title: str = "title") -> DataFrame:
    """numbered, number and the title without its figure.

    Typed figures count where those of a book are 1..k in order, k at least two; then the chapters without one
    are unnumbered.  Else only standard titles are.
    """
    from quire.functions.text import number_value

    figure, rest = typed_figure(F.col(title))
    rows = chapters.withColumns({"figure": figure, "rest": rest})
    rows = rows.withColumn("value", F.when(F.col("figure").isNotNull(), number_value(F.col("figure"))))
    typed = scan.running(rows, [book], [pos], rank=F.col("value").isNotNull()).groupBy(book).agg(((F.count("value") >= 2) & F.coalesce(F.bool_and(F.when(F.col("value").isNotNull(), F.col("value") == F.col("rank"))), F.lit(False))).alias("typed"))
    out = rows.join(typed, book)
    return out.select(
        *[F.when(F.col("typed") & F.col("figure").isNotNull(), F.col("rest")).otherwise(F.col(c)).alias(c) if c == title else F.col(c) for c in chapters.columns],
        F.when(F.col("typed"), F.col("figure").isNotNull()).otherwise(~is_furniture(F.col(title))).alias("numbered"),
        F.when(F.col("typed"), F.col("figure")).alias("number"),
    )


def is_source_toc(title: Column, html: Column) -> Column:
    """A contents title, and dot leaders into a page number or three links into the document."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    anchors = F.regexp_count(html, F.lit('(?i)<a\\b[^>]*href="#'))
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).isin(*CONTENTS) & (text.rlike("\\.{3,}\\s*\\d") | (anchors >= 3))


def link_numbers(links: DataFrame, book: str, order: list[str]) -> DataFrame:
    """number: 1, 2, ... through the book's call links."""
    return scan.numbered(links, [book], order)


def endnotes(links: DataFrame, book: str, url: str, order: list[str]) -> DataFrame:
    """One row for each note: book, number, url."""
    first = links.groupBy(book, url).agg(F.min(F.struct(*order)).alias("first"))
    return scan.numbered(first, [book], ["first"]).select(book, "number", url)


def endnote_numbers(links: DataFrame, book: str, url: str, order: list[str]) -> DataFrame:
    """number of each call where an address keeps the number of its first call."""
    return links.join(endnotes(links, book, url, order), [book, url])


def renumber_runs(items: DataFrame, key: str, pos: str, flag: Column) -> DataFrame:
    """run: an id for each island of neighbouring rows that have the flag; null elsewhere."""
    w = Window.partitionBy(key).orderBy(pos)
    start = flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return items.withColumn("run", F.when(flag, F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
