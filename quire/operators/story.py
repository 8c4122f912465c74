"""A book as one flat story: styled paragraphs of front matter, openers, content and references, as rows in order.

What the Word, InCopy and page-layout writers read; each row stands by itself, so a story of any length stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import map_rows
from quire.operators import notes, sinks

# Styles of front matter by their column, of blocks by their tag, and where a part starts.
FRONT = (("title", "Book Title"), ("description", "Book Subtitle"), ("author", "Book Author"), ("publisher", "Book Publisher"))
BLOCKS = {"h1": "Heading 1", "h2": "Heading 2", "h3": "Heading 3", "h4": "Heading 4", "h5": "Heading 5", "h6": "Heading 6", "blockquote": "Quote", "pre": "Code", "li": "List"}
ODD, NEXT = "NextOddPage", "NextPage"
RUNS = "array<struct<text:string,flags:string>>"


def _one(text: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit("").alias("flags")))


def _row(book: str, part: Column, style: Column, text: Column, start: Column, at: Column | None = None) -> list[Column]:
    return [F.col(book), part.cast("int").alias("part"), (F.lit(0) if at is None else at).cast("long").alias("chapter"), F.lit(0).cast("int").alias("block"), style.alias("style"), _one(text).cast(RUNS).alias("runs"), start.alias("start")]


def front(books: DataFrame, book: str = "book_id") -> DataFrame:
    """Title, subtitle, author and publisher where they are, and the lines of the copyright page on a page of their own.

    books: title, description, author, publisher, date, rights, source_url, copyright.
    """
    there = [F.when((F.coalesce(F.col(c), F.lit("")) != "") | F.lit(c == "title"), F.struct(F.lit(style).alias("style"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Untitled")).alias("text"), F.lit(None).cast("string").alias("start"))) for c, style in FRONT]
    lines = sinks.copyright_page(*map(F.col, ("author", "date", "rights", "source_url", "copyright")))
    legal = F.transform(lines, lambda x, i: F.struct(F.lit("Copyright").alias("style"), x.alias("text"), F.when(i == 0, NEXT).alias("start")))
    items = F.concat(F.filter(F.array(*there), lambda x: x.isNotNull()), legal)
    rows = books.select(book, F.posexplode(items).alias("i", "x"))
    return rows.select(*_row(book, F.lit(0), F.col("x.style"), F.col("x.text"), F.col("x.start"), F.col("i")))


def openers(chapters: DataFrame, book: str = "book_id", label: str = "Chapter ", numbers: bool = True) -> DataFrame:
    """The number and title of each chapter that has a head of its own; the first of them opens a right-hand page."""
    show = F.col("display").isNotNull() & F.lit(numbers)
    own = chapters.filter(~F.coalesce("raw", F.lit(False)))
    number = own.filter(show).select(*_row(book, F.lit(1), F.lit("Chapter Number"), F.concat(F.lit(label), "display"), F.lit(ODD), F.col("pos"))).withColumn("block", F.lit(0))
    title = own.select(*_row(book, F.lit(1), F.lit("Chapter Title"), F.col("title"), F.when(~show, ODD), F.col("pos"))).withColumn("block", F.lit(1))
    return number.unionByName(title)


def content(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """The blocks of each chapter with footnotes in place; a chapter without a head opens its page with its first block."""
    rule = lambda m: {"items": [{"style": BLOCKS.get(tag, "Body"), "runs": [{"text": t, "flags": " ".join(f)} for t, f in runs]} for tag, runs in sinks.paragraphs(notes.inline_footnotes(m))]}
    rows = map_rows(chapters.select(book, "pos", F.coalesce("raw", F.lit(False)).alias("raw"), F.col("html").alias("m")), f"items array<struct<style:string,runs:{RUNS}>>", rule, "m")
    each = rows.select(book, "pos", "raw", F.posexplode("items").alias("i", "x"))
    return each.select(book, F.lit(1).alias("part"), F.col("pos").cast("long").alias("chapter"), (F.col("i") + 2).cast("int").alias("block"), F.col("x.style").alias("style"), F.col("x.runs").alias("runs"), F.when(F.col("raw") & (F.col("i") == 0), ODD).alias("start"))


def references(entries: DataFrame, book: str = "book_id", heading: str = "References") -> DataFrame:
    """entries: text and place of each reference; the list has a heading where it has entries."""
    head = entries.select(book).distinct().select(*_row(book, F.lit(2), F.lit("Chapter Title"), F.lit(heading), F.lit(ODD)))
    return head.unionByName(entries.select(*_row(book, F.lit(2), F.lit("Reference Entry"), F.col("text"), F.lit(None).cast("string"), F.col("place"))))


def items(books: DataFrame, chapters: DataFrame, entries: DataFrame | None = None, book: str = "book_id", label: str = "Chapter ", numbers: bool = True) -> DataFrame:
    """book, place, style, text, runs and start of every paragraph, in the order of the book.

    Rows are placed by narrow columns only; an empty book is its front matter.
    """
    out = front(books, book).unionByName(openers(chapters, book, label, numbers)).unionByName(content(chapters, book))
    out = out if entries is None else out.unionByName(references(entries, book))
    place = F.row_number().over(Window.partitionBy(book).orderBy("part", "chapter", "block")).cast("long")
    return out.select(book, place.alias("place"), "style", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), "runs", "start")
