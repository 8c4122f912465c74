"""Files and snapshots of pages as chapters.

``ingest`` reads a folder by one binaryFile scan, sends each format to its reader, and gives one table
of chapters: book_id, path, pos, title, html, author, error.  A file that can't be read is a row with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markdown
from quire.functions.arrow import map_rows
from quire.functions.scalar import decode_body
from quire.functions.tree import Fragment
from quire.operators.scan import running
from quire.operators.article import extract, split_chapters
from quire.runtime import materialize
from quire.sources import pdf
from quire.sources.word import read_word

# File name endings of each format.
KINDS = {"markdown": (".md", ".markdown", ".mdown", ".mkd"), "html": (".html", ".htm", ".xhtml"), "word": (".docx",), "pdf": (".pdf",)}


def kind(path: Column) -> Column:
    low, out = F.lower(path), F
    for name, ends in KINDS.items():
        out = out.when(low.rlike("(%s)$" % "|".join(e.replace(".", "\\.") for e in ends)), name)
    return out.otherwise("text")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, kind and content of a folder's files; hidden ones are left out."""
    raw = spark.read.format("binaryFile").load(folder).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), kind(F.col("path")).alias("kind"), "content").filter(~F.col("name").startswith("."))


def named(name: str) -> str:
    """A title from a file's name."""
    words = name.rpartition(".")[0].replace("-", " ").replace("_", " ").split()
    return " ".join(w[:1].upper() + w[1:] for w in words) or "Untitled"


def read(kind: str, name: str, content: bytes) -> dict:
    """parts (title and html), title and author of one file."""
    fallback, title, author = named(name), None, None
    if kind == "word":
        doc = read_word(content)
        html, title, author = doc["html"], doc["title"], doc["author"]
    elif kind == "html":
        doc = extract(decode_body(content))
        html, title, author = doc["html"], doc["title"], doc["author"]
    elif kind == "markdown":
        html = markdown.to_html(content.decode("utf-8", "replace").lstrip("﻿"))
    else:
        blocks = [" ".join(b.split("\n")) for b in content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n\n")]
        html = "\n".join(f"<p>{markdown.entities.escape(b.strip(), quote=False)}</p>" for b in blocks if b.strip())
    return _parts(html, title, fallback, kind, author)


def _parts(html: str, title: str | None, fallback: str, kind: str, author: str | None) -> dict:
    parts = split_chapters(html, title or fallback)
    if kind == "markdown" and len(parts) == 1 and Fragment(html).find("h1"):
        title = parts[0][0]
    return {"parts": [{"title": t, "html": h} for t, h in parts], "doc_title": title, "author": author}


PARTS = "parts array<struct<title:string,html:string>>, doc_title string, author string"


def read_pdfs(files: DataFrame) -> DataFrame:
    """path, parts, doc_title, author and error of PDF files, by the layout plan over their runs."""
    runs = materialize(map_rows(files.select("path", "name", "content"), pdf.RUNS, pdf.read_runs, "content"), "pdf-runs")
    laid = pdf.blocks_to_html(pdf.lines(runs.filter("error is null").select("path", F.explode("runs").alias("r")).select("path", "r.*"), "path"), "path")
    rows = runs.select("path", "name", "title", F.col("author").alias("by"), F.coalesce("error", "note").alias("problem")).join(laid, "path", "left")
    done = map_rows(rows, PARTS, lambda html, title, name, by: _parts(html or "", title, named(name), "pdf", by), "html", "title", "name", "by")
    return done.select("path", F.when(F.col("problem").isNull() | F.col("problem").endswith("left out"), F.col("parts")).alias("parts"), "doc_title", "author", F.coalesce("error", "problem").alias("error"))


def ingest(spark: SparkSession, folder: str, book_id: str = "book") -> DataFrame:
    """The folder's chapters in order of file names; error says what could not be read, or was left out.

    Positions are running sums over the sorted paths, in blocks: no task has all files, and none sorts their text.
    """
    files = scan(spark, folder)
    rest = map_rows(files.filter("kind <> 'pdf'"), PARTS, read, "kind", "name", "content").select("path", "parts", "doc_title", "author", "error")
    rows = materialize(rest.unionByName(read_pdfs(files.filter("kind = 'pdf'"))), "files")
    counts = rows.select("path", F.greatest(F.coalesce(F.size("parts"), F.lit(0)), F.lit(1)).alias("n"))
    before = running(counts.withColumn("book", F.lit(book_id)), ["book"], ["path"], exclusive=True, before=F.col("n"))
    parts = rows.join(before.select("path", "before"), "path").select("path", "before", "doc_title", "author", "error", F.posexplode_outer("parts").alias("part", "p"))
    return parts.select(F.lit(book_id).alias("book_id"), "path", (F.col("before") + F.coalesce("part", F.lit(0))).cast("long").alias("pos"), "p.title", "p.html", "doc_title", "author", "error")
