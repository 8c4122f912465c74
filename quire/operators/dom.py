"""Pages as rows of nodes, and what is asked of trees as relational plans.

A node has its place in document order (``pre``), the place behind its subtree (``stop``) and its nearest ancestors.  A subtree is the
range of places from pre to stop, so what a subtree holds is the difference of two running sums, and a node
lies inside some link if a link before it ends behind it.  No plan here compares nodes with each other; joins are by page and place.

Text is measured by its characters other than blanks, as these add up over a tree whatever lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import map_rows
from quire.functions.tree import HEADINGS, Fragment
from quire.operators.article import AWAY, PARTS, STRIPPED, TOWARDS, WEIGHTS

NODES = "nodes array<struct<pre:int,stop:int,chain:array<int>,tag:string,names:string,href:string,text:string>>"
TOP = ("#root", "html", "body")
BLOCKS = ("p", "pre", "blockquote", "li", "div")
LEAST = 25  # characters of a block that votes


def read_nodes(markup: str | None) -> dict:
    """The nodes of one page; a text node has no tag; chain: the ancestors, nearest first, as many as votes reach."""
    f = Fragment(markup)
    chains: list[list[int]] = []
    rows = []
    for i, tag in enumerate(f.tag):
        up = f.up[i]
        chains.append([] if up < 0 else [up, *chains[up][: len(WEIGHTS) - 1]])
        rows.append({"pre": i, "stop": f.stop[i], "chain": chains[i], "tag": tag, "names": f.names(i).strip(), "href": f.attrs[i].get("href"), "text": f.text[i]})
    return {"nodes": rows}


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pre, stop, chain, tag, names, href, text of every node of every page; null html is a page of its root alone."""
    rows = map_rows(pages.select(key, F.col(html).alias("markup")), NODES, lambda markup: read_nodes(markup), "markup")
    return rows.select(key, F.explode("nodes").alias("n")).select(key, "n.*")


def inside(key: str, which: Column) -> Column:
    """Whether a node lies in the subtree of some node that holds, or is it."""
    so_far = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.max(F.when(which, F.col("stop"))).over(so_far) > F.col("pre"), F.lit(False))


def measured(tree: DataFrame, key: str) -> DataFrame:
    """Elements with chars, commas and link_chars of their subtrees; text in stripped elements counts as none."""
    size = F.length(F.regexp_replace("text", "\\s", ""))
    flagged = tree.withColumns({"hidden": inside(key, F.col("tag").isin(*STRIPPED)), "linked": inside(key, F.col("tag") == "a")})
    shown = (F.col("tag") == "") & ~F.col("hidden")
    values = {
        "chars": F.when(shown, size).otherwise(0),
        "commas": F.when(shown, F.length("text") - F.length(F.translate("text", ",、", ""))).otherwise(0),
        "link_chars": F.when(shown & F.col("linked"), size).otherwise(0),
    }
    so_far = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = flagged.withColumns({f"{k}_to": F.sum(v.cast("long")).over(so_far) for k, v in values.items()})
    last = sums.select(F.col(key).alias("of"), F.col("pre").alias("at"), *[F.col(f"{k}_to").alias(f"{k}_end") for k in values])
    # an element has no text of its own, so what comes before its subtree is the sum up to itself
    whole = sums.filter("tag <> ''").join(last, (F.col(key) == F.col("of")) & (F.col("stop") - 1 == F.col("at")))
    return whole.select(key, "pre", "stop", "chain", "tag", "names", "href", "hidden", *[(F.col(f"{k}_end") - F.col(f"{k}_to")).alias(k) for k in values])


def _hinted(words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split("names", "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]))


def votes(elements: DataFrame, key: str) -> DataFrame:
    """key, pre, tag, blocks, raw, score and chars of every element that blocks of text vote for.

    A block of LEAST characters gives 1, one more for each comma and each 100 characters up to three, to its parent, and ever smaller parts to
    the four ancestors above, up to the body.  The score takes off the share of links and weighs names.
    """
    parts = elements.filter(F.col("tag").isin(*PARTS) & ~F.col("hidden")).select(key, F.col("chain")[0].alias("pre")).distinct().withColumn("parted", F.lit(True))
    blocks = elements.filter(F.col("tag").isin(*BLOCKS) & ~F.col("hidden") & (F.col("chars") >= LEAST))
    blocks = blocks.join(parts, [key, "pre"], "left").filter("tag <> 'div' OR parted IS NULL")
    weight = 1 + F.least(F.col("chars") / 100, F.lit(3.0)) + F.col("commas")
    given = blocks.select(key, weight.alias("weight"), F.posexplode("chain").alias("level", "pre"))
    raw = given.groupBy(key, "pre").agg(F.sum(F.col("weight") / F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("level") + 1)).alias("raw"), F.count("*").alias("blocks"))
    found = raw.join(elements.filter(~F.col("tag").isin(*TOP)), [key, "pre"])
    share = F.when(F.col("chars") > 0, F.col("link_chars") / F.col("chars")).otherwise(0.0)
    score = F.col("raw") * (1 - share) * F.when(_hinted(TOWARDS), 1.35).otherwise(1.0) * F.when(_hinted(AWAY), 0.4).otherwise(1.0)
    return found.select(key, "pre", "tag", "blocks", "raw", score.alias("score"), "chars")


def best(voted: DataFrame, key: str) -> DataFrame:
    """The element of the highest score of each page, the outermost of equal ones."""
    top = voted.groupBy(key).agg(F.max_by(F.struct("pre", "tag", "blocks", "score", "chars"), F.struct(F.round("score", 9), -F.col("pre"))).alias("b"))
    return top.select(key, "b.*")


def links(elements: DataFrame, key: str) -> DataFrame:
    """Links with an address, in document order."""
    return elements.filter("tag = 'a' AND href IS NOT NULL").select(key, "pre", "href", "hidden", "chars")


def headings(elements: DataFrame, key: str) -> DataFrame:
    return elements.filter(F.col("tag").isin(*HEADINGS)).select(key, "pre", F.substring("tag", 2, 1).cast("int").alias("rank"), "hidden", "chars")
