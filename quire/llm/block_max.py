"""Ranked lexical search with block-max pruning.

``build`` turns documents into a table of blocks, one row for each range of BLOCK consecutive documents.  A block
is a small forward index: the documents with the terms and impacts of each, a dictionary of its terms, and for each term the
largest impact in the block and the documents that hold it.  An impact is the part of the score that doesn't depend on the query.

``search`` sends some items at a time to all tasks that read blocks.  A task adds up the maxima of an item's terms, which bounds the score of
every document of a block, visits the blocks from the largest bound down, scores the documents of each by its forward index, and
stops at the first block whose bound is below the tenth score found so far; a block with that very bound is
scored, as a tie may have a smaller doc_id.  The best of all tasks are merged in two steps.  Results are exact: integers throughout.

Terms are maximal runs of letters beyond ASCII, A-Z, a-z and 0-9, of which only A-Z are lower-cased.  They go by 64-bit names.
Texts that are null or have no term are no documents: they don't count and are never found; items without a term find nothing.
Rows of one doc_id, and rows of one item_id, are judged one by one; a null doc_id ranks after others of its score.
Empty tables give empty tables.  Very long texts make blocks of their own.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.blobs import U, pack, trim, unpack
from quire.llm.words import spans
from quire.runtime import materialize, ship

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 64  # documents in a block
BLOCK_BYTES = 1_000_000  # text in a block, unless one document has more
TOP = 10
PASS_BYTES = 400_000  # text of the items that go to the tasks together
SALTS = 64
SLICE = 128  # blocks whose bounds are computed together
INDEX = "n_docs int, ids array<long>, terms binary, counts binary, maxima binary, starts binary, places binary, impacts binary"
FOUND = "item long, doc_id long, score long"

# Letters of terms, and A-Z to a-z, by byte: every byte of a letter beyond ASCII is 0x80 or more.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def term_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit name of every term."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    edge = np.diff(np.concatenate([[False], LETTER[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    with np.errstate(over="ignore"):
        return np.searchsorted(stop, start, "right"), spans(data, start, end)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    m = 100 - 75 + 75 * n * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _block(ids: list, texts: list[bytes], documents: int, terms: int) -> list:
    doc, name = term_names(texts)
    count = np.bincount(doc, minlength=len(texts))
    words, place = np.unique(name, return_inverse=True)
    code, tf = np.unique(doc * np.int64(max(len(words), 1)) + place, return_counts=True)
    doc, place = code // max(len(words), 1), code % max(len(words), 1)
    value = impact(tf, count[doc], documents, max(terms, 1))
    best = np.zeros(len(words), np.int64)
    np.maximum.at(best, place, value)
    some = np.flatnonzero(count)
    starts = np.searchsorted(doc, some)
    return [len(some), [ids[i] for i in some.tolist()], pack(words), pack(np.bincount(place, minlength=len(words)).astype(np.uint32)), pack(best.astype(np.uint32)), pack(starts.astype(np.uint32)), pack(place.astype(np.uint32)), pack(value.astype(np.uint32))]


def _blocks(documents: int, terms: int, size: int):
    schema = ["n_docs", "ids", "terms", "counts", "maxima", "starts", "places", "impacts"]
    kinds = [pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]

    def run(batches):
        for batch in batches:
            trim()
            ids = batch["doc_id"].to_pylist()
            texts, held, out, at = [], 0, [], 0

            def close(to):
                row = _block(ids[at:to], texts, documents, terms)
                if row[0]:
                    out.append(row)

            for i, x in enumerate(batch["text"]):
                x = (x.as_py() or "").encode()
                if texts and (len(texts) == size or held + len(x) > BLOCK_BYTES):
                    close(i)
                    texts, held, at = [], 0, i
                texts.append(x)
                held += len(x)
            close(len(ids))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema)

    return run


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The table of blocks, the number of documents with a term, and the number of their terms."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    total = own.agg(F.sum((n > 0).cast("long")).alias("documents"), F.sum(n).alias("terms")).first()
    documents, terms = total.documents or 0, total.terms or 0
    return materialize(own.mapInArrow(_blocks(documents, terms, size), INDEX), "search-blocks"), documents, terms


def _frequencies(wanted: np.ndarray):
    """Documents of each wanted term, a row for each batch of blocks and term."""

    def run(batches):
        for batch in batches:
            total = np.zeros(len(wanted), np.int64)
            for words, counts in zip(batch["terms"], batch["counts"]):
                words, counts = unpack(words.as_buffer(), U), unpack(counts.as_buffer(), np.uint32)
                at, inside = _find(words, wanted)
                total[inside] += counts[at[inside]]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    return run


def _find(words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted name would stand in sorted words, and whether it does."""
    at = np.searchsorted(words, wanted)
    return at, (words[np.minimum(at, len(words) - 1)] == wanted) if len(words) else np.zeros(len(wanted), bool)


class Best:
    """The best documents of one item so far, best first."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = 0

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= max(self.least, 1)
        if not keep.any():
            return
        score, doc = np.concatenate([self.score, score[keep]]), np.concatenate([self.doc, doc[keep]])
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.top:
            self.least = int(self.score[-1])


NOBODY = np.iinfo(np.int64).max  # stands for a null doc_id, after all others


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: np.ndarray, top: int, visited: bool):
    """items: id, places in the sorted vocabulary, and weight times occurrences of each; blocks in, best documents out."""

    def run(batches):
        best = [Best(top) for _ in items]
        blocks = scored = 0
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            n = batch.num_rows
            most = np.zeros((len(vocabulary), n), np.int64)
            where = np.zeros((len(vocabulary), n), np.int32)
            inside = np.zeros((len(vocabulary), n), bool)
            for b, (words, maxima) in enumerate(zip(batch["terms"], batch["maxima"])):
                words = unpack(words.as_buffer(), U)
                at, has = _find(words, vocabulary)
                where[:, b], inside[:, b] = at, has
                most[has, b] = unpack(maxima.as_buffer(), np.uint32)[at[has]]
            opened: dict[int, tuple] = {}
            blocks += n * len(items)
            for (_, place, value), found in zip(items, best):
                bound = value @ most[place]
                for b in np.argsort(-bound, kind="stable").tolist():
                    if bound[b] < max(found.least, 1):
                        break
                    if b not in opened:
                        ids = batch["ids"][b].values
                        opened[b] = ids.fill_null(NOBODY).to_numpy(), *(unpack(batch[c][b].as_buffer(), np.uint32) for c in ("starts", "places", "impacts"))
                    ids, starts, places, impacts = opened[b]
                    has = inside[place, b]
                    local = np.zeros(int(places.max()) + 1, np.int64)
                    local[where[place[has], b]] = value[has]
                    found.offer(np.add.reduceat(local[places] * impacts, starts), ids)
                    scored += 1
        if visited:
            yield pa.RecordBatch.from_arrays([pa.array([blocks]), pa.array([scored])], ["blocks", "scored"])
            return
        item = np.concatenate([np.full(len(f.doc), k) for k, f in enumerate(best)]) if items else np.zeros(0, np.int64)
        doc, score = (np.concatenate([getattr(f, c) for f in best]) if items else np.zeros(0, np.int64) for c in ("doc", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(doc, mask=doc == NOBODY), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _first(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def _passes(items: DataFrame, item_id: str, text: str, pass_bytes: int) -> tuple[DataFrame, int]:
    """Items as item_id, text, lot and place in the lot; lots of about pass_bytes of text each, and the number of lots."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(1, -(-total // pass_bytes))
    rows = materialize(rows.withColumn("lot", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(lots)).cast("int")), "items")
    return rows, lots


def search(index: tuple[DataFrame, int, int], items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, pass_bytes: int = PASS_BYTES, visited: bool = False) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents with a score above 0 of every item.

    Items go to the tasks in lots of about pass_bytes of text, so a task's memory is bounded.  visited: pairs of
    item and block, and how many of them were scored, of each task instead.
    """
    blocks, documents, _ = index
    rows, lots = _passes(items, item_id, text, pass_bytes)
    out = []
    for lot in range(lots):
        mine = rows.filter(F.col("lot") == lot).select("item_id", "text").collect()
        item, name = term_names([r.text.encode() for r in mine])
        vocabulary = np.unique(name)
        found = blocks.select("terms", "counts").mapInArrow(_frequencies(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        df = {r.term: r.df for r in found}
        by = np.array([weight(documents, df.get(t, 0)) for t in vocabulary.view(np.int64).tolist()], np.int64)
        terms = []
        for k in range(len(mine)):
            own = Counter(np.searchsorted(vocabulary, name[item == k]).tolist())
            place = np.array(sorted(own), np.int64)
            terms.append((k, place, by[place] * np.array([own[p] for p in place.tolist()], np.int64)))
        run = _search(terms, vocabulary, top, visited)
        if visited:
            out.append(blocks.mapInArrow(run, "blocks long, scored long"))
            continue
        part = blocks.select("ids", "terms", "maxima", "starts", "places", "impacts").mapInArrow(run, FOUND)
        # a task gives no more than top rows of an item; groups of tasks, then all of them
        part = _first(part.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["item", "salt"], top).drop("rank")
        part = _first(part, ["item"], top)
        names = index[0].sparkSession.createDataFrame([(k, r.item_id) for k, r in enumerate(mine)], "item long, item_id long") if mine else None
        if names is not None:
            out.append(part.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not out:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op13_block_max_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# Another way: all postings of the items' terms, joined, summed and ranked.
_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("text")} AS terms FROM documents),
size AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM doc WHERE len(terms) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS big, CAST(sum(n) AS BIGINT) AS long FROM size),
posting AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM doc) GROUP BY row, term),
item AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format("text")} AS terms FROM benchmark),
asked AS (SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM item) GROUP BY q, item_id, term),
known AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
heavy AS (SELECT term, CAST(floor(1000 * ln((2 * big + 2) / (2 * df + 1))) AS BIGINT) AS w FROM known, whole),
score AS (SELECT q, item_id, s.doc_id, s.row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big) // long)))) AS BIGINT) AS score
  FROM asked JOIN posting USING (term) JOIN heavy USING (term) JOIN size s USING (row), whole GROUP BY q, item_id, s.doc_id, s.row),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
