"""Substring dedup by recompression: remove words that an earlier window of the corpus covers.

Words are runs of bytes other than blank and 9 to 13, compared unchanged (null text: none).  A
word goes when a window of ``window`` consecutive words of its document covers it whose word
sequence also starts earlier: in a document with a smaller doc_id or before it in the same one.
Windows are judged on the input and never cross documents.  Rows that share a doc_id do not
remove each other; a null doc_id counts as the smallest.

Each round of recompression replaces runs of one symbol by a name of (symbol, count), then
pairs of a *left* and a *right* symbol by a name of both.  A name is a hash of what it stands
for and its side a bit of that hash, so a round names globally without an exchange, and equal
word sequences get equal symbols in their interior.  How far the interior reaches is tracked
exactly: every symbol carries the words that its forming looked at.

1. buckets send their interior symbols (with the words they looked at); shards answer which
   occur twice.  A repeated window has only shared interior symbols;
2. buckets send the windows that are left, with the smallest doc_id.  A window is named, in 128 bits, by its
   interior symbols in their order and the few words before and behind them that no interior symbol spans: equal windows
   have equal symbols there, and equal names mean equal words.  Shards verify which names an earlier document has;
3. buckets turn the answers into removed words.
"""

from __future__ import annotations

import functools
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blobs import U, bits, bucketed, deal, mix, pack, powers, shard_cuts, unpack
from quire.llm.suffix_dedup import LEAST_ID, REPLY, SPAN, _ranges, _wrap, _wrap2, cut_spans, replies, shared_keys
from quire.llm.words import Words
from quire.runtime import ship

WINDOW, ROUNDS = 20, 3
FAR = 1 << 40


def recompress(symbol: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, the words [low, high) that each depends on, and the first word that it spans.

    first marks the first word of each document; what looks over a document's edge depends on
    words at -FAR or FAR, so that no window holds it.
    """
    low = np.arange(len(symbol), dtype=np.int64)
    high = low + 1
    at = low.copy()

    def before(i):
        return np.where(first[i], -FAR, low[np.maximum(i - 1, 0)])

    def after(i):
        nxt = np.minimum(i + 1, len(symbol) - 1)
        return np.where((i + 1 >= len(symbol)) | first[nxt], FAR, high[nxt])

    for k in range(rounds):
        if not len(symbol):
            break
        same = np.zeros(len(symbol), bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & ~first[1:]
        head = np.flatnonzero(~same)
        last = np.append(head[1:], len(symbol)) - 1
        count = (last - head + 1).astype(U)
        new_low, new_high = before(head), after(last)
        symbol = np.where(count > 1, mix(symbol[head] ^ mix(count + U(2 * k + 1))), symbol[head])
        first, at, low, high = first[head], at[head], new_low, new_high
        left = (mix(symbol + U(0x51ED27 + k)) >> U(63)).astype(bool)
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~first[1:]
        keep = np.ones(len(symbol), bool)
        keep[1:] = ~pair[:-1]
        i = np.flatnonzero(keep)
        nxt = np.minimum(i + 1, len(symbol) - 1)
        new_low = np.where(left[i], low[i], before(i))
        new_high = np.where(left[i], after(i), high[i])
        symbol = np.where(pair[i], mix(symbol[i] * U(0x9E3779B97F4A7C15) + mix(symbol[nxt] ^ U(k + 1))), symbol[i])
        first, at, low, high = first[i], at[i], new_low, new_high
    return symbol, low, high, at


class _Bucket:
    def __init__(self, table: pa.Table, window: int, rounds: int):
        ids = table["doc_id"].fill_null(LEAST_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        table = table.take(order)
        self.ids = ids[order]
        self.null = table["doc_id"].is_null().to_numpy() if table["doc_id"].null_count else None
        self.words = w = Words([x.encode() for x in table["text"].to_pylist()])
        self.window, n = window, len(w.start)
        self.names = w.hashes()
        first = np.zeros(n, bool)
        first[w.begin[w.count > 0]] = True
        symbol, low, high, at = recompress(self.names, first, rounds)
        inner = (low >= 0) & (high <= n) & (high - low <= window)
        end = np.append(at[1:], n)[inner] if len(at) else at
        symbol, self.low, self.high, self.span = symbol[inner], low[inner], high[inner], (at[inner], end)
        self.symbol = symbol
        base = 0xE7037ED1A0B428DB
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.names * powers(base, n)[:-1])])
        seen = (total[self.high] - total[self.low]) * powers(pow(base, -1, 1 << 64), n)[self.low]
        self.keys, self.which, count = np.unique(mix(symbol ^ mix(seen + (self.high - self.low).astype(U))), return_inverse=True, return_counts=True)
        self.shared_here = count > 1

    def candidates(self, shared: np.ndarray) -> None:
        """at: windows whose interior symbols are all shared; entry: their distinct names, by name."""
        w, size, n = self.words, self.window, len(self.words.start)
        alone = ~shared[self.which] if len(self.which) else np.zeros(0, bool)
        mark = np.zeros(n + 1, np.int32)  # a window that starts in [high - size, low] holds the symbol
        np.add.at(mark, np.maximum(self.high[alone] - size, 0), 1)
        np.add.at(mark, self.low[alone] + 1, -1)
        fits = np.arange(n) + size <= (w.begin + w.count)[w.doc] if n else np.zeros(0, bool)
        self.at = np.flatnonzero((np.cumsum(mark[:-1]) == 0) & fits)
        a, b = (self._named(self.at, x) for x in (0xCA5A826395121157, 0xA0761D6478BD642F))
        order = np.lexsort((self.at, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        head = order[new]
        self.name_a, self.name_b = a[head], b[head]
        self.entry_id = self.ids[w.doc[self.at[head]]] if len(head) else np.zeros(0, np.int64)
        row = w.doc[self.at[order]] if len(order) else np.zeros(0, np.int64)
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (row[1:] == row[:-1])
        self.again = np.empty(len(order), bool)  # it starts earlier in the same row
        self.again[order] = again


    def _named(self, at: np.ndarray, base: int) -> np.ndarray:
        """A name of each window that starts at one of these words, from its interior symbols and the words around them."""
        if not len(at):
            return np.zeros(0, U)
        end = at + self.window
        # interior symbols follow each other: what lies between two of them depends on no more than both do
        a, b = np.searchsorted(self.low, at, "left"), np.searchsorted(self.high, end, "right")
        some = a < b
        a, b = np.where(some, a, 0), np.where(some, b, 0)
        if len(self.symbol):
            head, tail = np.where(some, self.span[0][np.minimum(a, len(self.symbol) - 1)], end), np.where(some, self.span[1][b - 1], end)
        else:
            head = tail = end
        out = np.zeros(len(at), U)
        for row, i, j in ((self.names, at, head), (self.symbol, a, b), (self.names, tail, end)):
            total, back = np.zeros(len(row) + 1, U), powers(pow(base, -1, 1 << 64), len(row))
            np.cumsum(row * powers(base, len(row))[:-1], out=total[1:])
            out = mix((total[j] - total[i]) * back[i] + mix(out + (j - i).astype(U)))
        return out


def _keys(table: pa.Table, window: int, rounds: int, shards: int) -> pa.Table:
    b = _Bucket(table, window, rounds)
    on, cut = shard_cuts(b.keys, shards)
    return pa.table({
        "shard": pa.array(on, pa.int32()),
        "bucket": pa.array([table["bucket"][0].as_py()] * len(on), pa.int32()),
        "keys": pa.array([b.keys[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
        "here": pa.array([bits(b.shared_here[i:j]) for i, j in pairwise(cut)], pa.binary()),
    })


def _with_candidates(docs: pa.Table, answers: pa.Table, window: int, rounds: int, shards: int) -> _Bucket:
    b = _Bucket(docs, window, rounds)
    b.candidates(replies(answers, 0, *shard_cuts(b.keys, shards)))
    return b


def _windows(docs: pa.Table, answers: pa.Table, window: int, rounds: int, shards: int) -> pa.Table:
    if not len(docs):
        return pa.table({"shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    b = _with_candidates(docs, answers, window, rounds, shards)
    on, cut = shard_cuts(b.name_a, shards)
    return pa.table({
        "shard": pa.array(on, pa.int32()),
        "bucket": pa.array([docs["bucket"][0].as_py()] * len(on), pa.int32()),
        "a": pa.array([b.name_a[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
        "b": pa.array([b.name_b[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
        "ids": pa.array([pack(b.entry_id[i:j]) for i, j in pairwise(cut)], pa.binary()),
    })


def _earlier(table: pa.Table) -> pa.Table:
    """One shard: which windows a document with a smaller doc_id has, of all that carry the same name."""
    a = [np.frombuffer(x, U) for x in table["a"].to_pylist()]
    size = [len(x) for x in a]
    a, b = np.concatenate(a), np.concatenate([np.frombuffer(x, U) for x in table["b"].to_pylist()])
    ids = np.concatenate([unpack(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(ids[order], group), np.diff(np.append(group, len(order))))
    out = np.empty(len(order), bool)
    out[order] = low < ids[order]
    cut = np.cumsum([0, *size])
    return pa.table({
        "bucket": table["bucket"].cast(pa.int32()),
        "shard": table["shard"].cast(pa.int32()),
        "stage": pa.array([1] * len(size), pa.int32()),
        "bits": pa.array([bits(out[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
    })


OUT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary"


def _cover(docs: pa.Table, answers: pa.Table, window: int, rounds: int, shards: int) -> pa.Table:
    if not len(docs):
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "spans": pa.array([], SPAN), "kept": pa.array([], pa.binary())})
    b = _with_candidates(docs, answers, window, rounds, shards)
    w = b.words
    flag = replies(answers, 1, *shard_cuts(b.name_a, shards))[b.entry] if len(b.at) else np.zeros(0, bool)
    if len(b.at):
        flag |= (b.ids[w.doc[b.at]] > b.entry_id[b.entry]) | b.again
    n = len(w.start)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, b.at[flag], 1)
    np.add.at(mark, b.at[flag] + window, -1)
    covered = np.cumsum(mark[:-1]) > 0
    stay = np.flatnonzero(~covered)
    size = w.end[stay] + 1 - w.start[stay]  # with the blank behind it
    kept = w.data[_ranges(w.start[stay], size)]
    if len(kept):
        kept[np.cumsum(size) - 1] = 0x20
    kept = kept.tobytes()
    left = np.bincount(w.doc[stay], weights=size, minlength=len(w.count)).astype(np.int64) if len(w.count) else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(left)])
    return pa.table({
        "doc_id": pa.array(b.ids, pa.int64(), mask=b.null),
        "n_words": pa.array(w.count.astype(np.int64), pa.int64()),
        "spans": cut_spans(covered, w.begin, w.count),
        "kept": pa.array([kept[i : max(i, j - 1)] for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
    })


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (removed word ranges) and kept (UTF-8, words joined by one blank).

    Null and empty texts have no words.  An empty table gives an empty table.  Other columns are not read.
    """
    if window < 2 or rounds < 0:
        raise ValueError("window must be at least 2 and rounds not negative")
    ship(docs.sparkSession)
    n, shards = deal(docs, text)
    own = bucketed(docs, n, doc_id, text)
    p = {"window": window, "rounds": rounds, "shards": shards}
    one = own.groupBy("bucket").applyInArrow(_wrap(functools.partial(_keys, **p)), "shard int, bucket int, keys binary, here binary")
    first = one.groupBy("shard").applyInArrow(_wrap(shared_keys), REPLY)
    two = own.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_wrap2(functools.partial(_windows, **p)), "shard int, bucket int, a binary, b binary, ids binary")
    second = two.groupBy("shard").applyInArrow(_wrap(_earlier), REPLY)
    return own.groupBy("bucket").cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(_wrap2(functools.partial(_cover, **p)), OUT)


def op2_recompression_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``dedup_windows`` over the whole of documents."""
    out = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
