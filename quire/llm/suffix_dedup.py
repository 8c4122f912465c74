"""Suffix-array dedup: remove bytes that a long string of an earlier document covers.

Texts are UTF-8 bytes (null: empty).  A byte goes when a ``length``-byte string that covers
it also starts in a document with a smaller doc_id; strings never cross documents and are
judged on the input.  Copies of a row with the same doc_id do not remove each other; a null
doc_id counts as the smallest.  Texts shorter than ``length`` lose nothing.

Plan.  Each string belongs to the smallest hash of the ``gram``-byte grams in it.  Consecutive
strings with one such gram form a *run*; equal strings have equal grams, so runs can be dealt
to shards by gram and no repeat is split between shards.

1. buckets send the distinct grams of their runs, how many different runs each has and a hash of
   these; shards answer which occur in two documents, and which are *hot*: of more than ``hot`` runs;
2. buckets send the distinct runs of the shared grams, as bytes, with their smallest doc_id.  A phrase of fewer
   than ``length`` bytes may stand in any number of documents, each time in another run: runs of hot grams are cut into
   their strings, each dealt by its own hash, so that no gram fills a shard.  A shard
   concatenates its runs, sorts their suffixes by induced sorting (``sais``), takes permuted
   common prefixes, and answers for each string whether an earlier document has it;
3. buckets turn the answers into covered bytes.

Both exchanges hold packed arrays; the exchange of texts is made once and read three times.
"""

from __future__ import annotations

import functools
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sais
from quire.llm.blobs import GOLD, U, bits, bucketed, byte_table, deal, mix, pack, shard_cuts, trim, unbits, unpack
from quire.llm.words import spans
from quire.runtime import ship

LENGTH, GRAM = 50, 20
HOT = 1024  # runs of one gram that may meet in a shard
PARTS = 32  # a shard's runs are sorted in so many parts, by gram, one after the other
LEAST_ID = -(1 << 63)
DEAL = 0x94D049BB133111EB
BLOCK = 1 << 14  # small arrays stay in the processor's cache


def _least_grams(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each ``length``-byte string the least hash of its grams."""
    h, span, base = byte_table(1)[data], 1, pow(GOLD, 1, 1 << 64)
    levels = {1: h}
    while span * 2 <= gram:  # hashes of 2, 4, 8 ... bytes
        h = h[: len(h) - span] * U(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
        levels[span] = h
    hashed, have = levels[span], span
    while have < gram:
        add = 1 << ((gram - have).bit_length() - 1)
        hashed = hashed[: len(hashed) - add] * U(pow(base, add, 1 << 64)) + levels[add][have : have + len(hashed) - add]
        have += add
    least, wide, window = mix(hashed), 1, length - gram + 1
    while wide * 2 <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < window:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    return least


class _Bucket:
    """The documents of one bucket by doc_id, their runs and the distinct grams of these."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].to_numpy()
        self.null = None
        if table["doc_id"].null_count:
            self.null = table["doc_id"].is_null().to_numpy()
            self.ids = table["doc_id"].fill_null(LEAST_ID).to_numpy()
            order = np.argsort(self.ids, kind="stable")
            table, self.ids, self.null = table.take(order), self.ids[order], self.null[order]
        texts = [x.encode() for x in table["text"].to_pylist()]
        self.size = np.array([len(x) for x in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = length
        self._runs(length, gram)

    def _runs(self, length: int, gram: int) -> None:
        n, empty = len(self.data), np.zeros(0, np.int64)
        self.first = self.last = self.doc = empty
        self.grams, self.which, self.shared_here = np.zeros(0, U), empty, np.zeros(0, bool)
        if n < length or not (self.size >= length).any():
            return
        least = np.empty(n - length + 1, U)  # of the string that starts there
        for i in range(0, len(least), BLOCK):
            least[i : i + BLOCK] = _least_grams(self.data[i : i + BLOCK + length - 1], length, gram)
        # strings that cross documents end the runs; each document ends with at least one
        cross = np.zeros(n + 1, np.int8)
        some = self.size > 0
        np.add.at(cross, np.maximum(self.begin, self.begin + self.size - length + 1)[some], 1)
        np.add.at(cross, (self.begin + self.size)[some], -1)
        good = np.cumsum(cross[: len(least)], dtype=np.int8) == 0
        starts = good.copy()
        starts[1:] &= (least[1:] != least[:-1]) | ~good[:-1]
        self.first = np.flatnonzero(starts)
        stops = good
        stops[:-1] &= starts[1:] | ~good[1:]
        self.last = np.flatnonzero(stops) + 1  # one past the run's last string
        self.doc = np.searchsorted(self.begin + self.size, self.first, "right")
        value = mix(least[self.first] ^ U(DEAL))  # the least of many hashes is near zero: mixed again, all shards get as much
        self.grams, self.which = np.unique(value, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(self.grams), np.iinfo(np.int64).max), np.full(len(self.grams), LEAST_ID)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        self.shared_here = low < high

    def variety(self) -> tuple[np.ndarray, np.ndarray]:
        """For each gram how many different runs it has here, and 16 bits that stand for the set of these."""
        name = spans(self.data, self.first, self.last + self.length - 1, 13, 0xA0761D6478BD642F)
        order = np.lexsort((name, self.which))
        name, gram = name[order], self.which[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (gram[1:] != gram[:-1])
        name, gram = name[new], gram[new]
        if not len(gram):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        total = np.add.reduceat(name, np.flatnonzero(np.diff(gram, prepend=-1)))
        return np.bincount(gram).astype(np.uint32), (mix(total) >> U(48)).astype(np.uint16)

    def candidates(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the runs of shared grams, those of hot ones as single strings; name equal runs.

        Sets run, key and entry (by key), and the entries' first run and least doc_id.
        """
        shared, hot = (x[self.which] if len(self.which) else np.zeros(0, bool) for x in (shared, shared & hot))
        own, cut = np.flatnonzero(shared & ~hot), np.flatnonzero(hot)
        strings = self.last[cut] - self.first[cut]
        single = _ranges(self.first[cut], strings)
        key = mix(spans(self.data, single, single + self.length, 15, 0xE7037ED1A0B428DB))
        key = np.concatenate([self.grams[self.which[own]] if len(own) else np.zeros(0, U), key])
        self.doc = np.concatenate([self.doc[own], np.repeat(self.doc[cut], strings)])
        self.first, self.last = np.concatenate([self.first[own], single]), np.concatenate([self.last[own], single + 1])
        self.run = np.arange(len(key))
        size = self.last - self.first + self.length - 1
        sums = []
        for seed, base in ((3, 0xD6E8FEB86659FD93), (5, 0xCA5A826395121157)):
            sums.append(np.concatenate([spans(self.data, self.first[i], self.first[i] + size[i], seed, base) for i in (slice(len(own)), slice(len(own), None))]))
        order = np.lexsort((self.run, sums[1], sums[0], size, key))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in (key, size, *sums)])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.head = self.run[order[new]]  # runs come by doc_id, so the first of equal ones has the least
        self.entry_key = key[self.head]
        self.entry_id = self.ids[self.doc[self.head]] if len(order) else np.zeros(0, np.int64)
        self.strings = self.last[self.head] - self.first[self.head]


def _grams(table: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    b = _Bucket(table, length, gram)
    on, cut = shard_cuts(b.grams, shards)
    runs, sets = b.variety()
    bucket = table["bucket"][0].as_py() if len(table) else 0
    return pa.table({
        "shard": pa.array(on, pa.int32()),
        "bucket": pa.array([bucket] * len(on), pa.int32()),
        "keys": pa.array([b.grams[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
        "here": pa.array([bits(b.shared_here[i:j]) for i, j in pairwise(cut)], pa.binary()),
        "runs": pa.array([pack(runs[i:j]) for i, j in pairwise(cut)], pa.binary()),
        "sets": pa.array([sets[i:j].tobytes() for i, j in pairwise(cut)], pa.binary()),
    })


def shared_keys(table: pa.Table) -> pa.Table:
    """One shard: which keys come from two buckets, or from two documents of one."""
    keys = [np.frombuffer(x, U) for x in table["keys"].to_pylist()]
    here = [unbits(x, len(k)) for x, k in zip(table["here"].to_pylist(), keys, strict=True)]
    every, size = np.concatenate(keys), [len(k) for k in keys]
    order = np.argsort(every, kind="stable")
    s = every[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    out = np.empty(len(s), bool)
    out[order] = twice
    out |= np.concatenate(here)
    cut = np.cumsum([0, *size])
    return pa.table({
        "bucket": table["bucket"].cast(pa.int32()),
        "shard": table["shard"].cast(pa.int32()),
        "stage": pa.array([0] * len(size), pa.int32()),
        "bits": pa.array([bits(out[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
    })


def _gram_answers(table: pa.Table, hot: int) -> pa.Table:
    """One shard: which grams two documents have, and (stage 2) which have more than ``hot`` different runs.

    Buckets with the same set of runs count once: a passage of many documents has the same few runs everywhere.
    """
    every = np.concatenate([np.frombuffer(x.as_py(), U) for x in table["keys"]])
    runs = np.concatenate([unpack(x.as_py(), np.uint32) for x in table["runs"]]).astype(np.int64)
    sets = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table["sets"]])
    order = np.lexsort((sets, every))
    gram = np.diff(every[order], prepend=every[order[:1]] ^ U(1)) != 0
    new = gram.copy()
    new[1:] |= sets[order][1:] != sets[order][:-1]
    # the runs of a gram: a sum over its different sets
    total = np.add.reduceat(np.where(new, runs[order], 0), np.flatnonzero(gram))
    much = np.empty(len(every), bool)
    much[order] = (total > hot)[np.cumsum(gram) - 1]
    cut = np.cumsum([0, *[len(x.as_py()) // 8 for x in table["keys"]]])
    some = [k for k, (i, j) in enumerate(pairwise(cut)) if much[i:j].any()]
    said = pa.table({
        "bucket": table["bucket"].cast(pa.int32()).take(pa.array(some, pa.int64())),
        "shard": table["shard"].cast(pa.int32()).take(pa.array(some, pa.int64())),
        "stage": pa.array([2] * len(some), pa.int32()),
        "bits": pa.array([bits(much[cut[k] : cut[k + 1]]) for k in some], pa.binary()),
    })
    return pa.concat_tables([shared_keys(table), said])


REPLY = "bucket int, shard int, stage int, bits binary"


def replies(table: pa.Table, stage: int, on: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The shards' bits of one stage, in the order of the keys that were sent."""
    out = np.zeros(int(cut[-1]), bool)
    t = table.to_pydict() if len(table) else {"shard": [], "stage": [], "bits": []}
    place = np.searchsorted(on, t["shard"])
    for k, at, b in zip(place, t["stage"], t["bits"], strict=True):
        if at == stage:
            out[cut[k] : cut[k + 1]] = unbits(b, int(cut[k + 1] - cut[k]))
    return out


def _with_candidates(docs: pa.Table, answers: pa.Table, length: int, gram: int, shards: int) -> _Bucket:
    b = _Bucket(docs, length, gram)
    cuts = shard_cuts(b.grams, shards)
    b.candidates(replies(answers, 0, *cuts), replies(answers, 2, *cuts))
    return b


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... size[0] numbers, then the next."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def _entries(docs: pa.Table, answers: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    if not len(docs):
        return pa.table({"shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "size": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "parts": pa.array([], pa.binary())})
    b = _with_candidates(docs, answers, length, gram, shards)
    on, cut = shard_cuts(b.entry_key, shards)
    size = b.strings + length - 1
    part = (mix(b.entry_key) % U(PARTS)).astype(np.uint8)
    return pa.table({
        "shard": pa.array(on, pa.int32()),
        "bucket": pa.array([docs["bucket"][0].as_py()] * len(on), pa.int32()),
        "data": pa.array([pack(b.data[_ranges(b.first[b.head[i:j]], size[i:j])]) for i, j in pairwise(cut)], pa.binary()),
        "size": pa.array([pack(size[i:j].astype(np.int32)) for i, j in pairwise(cut)], pa.binary()),
        "ids": pa.array([pack(b.entry_id[i:j]) for i, j in pairwise(cut)], pa.binary()),
        "parts": pa.array([pack(part[i:j]) for i, j in pairwise(cut)], pa.binary()),
    })


def _suffixes(table: pa.Table, length: int) -> pa.Table:
    """One shard: sort the suffixes of its distinct runs; answer which strings an earlier document has."""
    def column(name, dtype):
        return [unpack(x.as_py(), dtype) for x in table[name]]

    sizes = column("size", np.int32)
    rows = np.cumsum([0, *[len(x) for x in sizes]])
    size = np.concatenate(sizes).astype(np.int64)
    ids, part, data = (np.concatenate(column(*x)) for x in (("ids", np.int64), ("parts", np.uint8), ("data", np.uint8)))
    begin = np.cumsum(size) - size
    before = np.concatenate([[0], np.cumsum(size - length + 1)])  # strings of earlier runs
    found = np.empty(int(before[-1]), bool)
    order = np.argsort(part, kind="stable")
    for i, j in pairwise(np.searchsorted(part[order], np.arange(PARTS + 1))):
        if i < j:
            on = order[i:j]
            found[_ranges(before[on], size[on] - length + 1)] = _earlier(data[_ranges(begin[on], size[on])], size[on], ids[on], length)
    return pa.table({
        "bucket": table["bucket"].cast(pa.int32()),
        "shard": table["shard"].cast(pa.int32()),
        "stage": pa.array([1] * len(sizes), pa.int32()),
        "bits": pa.array([bits(found[i:j]) for i, j in pairwise(before[rows])], pa.binary()),
    })


def _earlier(data: np.ndarray, size: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each string of each run, in order: has a document with a smaller id this string?"""
    begin = np.cumsum(size) - size
    # equal runs of several buckets enter once, with their least doc_id
    sums = [spans(data, begin, begin + size, seed, base) for seed, base in ((7, 0xA0761D6478BD642F), (9, 0xE7037ED1A0B428DB))]
    order = np.lexsort((ids, sums[1], sums[0], size))
    key = [x[order] for x in (size, *sums)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    one = np.empty(len(order), np.int64)
    one[order] = np.cumsum(new) - 1
    head = order[new]
    # byte 0 may be text: a separator only keeps runs apart, strings never reach over it
    own = size[head] + 1
    at = np.cumsum(own) - own
    t = np.zeros(int(own.sum()), np.uint8)
    t[_ranges(at, size[head])] = data[_ranges(begin[head], size[head])]
    entry = np.repeat(np.arange(len(head)), own)
    whole = np.arange(len(t)) + length <= (at + size[head])[entry]
    sa = sais.suffix_array(t, length)
    sa = sa[whole[sa]]
    same = sais.permuted_common(t, sa, length)[sa]
    groups = np.flatnonzero(~same)
    least = np.empty(len(t), np.int64)
    if len(sa):
        low = np.minimum.reduceat(ids[head][entry[sa]], groups)
        least[sa] = np.repeat(low, np.diff(np.append(groups, len(sa))))
    strings = size - length + 1
    return least[_ranges(at[one], strings)] < np.repeat(ids, strings)


OUT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_spans(covered: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each document its maximal covered runs, relative to its own start."""
    edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]).astype(np.int8))
    inner = begin[(size > 0) & (begin > 0)]
    split = inner[covered[inner] & covered[inner - 1]] if len(covered) else inner  # a run that goes on in the next document
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
    full = np.flatnonzero(size > 0)
    doc = full[np.searchsorted(begin[full], starts, "right") - 1] if len(full) else np.zeros(0, np.int64)
    offsets = np.searchsorted(doc, np.arange(len(size) + 1))
    values = pa.StructArray.from_arrays([pa.array(starts - begin[doc]), pa.array(ends - begin[doc])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _cover(docs: pa.Table, answers: pa.Table, length: int, gram: int, shards: int) -> pa.Table:
    if not len(docs):
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], SPAN), "kept": pa.array([], pa.binary())})
    b = _with_candidates(docs, answers, length, gram, shards)
    on, cut = shard_cuts(b.entry_key, shards)
    before = np.concatenate([[0], np.cumsum(b.strings)])
    earlier = replies(answers, 1, on, before[cut])
    strings = b.strings[b.entry]
    flag = earlier[_ranges(before[:-1][b.entry], strings)]
    flag |= np.repeat(b.ids[b.doc[b.run]] > b.entry_id[b.entry], strings)
    mark = np.zeros(len(b.data) + 1, np.int32)
    start = _ranges(b.first[b.run], strings)[flag]
    mark[start] += 1  # each string once
    mark[start + length] -= 1
    covered = np.cumsum(mark[:-1]) > 0
    kept = b.data[~covered].tobytes()
    stay = np.concatenate([[0], np.cumsum(~covered)])
    edge = stay[np.append(b.begin, len(b.data))] if len(b.size) else np.zeros(1, np.int64)
    return pa.table({
        "doc_id": pa.array(b.ids, pa.int64(), mask=b.null),
        "n_bytes": pa.array(b.size, pa.int64()),
        "spans": cut_spans(covered, b.begin, b.size),
        "kept": pa.array([kept[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
    })


def dedup_suffixes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges) and kept (remaining bytes).

    Null text: empty.  An empty table gives an empty table.  Other columns are not read.
    ``hot`` bounds the runs of one gram in a shard; it moves work and changes no result.
    """
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and smaller than length")
    ship(docs.sparkSession)
    n, shards = deal(docs, text)
    own = bucketed(docs, n, doc_id, text)
    f = functools.partial
    one = own.groupBy("bucket").applyInArrow(_wrap(f(_grams, length=length, gram=gram, shards=shards)), "shard int, bucket int, keys binary, here binary, runs binary, sets binary")
    first = one.groupBy("shard").applyInArrow(_wrap(f(_gram_answers, hot=hot)), REPLY)
    two = own.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_wrap2(f(_entries, length=length, gram=gram, shards=shards)), "shard int, bucket int, data binary, size binary, ids binary, parts binary")
    second = two.groupBy("shard").applyInArrow(_wrap(f(_suffixes, length=length)), REPLY)
    return own.groupBy("bucket").cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(_wrap2(f(_cover, length=length, gram=gram, shards=shards)), OUT)


def _wrap(f):
    def one(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            out = f(table)
        trim()
        return out

    return one


def _wrap2(f):
    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            out = f(left, right)
        trim()
        return out

    return two


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of ``dedup_suffixes`` over the whole of documents."""
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
