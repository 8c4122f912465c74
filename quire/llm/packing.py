"""Packing along a space-filling curve.

Token counts, hashed to ``WIDTH`` numbers and scaled to length one, are projected to ``DIMENSIONS``
fixed random directions; each coordinate becomes ``BITS`` bits and all together a Hilbert key.
Documents are range-sorted by (key, doc_id), so neighbours on the curve follow each other, and
each range is one stream of tokens that is cut at every ``size``.  What is left at the end of a
range is cut into sequences of powers of two.  So no sequence has padding.

A document is its tokens and the end token.  Null and empty texts are the end token alone.  Rows
with the same doc_id are packed each for itself.  Copies have one key; doc_id spreads them.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.blobs import U, mix, trim
from quire.llm.suffix_dedup import _ranges
from quire.llm.words import spans
from quire.runtime import materialize, ship

SIZE, END, WIDTH, DIMENSIONS, BITS = 4096, 2, 256, 4, 10
CHUNK, KNOWN, RANGE_TOKENS = 400_000, 500_000, 4_000_000
#: A letter beyond U+024F, or the dotted capital I: lower case or normal form may depend on more than the letter.
FAR = re.compile("[^\x00-ɏ]|İ")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What the cutting below holds for; texts go to any other tokenizer whole.
NORMAL = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
SPLIT = r"""Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True)"""
BLANK, LETTER, DIGIT, MARK = 0, 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[0x30:0x3A] = DIGIT
#: Bytes whose word is looked up whole: the apostrophe, separators that only Python takes as blanks, U+0080 to U+00BF, from U+0280.
ODD = np.zeros(256, bool)
ODD[[0x27, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, *range(0xCA, 0x100)]] = True
SLOTS = 1 << 20


class Table:
    """Numbers of 64-bit names, by open addressing; every step takes a whole array."""

    def __init__(self):
        self.names, self.number = np.zeros(SLOTS, U), np.full(SLOTS, -1, np.int32)

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of each name, -1 where it is unknown."""
        seat = (names >> U(44)).astype(np.int64)
        out = self.number[seat]
        off = np.flatnonzero((out >= 0) & (self.names[seat] != names))
        while len(off):
            seat = (seat[off] if len(seat) == len(names) else seat) + 1 & SLOTS - 1
            here = self.number[seat]
            wrong = (here >= 0) & (self.names[seat] != names[off])
            out[off[~wrong]] = here[~wrong]
            off, seat = off[wrong], seat[wrong]
        return out

    def add(self, names: np.ndarray, first: int) -> None:
        """Distinct new names get the numbers from first on."""
        seat, number = (names >> U(44)).astype(np.int64), np.arange(first, first + len(names), dtype=np.int32)
        while len(names):
            free = np.flatnonzero(self.number[seat] < 0)
            self.number[seat[free]], self.names[seat[free]] = number[free], names[free]
            late = self.number[seat] != number
            names, number, seat = names[late], number[late], seat[late] + 1 & SLOTS - 1


class Tokens:
    """Ids of texts.  The vocabulary drops white space and no token spans it, so pieces are looked up.

    Words are cut where the tokenizer cuts them, into runs of letters, digits and marks, all in numpy; pieces
    are known by 64-bit names.  Only new pieces go to the tokenizer.  Words for which bytes don't tell the cuts are
    looked up whole; those with a special token's opening or letters beyond U+024F go to it as they are.  At most
    KNOWN pieces are kept, some 25 MB; what came again outlives a clearance.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, tool = path, Tokenizer.from_file(path)
        self.type = np.uint16 if tool.get_vocab_size() <= 1 << 16 else np.uint32
        self.cuts = str(tool.normalizer) == NORMAL and SPLIT in str(tool.pre_tokenizer)
        if not self.cuts:
            self.tool = tool
        else:
            # pieces are in normal form and cut already, so the same model takes them without those steps
            self.bare = tool
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self._clear()

    @functools.cached_property
    def tool(self):
        """The whole tokenizer, read when the first word needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _clear(self) -> None:
        self.table, self.count, self.filled = Table(), 0, 0
        self.names, self.begin, self.size = np.zeros(KNOWN, U), np.zeros(KNOWN, np.int32), np.zeros(KNOWN, np.int32)
        self.uses, self.ids = np.zeros(KNOWN, np.int32), np.zeros(4 * KNOWN, self.type)

    def _forget(self, room: int) -> None:
        """Keep the pieces that came again, if they leave room."""
        keep = np.flatnonzero(self.uses[: self.count] > 2)
        if len(keep) + room > KNOWN:
            keep = keep[:0]
        names, size = self.names[keep], self.size[keep]
        ids = self.ids[_ranges(self.begin[keep].astype(np.int64), size.astype(np.int64))]
        self._clear()
        self._store(names, size, ids)

    def _store(self, names: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        n, m = self.count, len(names)
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.type)])
        self.names[n : n + m], self.size[n : n + m] = names, size
        self.begin[n : n + m] = self.filled + np.cumsum(size) - size
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.table.add(names, n)
        self.count, self.filled = n + m, self.filled + len(ids)

    def _bare(self, pieces: list[str], between: str) -> list[np.ndarray]:
        """Ids of pieces of one kind; between is a token that no piece of this kind holds."""
        out = []
        (stop,) = self.bare.encode(between, add_special_tokens=False).ids
        groups = [[y for x in pieces[i : i + 1000] for y in (x, between)] for i in range(0, len(pieces), 1000)]
        for e in self.bare.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False):
            ids = np.array(e.ids, self.type)
            ends = np.flatnonzero(ids == stop)
            out += [ids[a:b] for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends, strict=True)]
        return out

    def _encode(self, words: list[str], odd: np.ndarray) -> list[np.ndarray]:
        """Ids of new pieces and, where odd, words."""
        parts: list[list[str] | None] = [None if o and (FAR.search(x) or "<|" in x) else PIECE.findall(x.lower()) if o else [x.lower()] for x, o in zip(words, odd, strict=True)]
        plain = list(dict.fromkeys(p for x in parts if x for p in x))
        letters, marks = [p for p in plain if p[0].isalnum()], [p for p in plain if not p[0].isalnum()]
        ids = dict(zip(letters, self._bare(letters, "."), strict=True)) | dict(zip(marks, self._bare(marks, "a"), strict=True))
        far = [x for x, p in zip(words, parts, strict=True) if p is None]
        whole = iter(self.tool.encode_batch_fast(far, add_special_tokens=False) if far else ())
        return [np.array(next(whole).ids, self.type) if p is None else ids[p[0]] if len(p) == 1 else np.concatenate([ids[y] for y in p] or [np.zeros(0, self.type)]) for p in parts]

    @staticmethod
    def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each piece or odd word of texts that end with a blank; which are odd."""
        kind = KIND[data]
        opens = kind != BLANK
        opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        closes = kind == BLANK
        closes[1:] &= kind[:-1] != BLANK
        bad = ODD[data]
        # two bytes: U+00D7 and U+00F7 are no letters, beyond U+024F, U+0130, the opening of special tokens
        a, b = data[:-1], data[1:]
        bad[:-1] |= ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC9) & (b >= 0x90)) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0x3C) & (b == 0x7C))
        at = np.flatnonzero(bad)
        if len(at):
            first = np.flatnonzero(opens & np.concatenate([[True], kind[:-1] == BLANK]))
            last = np.flatnonzero(closes & np.concatenate([[False], kind[:-1] != BLANK]))
            which = np.unique(np.searchsorted(first, at, "right") - 1)
            mark = np.zeros(len(data) + 1, np.int8)
            mark[first[which] + 1] += 1
            mark[last[which]] -= 1
            opens &= np.cumsum(mark[:-1], dtype=np.int8) == 0
        edges = np.flatnonzero(opens | closes)
        start = np.flatnonzero(opens[edges])
        begin, end = edges[start], edges[start + 1]
        odd = np.zeros(len(begin), bool)
        if len(at):
            odd[np.searchsorted(begin, first[which])] = True
        return begin, end, odd

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end token."""
        if not self.cuts:
            return [np.array([*e.ids, END], self.type) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        if not texts:
            return []
        coded = [(x if FAR.search(x) else x.lower()).encode() for x in texts]
        data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
        stop = np.cumsum(np.fromiter((len(x) + 1 for x in coded), np.int64, len(coded)))
        begin, end, odd = self.units(data)
        with np.errstate(over="ignore"):
            names = spans(data, begin, end) ^ (end - begin).astype(U)
        at = self.table.find(names)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(names[missing], return_index=True)
            which = missing[first]
            if self.count + len(new) > KNOWN:
                self._forget(len(new))
                at = self.table.find(names)
                new, first = np.unique(names[at < 0], return_index=True)
                which = np.flatnonzero(at < 0)[first]
            if len(new) > KNOWN:  # a piece of text with more than is ever kept
                half = len(texts) // 2
                return [*self(texts[:half]), *self(texts[half:])] if half else [np.array([*self.tool.encode(texts[0], add_special_tokens=False).ids, END], self.type)]
            raw = data.tobytes()
            found = self._encode([raw[a:b].decode() for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)], odd[which])
            self._store(new, np.fromiter(map(len, found), np.int32, len(found)), np.concatenate(found))
            at = self.table.find(names)
        self.uses[: self.count] += np.bincount(at, minlength=self.count).astype(np.int32)
        size = self.size[at].astype(np.int64)
        ids = self.ids[_ranges(self.begin[at].astype(np.int64), size)] if len(at) else np.zeros(0, self.type)
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, stop)]
        ids = np.insert(ids, ends, self.type(END))
        last = ends + np.arange(1, len(ends) + 1)
        return [ids[i:j] for i, j in zip(np.concatenate([[0], last[:-1]]), last, strict=True)]


def hilbert(point: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, dimensions) of whole numbers below 2**bits."""
    x = point.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:  # undo the turns of the larger cubes
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(turned, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each document's hashed and projected token counts."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    with np.errstate(over="ignore"):
        place = mix(np.arange(int(every.max(initial=0)) + 1, dtype=U) + U(77))
    seat, sign = (place % U(WIDTH)).astype(np.int64), np.where(place >> U(63), 1.0, -1.0)
    docs = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    vector = np.bincount(docs * WIDTH + seat[every], weights=sign[every], minlength=len(ids) * WIDTH).reshape(len(ids), WIDTH)
    vector /= np.maximum(np.sqrt((vector**2).sum(1, keepdims=True)), 1e-12)
    to = np.random.default_rng(1).standard_normal((WIDTH, dimensions))
    level = (0.5 + 0.5 * np.tanh(0.8 * (vector @ to))) * (1 << bits)
    return hilbert(np.clip(level, 0, (1 << bits) - 1).astype(np.int64), bits)


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n and ids (compressed unsigned numbers of 16 bits, or 32 for a larger vocabulary) of each row."""
    ship(docs.sparkSession)

    def run(batches):
        tool = Tokens(path)  # goes with the partition
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
                    held += len(texts[end])
                    end += 1
                ids = tool(texts[at:end])
                columns = [batch["doc_id"].slice(at, end - at), pa.array(curve_keys(ids), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zstandard.compress(x.tobytes(), 1) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "ids"])
                at = end
            trim()
        del tool
        trim()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, key long"


def cut(stream, size: int, first_id: int):
    """Pieces (doc, start, ids, tokens, key, sequence, offset) of documents (doc, ids, key) in order."""
    open_, held, number = [], 0, first_id
    for doc, ids, key in stream:
        start = 0
        while start < len(ids):
            take = min(size - held, len(ids) - start)
            open_.append((doc, start, ids[start : start + take], len(ids), key, held))
            held += take
            start += take
            if held == size:
                for p in open_:
                    yield *p[:5], number, p[5]
                open_, held, number = [], 0, number + 1
    want = used = 0
    for doc, start, ids, n, key, _ in open_:  # the rest: sequences of powers of two
        at = 0
        while at < len(ids):
            if not want:
                want, used = 1 << held.bit_length() - 1, 0
            take = min(want - used, len(ids) - at)
            yield doc, start + at, ids[at : at + take], n, key, number, used
            at += take
            used += take
            held -= take
            if used == want:
                want, number = 0, number + 1


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """PIECES of the rows of ``tokenize``; a sequence's id tells its range and its place there."""
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches):
        def stream():
            for batch in batches:
                for doc, key, n, x in zip(batch["doc_id"].to_pylist(), batch["key"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
                    raw = zstandard.decompress(x.as_buffer())
                    yield doc, np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32), key

        columns: list[list] = [[] for _ in range(8)]
        for doc, start, ids, n, key, sequence, offset in cut(stream(), size, TaskContext.get().partitionId() << 32):
            for c, v in zip(columns, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, key), strict=True):
                c.append(v)
            if len(columns[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])
                columns = [[] for _ in range(8)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    rows = materialize(rows, "tokens")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_TOKENS))
    return rows.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "ids").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Tokenize and pack; path: a tokenizers file, by default the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenize(docs, str(path)), size)


def op7_curve_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_stage(spark, docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
