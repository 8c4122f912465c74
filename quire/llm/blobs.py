"""Columnar exchange: keys travel as packed numpy arrays, one row for each (bucket, shard).

A *bucket* is a group of documents (by a hash of doc_id and text), sized from the measured bytes of
text.  A *shard* owns a range of 64-bit key space.  A bucket sends each distinct key once, so
a key that a third of all documents hold costs one entry per bucket, not one per document;
the shard answers with one bit per entry, in the order in which they were sent.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
libc = ctypes.CDLL(None)
GOLD = 0x9E3779B97F4A7C15
BUCKET_BYTES = 1_600_000  # text in one bucket; numpy needs some 100 bytes for each
SHARD_BYTES = 16_000_000  # text for which there is one shard
LEAST = 64  # buckets and shards
KEPT_POWERS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection whose bits are all well spread."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.cache
def byte_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(GOLD) + U(seed))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64; the most that was asked for is kept, up to KEPT_POWERS."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, dtype=U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[: n + 1]


def deal(docs: DataFrame, text: str) -> tuple[int, int]:
    """How many buckets and shards: one partially aggregated pass over the text column."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(LEAST, -(-total // BUCKET_BYTES)), max(LEAST, -(-total // SHARD_BYTES))


def trim() -> None:
    """Hand freed memory back: a worker lives through many groups and executors are small.

    Arrow takes its memory from the system's allocator from the first call on; its own pools keep what was freed.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.default_memory_pool().release_unused()
        pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def bucketed(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """bucket, doc_id, text (null: empty).  Every stage reads this one exchange again; rows of one doc_id may lie apart."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).cast("int").alias("bucket"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition(max(LEAST, n // 4), "bucket")


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def bits(a: np.ndarray) -> bytes:
    return pack(np.packbits(a))


def unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(b, np.uint8), count=n).astype(bool)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the key space each key lies in."""
    return np.minimum(keys // U(((1 << 64) - 1) // n), U(n - 1)).astype(np.int64)


def shard_cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the key space, of n equal ones, that sorted keys lie in, and where each begins; then the end.

    Time and memory are those of the keys, whatever n is.
    """
    at = shard_of(keys, n)
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    return at[cut], np.append(cut, len(keys))
