"""Words of many texts as flat numpy arrays.  A word is a run of bytes other than blank and 9 to 13."""

from __future__ import annotations

import numpy as np

from quire.llm.blobs import U, byte_table, mix, powers

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SEED, BASE, BLOCK = 11, 0xD6E8FEB86659FD93, 1 << 15


class Words:
    """data: all texts, each followed by a blank; start, end: bytes of each word; doc: its text; count: by text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        word = ~BLANK[self.data]
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.text_end = np.cumsum(size)
        self.doc = np.searchsorted(self.text_end, self.start, "right")
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.begin = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        """A 64-bit name of each word, the same in every task."""
        return spans(self.data, self.start, self.end)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED, base: int = BASE) -> np.ndarray:
    """A 64-bit name of the bytes of each span; starts and ends must not fall."""
    out, table, back = np.empty(len(start), U), byte_table(seed), pow(base, -1, 1 << 64)
    at = 0
    while at < len(out):
        zero = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, zero + BLOCK)))  # small arrays stay in the processor's cache
        a, b = start[at:to] - zero, end[at:to] - zero
        n = int(b[-1])
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum(table[data[zero : zero + n]] * powers(base, n)[:n], out=total[1:])
        out[at:to] = (total[b] - total[a]) * powers(back, n)[a]
        at = to
    return mix(out)


def windows(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each ``size`` consecutive numbers of h; len(h) - size + 1 of them."""
    if len(h) < size:
        return np.zeros(0, U)
    out, have, level = None, 0, {1: h}
    span = 1
    while span * 2 <= size:
        h = h[: len(h) - span] * U(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
        level[span] = h
    out, have = level[span], span
    while have < size:
        add = 1 << ((size - have).bit_length() - 1)
        out = out[: len(out) - add] * U(pow(base, add, 1 << 64)) + level[add][have : have + len(out) - add]
        have += add
    return mix(out)
