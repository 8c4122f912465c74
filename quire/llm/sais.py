"""Suffix order by induced sorting, a whole bucket of suffixes in each numpy step.

Classic induced sorting visits suffixes one by one.  Here each pass goes once over the byte
alphabet; within a bucket, suffixes that are induced by suffixes of the same bucket (runs of
one byte) take a further round.  Every suffix is moved a fixed number of times, so a shard
takes time linear in its bytes.

The reduced problem, the string of names of leftmost-smaller (LMS) substrings, is solved
recursively: a round names pairs of adjacent names, so that its reduced string spans twice
as many substrings, and ends when all names differ or when they span ``depth`` bytes.  The
order is therefore exact up to ``depth`` bytes; suffixes that agree that far stand together.
"""

from __future__ import annotations

import numpy as np


FILL = np.array([(1 << (64 - 8 * k)) - 1 for k in range(9)], np.uint64)


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last is L."""
    n = len(t)
    if n < 2:
        return np.zeros(n, bool)
    ends = np.flatnonzero(t[:-1] != t[1:])  # last place of each run but the last run
    s = np.zeros(n, bool)
    if len(ends):
        lengths = np.diff(np.concatenate([[-1], ends]))
        s[: ends[-1] + 1] = np.repeat(t[ends] < t[ends + 1], lengths)
    return s


def words8(t: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there as one big-endian number, zeros past the end."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    return np.ndarray((len(t),), ">u8", padded.data, strides=(1,))


def _refine(rank: np.ndarray, second: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order tied entries by (rank, second); rank stays the number of smaller entries.  Also: which are tied still."""
    r, s = rank[tied], second
    if r[0] == r[-1] and (r == r[0]).all():
        order = np.argsort(s)
    else:  # one sort of whole numbers instead of two stable ones
        kinds, s_rank = np.unique(s, return_inverse=True)
        order = np.argsort(r * len(kinds) + s_rank)
    r, s, who = r[order], s[order], tied[order]
    n = len(who)
    new = np.ones(n, bool)
    new[1:] = r[1:] != r[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    fresh = new.copy()
    fresh[1:] |= s[1:] != s[:-1]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[who] = r + (place - head)
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return rank, who[~alone]


def sort_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The LMS suffixes in order, exact up to depth bytes."""
    m = len(lms)
    if m < 2:
        return lms
    w = words8(t)
    length = np.diff(np.append(lms, len(t) - 1)) + 1  # to the next LMS place, that included
    rank, tied, at = np.zeros(m, np.int64), np.arange(m), 0
    live = tied
    while len(live):  # names: the substrings themselves, eight bytes a round
        left = np.clip(length[live] - at, 0, 8)
        key = w[np.minimum(lms[live] + at, len(t) - 1)].astype(np.uint64)
        # past its end a substring counts as larger: one that goes on has a byte at most as large as that end
        key |= FILL[np.where(live == m - 1, 8, left)]
        rank, tied = _refine(rank, key, live)
        at += 8
        if at >= depth:
            break
        live = tied[length[tied] > at]
        if len(live) and len(live) < len(tied):  # a group goes on as a whole
            more = np.zeros(m, bool)
            more[rank[live]] = True
            live = tied[more[rank[tied]]]
    step = 1
    counts = np.bincount(rank, minlength=m)
    tied = np.flatnonzero(counts[rank] > 1)
    while len(tied) and 2 * step <= depth:  # each name spans two bytes at least
        nxt = tied + step
        second = np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0)
        rank, tied = _refine(rank.copy(), second, tied)
        step *= 2
    return lms[np.argsort(rank, kind="stable")]


def _append(sa, heads, t, p, sign: int) -> None:
    """Put suffixes p, in this order, at the heads (sign 1) or tails (sign -1) of their buckets."""
    c = t[p]
    order = np.argsort(c, kind="stable")
    c, p = c[order], p[order]
    count = np.bincount(c, minlength=256)
    first = np.cumsum(count) - count
    seat = np.arange(len(p)) - first[c]
    if sign > 0:
        sa[heads[c] + seat] = p
        heads += count
    else:
        sa[heads[c] - 1 - seat] = p
        heads -= count


def _rest_of_runs(sa, heads, t, p, run, s, c: int, sign: int) -> tuple[np.ndarray, int]:
    """Place what is left of the runs of c to which p leads.  What they and p lead to outside, and where c's bucket is then read."""
    inside = p[t[p] == c]
    size = inside - run[inside] + 1
    back = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    _append(sa, heads, t, np.repeat(inside, size) - back, sign)
    out = run[inside] - 1
    out = out[out >= 0]
    out = out[s[out] if sign < 0 else ~s[out]]
    return np.concatenate([p[t[p] != c], out]), heads[c]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All places of the byte string t in the order of their suffixes, exact up to depth bytes."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    lms = sort_lms(t, lms, depth)
    size = np.bincount(t, minlength=256)
    start = np.cumsum(size) - size
    end = start + size
    sa = np.empty(n, np.int64)
    heads = start.copy()
    edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    # runs of one byte that are longer than depth: their inner suffixes agree as far as it counts and are placed at once
    run = np.repeat(edge, np.diff(np.append(edge, n))) if np.diff(np.append(edge, n)).max() > depth else None
    by = np.concatenate([[0], np.cumsum(np.bincount(t[lms], minlength=256))]) if len(lms) else np.zeros(257, np.int64)
    _append(sa, heads, t, np.array([n - 1]), 1)
    used = np.flatnonzero(size)
    for c in used:  # larger than their successor: left to right
        lo, steps = start[c], 0
        while lo < heads[c]:
            hi = heads[c]
            p = sa[lo:hi] - 1
            p = p[p >= 0]
            p = p[~s[p]]
            if len(p):
                if run is not None and steps > depth:
                    p, hi = _rest_of_runs(sa, heads, t, p, run, s, c, 1)
                if len(p):
                    _append(sa, heads, t, p, 1)
            lo = hi
            steps += 1
        seeds = lms[by[c] : by[c + 1]]
        if len(seeds):
            _append(sa, heads, t, seeds - 1, 1)
    tails = end.copy()
    for c in used[::-1]:  # smaller than their successor: right to left
        hi, steps = end[c], 0
        while hi > tails[c]:
            lo = tails[c]
            p = sa[lo:hi][::-1] - 1
            p = p[p >= 0]
            p = p[s[p]]
            if len(p):
                if run is not None and steps > depth:
                    p, lo = _rest_of_runs(sa, tails, t, p, run, s, c, -1)
                if len(p):
                    _append(sa, tails, t, p, -1)
            hi = lo
            steps += 1
        p = sa[start[c] : heads[c]][::-1] - 1
        p = p[p >= 0]
        p = p[s[p]]
        if len(p):
            _append(sa, tails, t, p, -1)
    return sa


def permuted_common(t: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """In text order: does the suffix share depth bytes with the one before it in sa?  False where sa lacks it."""
    out = np.zeros(len(t), bool)
    phi = np.full(len(t), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    live = np.flatnonzero(phi >= 0)
    w = words8(t)
    for at in [*range(0, depth - 7, 8), depth - 8]:
        live = live[w[live + at] == w[phi[live] + at]]
    out[live] = True
    return out
