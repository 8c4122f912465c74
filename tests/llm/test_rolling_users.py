"""Distinct users of trailing windows against brute force."""

import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import rolling_users as R

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, minute string, users_short string, chunk string, key string"
EPOCH = datetime.datetime(1970, 1, 1)


def brute(rows, windows, hot_clicks, hot_window):
    """rows: click_id, minute, kind, user."""
    once, alone = {}, []
    for click, minute, kind, user in rows:
        if minute is None or kind is None:
            continue
        at = (minute, kind, user is not None, user or 0)
        if click is None:
            alone.append(at)
        else:
            once[click] = min(once.get(click, at), at)
    by = defaultdict(list)
    for minute, kind, known, user in [*once.values(), *alone]:
        by[kind].append((minute, user if known else None))
    out = set()
    for kind, clicks in by.items():
        for m in {m for m, _ in clicks}:
            row = [len({u for x, u in clicks if m - n < x <= m and u is not None}) for n in windows]
            hot = Counter(u for x, u in clicks if m - hot_window < x <= m and u is not None)
            out.add((kind, m, *row, sum(n >= hot_clicks for n in hot.values())))
    return out


def sample(n, span, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        user = 7 if r.random() < 0.33 else r.choice([None, *range(40)])
        rows.append((r.choice([i, i, i, max(0, i - 3), None]), r.choice([None, *[r.randrange(-span // 4, span)] * 20]), r.choice([None, "view", "view", "view", "click", ""]), user))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(c, None if m is None else EPOCH + datetime.timedelta(minutes=m, seconds=17.5), u, k, "m", "s", "c", "k") for c, m, k, u in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("span", "chunk"), [(200, 64), (3000, 16), (4000, 1 << 15)])
def test_brute_force(spark, span, chunk):
    rows = sample(700, span, span)
    windows = {"a": 1, "b": 5, "c": 37}
    got = R.rolling_users(table(spark, rows), windows=windows, hot_clicks=3, hot_window=100, chunk=chunk).collect()
    assert {tuple(r) for r in got} == brute(rows, windows.values(), 3, 100) and len(got) == len(set(map(tuple, got)))


@pytest.mark.parametrize("length", [1, 2, 3, 5, 30, 31, 64, 100, 10080])
def test_planes(length):
    r = random.Random(length)
    at = sorted(r.randrange(20000) for _ in range(300))
    many = Counter(at)
    planes = [R.number(np.array(sorted(m for m, n in many.items() if n > k), int), 480) for k in range(4)]
    one, top = (set(R.positions(x).tolist()) for x in (R.dilate(planes[0], [length])[length], R.window_planes(planes, length)[3]))
    for m in [*range(0, 20000, 97), *at]:
        n = sum(m - length < x <= m for x in at)
        assert (m in one, m in top) == (n >= 1, n >= 4)
    both = R.dilate(planes[0], [length + 7, 1, length])
    assert all((both[n] == R.dilate(planes[0], [n])[n]).all() for n in both)


def test_shift():
    bits = np.array([3, 1 << 63, 0, 5], np.uint64)
    whole = sum(int(w) << 64 * i for i, w in enumerate(bits))
    for n in (0, 1, 63, 64, 65, 128, 200, 255, 256, 300):
        assert sum(int(w) << 64 * i for i, w in enumerate(R.shifted(bits, n))) == (whole << n) % 2**256


def test_nobody_and_empty(spark):
    rows = [(1, 5, "view", None), (2, 5, "view", 3), (2, 5, "view", 3), (3, None, "view", 4), (4, 6, None, 4), (5, 4000, "view", None)]
    got = {tuple(r) for r in R.rolling_users(table(spark, rows)).collect()}
    assert got == {("view", 5, 1, 1, 1, 0), ("view", 4000, 0, 0, 1, 0)}
    assert R.rolling_users(table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="1 or more"):
        R.rolling_users(table(spark, rows), windows={"none": 0})


def test_the_session_zone_changes_nothing(spark):
    rows = sample(60, 3000, 5)
    want = {tuple(r) for r in R.rolling_users(table(spark, rows)).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert {tuple(r) for r in R.rolling_users(table(spark, rows)).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
