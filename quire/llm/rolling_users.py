"""Distinct users of trailing windows, by bitsets of minutes.

The timeline of one key (here a kind) is cut into chunks of CHUNK minutes.  Inside a chunk the minutes of
one user are the bits of a big integer of 64-bit words; clicks of the window before the chunk come along, so no chunk
looks at another.  The integers of many users stand end to end in one, with room between them.  Dilating the bits by a window's length, with shifts that double, sets every minute
whose window holds a click.  For hot users three thermometer planes hold "at least 1, 2, 3 clicks"; the planes of
two adjacent windows add up to those of the joined one, and a window of any length is put together from
windows of powers of two.  Where a dilated bitset rises and falls, one is added and taken off; the sums of these edges
over the users, added up from the start of the chunk, are the distinct users of each minute.

Rows of equal click_id are one click, the least by (minute, kind, user) if they differ; a row without click_id is a click of its own.
Clicks with null ts or kind take no part, before that choice is made; those of a null user make their minute appear and count as
nobody.  Minutes before 1970 are negative.  An empty table gives an empty table.  Further columns are not read.

Nothing that grows with the input meets in one task: clicks are counted by user and minute before they are dealt by ranges
of (key, chunk, user), and the sums of a chunk are CHUNK rows at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.blobs import U
from quire.runtime import materialize, ship

CHUNK = 1 << 16  # minutes
WINDOWS = {"short": 5, "middle": 30, "long": 10080}
HOT, HOT_WINDOW = 3, 10080
ROWS = 1 << 15  # rows of users and minutes that are worked on together
WORDS = 8192  # words of the big integer that holds the islands of many users
EDGES = "key string, chunk long, minute long, present boolean, edges array<long>"


def shifted(bits: np.ndarray, n: int) -> np.ndarray:
    """The big integer (64-bit words, the lowest first) times 2 ** n, in as many words."""
    words, n = divmod(n, 64)
    out = np.zeros_like(bits)
    if words < len(bits):
        out[words:] = bits[: len(bits) - words] << U(n)
        if n:
            out[words + 1 :] |= bits[: len(bits) - words - 1] >> U(64 - n)
    return out


def dilate(bits: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length: bit m is set where one of bits m - length + 1 to m is."""
    out, span = {}, 1
    for length in sorted(lengths):
        while span * 2 <= length:
            bits = bits | shifted(bits, span)
            span *= 2
        out[length] = bits | shifted(bits, length - span) if length > span else bits
    return out


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Planes of the sums of two thermometers: plane k is set where a and b have at least k + 1 together."""
    out = []
    for k in range(len(a)):
        bits = a[k] | b[k]
        for i in range(k):
            bits |= a[i] & b[k - 1 - i]
        out.append(bits)
    return out


def window_planes(planes: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Plane k: bit m is set where the clicks of minutes m - length + 1 to m are more than k."""
    parts, span = [], 1
    while True:
        if length & span:
            parts.append((span, planes))
        if span * 2 > length:
            break
        planes = add(planes, [shifted(p, span) for p in planes])
        span *= 2
    reach, have = parts.pop()
    while parts:  # from the longest down, so that most shifts are by whole words
        span, part = parts.pop()
        have, reach = add(have, [shifted(p, reach) for p in part]), reach + span
    return have


def number(at: np.ndarray, words: int) -> np.ndarray:
    """The big integer whose set bits are the rising positions."""
    out = np.zeros(words, U)
    if len(at):
        word = at >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first)
    return out


def positions(bits: np.ndarray) -> np.ndarray:
    """The set bits, in rising order."""
    some = np.flatnonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[some].view(np.uint8), bitorder="little").reshape(-1, 64))
    return some[at] * 64 + bit


class Windows:
    """What is asked of the timelines, and the edges of rows of whole users."""

    def __init__(self, windows: list[int], hot_clicks: int, hot_window: int, size: int):
        self.windows, self.hot_clicks, self.hot_window, self.size = windows, hot_clicks, hot_window, size
        self.gap = max(*windows, hot_window)

    def edges(self, begin: np.ndarray, minute: np.ndarray, clicks: np.ndarray):
        """begin: where users begin; minutes rise within a user.  Yields window number, minutes, and +1 or -1 for each edge.

        Clicks of a user that no window holds together, as the gap between them is too long, lie apart: each *island* of clicks has
        its own words, and so much room after it that nothing of it reaches the next one.
        """
        fresh = np.concatenate([[True], np.diff(minute) >= self.gap])
        fresh[begin] = True
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(minute)) - 1
        island = np.cumsum(fresh) - 1
        words = (minute[last] - minute[first] + self.gap) // 64 + 2
        start = (np.cumsum(words) - words) * 64
        at = minute - minute[first][island] + start[island]
        so_far = np.concatenate([[0], np.cumsum(clicks)])
        crowd = so_far[1:] - so_far[np.searchsorted(at, at - self.hot_window, "right")] >= self.hot_clicks
        crowded = np.logical_or.reduceat(crowd, first)
        for kind in (False, True):
            which = np.flatnonzero(crowded == kind)
            if not len(which):
                continue
            piece = np.cumsum(words[which]) // WORDS
            for some in np.split(which, np.flatnonzero(np.diff(piece)) + 1):
                yield from self._piece(some, first, last, minute, clicks, words, kind)

    def _piece(self, some, first, last, minute, clicks, words, crowded):
        zero = (np.cumsum(words[some]) - words[some]) * 64
        n = last[some] - first[some] + 1
        rows = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = zero - minute[first[some]]
        at, many, total = minute[rows] + np.repeat(base, n), clicks[rows], int(words[some].sum())
        bits = number(at, total)
        done = {}
        if crowded:
            planes = window_planes([bits, *[number(at[many > k], total) for k in range(1, self.hot_clicks)]], self.hot_window)
            done = {self.hot_window: planes[0], "hot": planes[-1]}
        done |= dilate(bits, [w for w in self.windows if w not in done])
        for row, key in enumerate([*self.windows, *["hot"] * crowded]):
            edge = positions(done[key] ^ shifted(done[key], 1))
            mine = np.searchsorted(zero, edge, "right") - 1
            yield row, edge - base[mine], np.where(np.arange(len(edge)) & 1, -1, 1)


def _edges(ask: Windows):
    """Rows sorted by key, chunk, user and minute to the edges of each chunk.

    Users are worked on in lots of about ROWS rows; one user has as many rows as a chunk and a window have minutes, at most.
    """

    def lots(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            same = _same(t)
            cut = np.flatnonzero(~same)
            to = int(cut[-1]) if len(cut) else 0
            if to:
                yield t.slice(0, to)
            held, n = t.slice(to).to_batches(), t.num_rows - to
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def _same(t):
        """Whether a row is of the same key, chunk and user as the one before."""
        out = np.ones(t.num_rows, bool)
        out[0] = False
        for c in (t["key"].combine_chunks().dictionary_encode().indices, t["chunk"], t["user"].fill_null(0), t["user"].is_null()):
            c = c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
            out[1:] &= c[1:] == c[:-1]
        return out

    def run(batches):
        now, sums, present = None, None, None

        def flush():
            at = np.flatnonzero(present | sums.any(axis=0))
            flat = np.ascontiguousarray(sums[:, at].T).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(sums)), pa.int32()), pa.array(flat))
            columns = [pa.array([now[0]] * len(at), pa.string()), pa.array(np.full(len(at), now[1])), pa.array(at + now[1] * ask.size), pa.array(present[at]), lists]
            return pa.RecordBatch.from_arrays(columns, ["key", "chunk", "minute", "present", "edges"])

        for t in lots(batches):
            begin = ~_same(t)
            chunk, clicks = t["chunk"].to_numpy(), t["clicks"].to_numpy()
            code = t["key"].combine_chunks().dictionary_encode()
            names, key = code.dictionary.to_pylist(), code.indices.to_numpy()
            minute = t["minute"].to_numpy() - chunk * ask.size
            known = t["user"].is_valid().to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if now != (names[key[a]], int(chunk[a])):
                    if now is not None:
                        yield flush()
                    now = names[key[a]], int(chunk[a])
                    sums, present = np.zeros((len(ask.windows) + 1, ask.size), np.int64), np.zeros(ask.size, bool)
                own = minute[a:b]
                present[own[own >= 0]] = True
                some = np.flatnonzero(known[a:b]) + a
                if not len(some):
                    continue
                for row, at, sign in ask.edges(np.flatnonzero(begin[some]), minute[some], clicks[some]):
                    keep = at < ask.size
                    np.add.at(sums[row], np.maximum(at[keep], 0), sign[keep])
        if now is not None:
            yield flush()

    return run


def minute_of(rows: DataFrame, ts: str) -> Column:
    """Minutes since 1970; a timestamp without a zone is read as UTC, whatever zone the session has."""
    at = F.col(ts)
    if dict(rows.dtypes)[ts] == "timestamp_ntz":
        return (F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) * 1440 + F.hour(at) * 60 + F.minute(at)).cast("long")
    return F.floor(F.unix_micros(at) / F.lit(60_000_000)).cast("long")


def user_minutes(clicks: DataFrame, click_id: str, ts: str, user: str, key: str) -> DataFrame:
    """key, user, minute, clicks: how many different clicks a user has in a minute."""
    row = F.when(F.col(click_id).isNull(), F.monotonically_increasing_id())
    own = clicks.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(click_id).alias("click"), row.alias("row"), F.struct(minute_of(clicks, ts).alias("minute"), F.col(key).cast("string").alias("key"), F.col(user).cast("long").alias("user")).alias("at"))
    one = own.groupBy("click", "row").agg(F.min("at").alias("at")).select("at.*")
    return one.groupBy("key", "user", "minute").agg(F.count("*").alias("clicks"))


def rolling_users(clicks: DataFrame, click_id: str = "click_id", ts: str = "ts", user: str = "client_id", key: str = "kind", windows: dict[str, int] | None = None, hot_clicks: int = HOT, hot_window: int = HOT_WINDOW, chunk: int = CHUNK) -> DataFrame:
    """key, minute, users_<name> of each window (minutes), hot_users, for every key and minute that holds a click.

    windows: name to length; chunk: minutes whose sums meet in one task.
    """
    windows = WINDOWS if windows is None else windows
    if min([*windows.values(), hot_window, hot_clicks, chunk]) < 1:
        raise ValueError("windows, hot_clicks and chunk must be 1 or more")
    ship(clicks.sparkSession)
    counted = user_minutes(clicks, click_id, ts, user, key)
    back = max([*windows.values(), hot_window]) - 1
    to = lambda m: F.floor(m / F.lit(chunk)).cast("long")
    # a click goes to the chunks that its longest window reaches; one of nobody to its own
    reach = F.when(F.col("user").isNull(), F.col("minute")).otherwise(F.col("minute") + back)
    dealt = counted.withColumn("chunk", F.explode(F.sequence(to(F.col("minute")), to(reach))))
    dealt = materialize(dealt, "chunks")
    n = int(clicks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(n, "key", "chunk", F.xxhash64("user")).sortWithinPartitions("key", "chunk", "user", "minute")
    edges = dealt.select("key", "chunk", "user", "minute", "clicks").mapInArrow(_edges(Windows(list(windows.values()), hot_clicks, hot_window, chunk)), EDGES)
    names = [f"users_{w}" for w in windows] + ["hot_users"]
    sums = edges.groupBy("key", "chunk", "minute").agg(F.max("present").alias("present"), *[F.sum(F.col("edges")[i]).alias(x) for i, x in enumerate(names)])
    so_far = Window.partitionBy("key", "chunk").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.select("key", "minute", "present", *[F.sum(x).over(so_far).alias(x) for x in names])
    return run.filter("present").select(F.col("key").alias(key), "minute", *names)


def op12_rolling_users(spark, sf_dir: str) -> DataFrame:
    """Distinct and hot users of each kind and minute of clicks, over 5, 30 and 10080 minutes."""
    return rolling_users(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


# Another way: a click opens the interval of minutes whose window holds it; overlapping intervals of a user are merged, and the hot ones
# go from a third click to the end of the first one's interval.
def _merged(name: str, rows: str, length: int) -> str:
    return f"""
{name}_span AS (SELECT DISTINCT * FROM ({rows.format(length=length)})),
{name}_new AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY kind, client_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {name}_span WHERE a < z),
{name}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY kind, client_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM {name}_new),
{name}_edge AS (SELECT kind, unnest([min(a), max(z)]) AS minute, unnest([1, -1]) AS d FROM {name}_run GROUP BY kind, client_id, g),
{name}_sum AS (SELECT kind, minute, sum(sum(d)) OVER (PARTITION BY kind ORDER BY minute ROWS UNBOUNDED PRECEDING) AS users FROM {name}_edge GROUP BY kind, minute)"""


_ONE = "SELECT kind, client_id, minute AS a, minute + {length} AS z FROM click WHERE client_id IS NOT NULL"
_THREE = "SELECT kind, client_id, minute AS a, lag(minute, 2) OVER (PARTITION BY kind, client_id ORDER BY minute) + {length} AS z FROM click WHERE client_id IS NOT NULL"
OP12_SQL = rf"""
WITH once AS (SELECT click_id, min({{'m': CAST(floor(epoch_us(ts) / 60000000) AS BIGINT), 'k': kind, 'u': client_id}}) AS c FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL GROUP BY click_id),
click AS (SELECT c.k AS kind, c.m AS minute, c.u AS client_id FROM once),
pair AS (SELECT DISTINCT kind, minute FROM click),{_merged("s", _ONE, 5)},{_merged("m", _ONE, 30)},{_merged("l", _ONE, 10080)},{_merged("h", _THREE, 10080)}
SELECT p.kind, p.minute, CAST(coalesce(s.users, 0) AS BIGINT) AS users_short, CAST(coalesce(m.users, 0) AS BIGINT) AS users_middle, CAST(coalesce(l.users, 0) AS BIGINT) AS users_long, CAST(coalesce(h.users, 0) AS BIGINT) AS hot_users
FROM pair p ASOF LEFT JOIN s_sum s ON p.kind = s.kind AND p.minute >= s.minute ASOF LEFT JOIN m_sum m ON p.kind = m.kind AND p.minute >= m.minute
ASOF LEFT JOIN l_sum l ON p.kind = l.kind AND p.minute >= l.minute ASOF LEFT JOIN h_sum h ON p.kind = h.kind AND p.minute >= h.minute
"""
