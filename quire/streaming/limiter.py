"""A sliding-window limiter: only accepted requests count against later ones.

So a count over a time range is wrong; each client's log is folded in order.  The state is the
accepted times inside the window, at most ``limit`` of them, whatever the client's log holds.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quire.runtime import ship

LIMIT, WINDOW_SECONDS = 20, 900
_NOBODY = object()


def fold(times: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Accepted or not for times in order, and the accepted times that still count after the last."""
    log, out = deque(kept), []
    for t in times:
        while log and t - log[0] >= window:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out, list(log)


def limited(events: DataFrame, client: str, ts: str, event: str, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """client, event and accepted.  A client's sorted log streams through one task in batches; only the state is held.

    Requests without a client (null) are one client's; those without a time come first and are judged like the rest.
    """
    ship(events.sparkSession)
    rows = events.select(F.col(client).alias("client"), F.col(event).alias("event"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    parts = rows.repartition("client").sortWithinPartitions("client", "t", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = _NOBODY, []
        for batch in batches:
            names, times, accepted = batch["client"].to_pylist(), batch["t"].to_pylist(), []
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                good, log = fold([-math.inf if t is None else t for t in times[at:end]], log if names[at] == last and last is not _NOBODY else [], limit, window)
                accepted += good
                last, at = names[at], end
            yield pa.RecordBatch.from_arrays([batch["client"], batch["event"], pa.array(accepted, pa.bool_())], ["client", "event", "accepted"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = parts.mapInArrow(run, f"client {kinds['client']}, event {kinds['event']}, accepted boolean")
    return out.select(F.col("client").alias(client), F.col("event").alias(event), "accepted")


def limited_stream(events: DataFrame, client: str, ts: str, event: str, limit: int = LIMIT, window: float = WINDOW_SECONDS, late: str = "0 seconds") -> DataFrame:
    """The same over a stream: a client's state is its accepted times inside the window.

    Rows of a client are judged in time order within each micro-batch; those later than the watermark (``late``
    behind the latest time seen) are not judged.  A state goes when the watermark has passed its last time and the
    window: none of its requests can count any more.  Requests without a client are one client's; its name in the
    state is the empty string, which no other client's is.
    """
    ship(events.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(client).cast("string")), F.lit(""))
    rows = events.select(name.alias("client"), F.col(event).cast("long").alias("event"), F.col(ts).cast("timestamp").alias("ts"))
    # the first watermark is the epoch, and what is no later than it is late: so a second on
    rows = rows.withColumn("time", F.col("ts") + F.expr("INTERVAL 1 SECOND")).withWatermark("time", late)
    rows = rows.select("client", "event", "time", (F.unix_micros("ts") / 1e6).alias("t"))

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        own = pd.concat(list(frames)).sort_values(["t", "event"], na_position="first")
        good, log = fold(own["t"].fillna(-math.inf).tolist(), log, limit, window)
        state.update((log,))
        last = max((t for t in log if t > -math.inf), default=0.0)
        state.setTimeoutTimestamp(max(int((last + window + 1) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "event": own["event"].to_numpy(), "accepted": good})

    out = rows.groupBy("client").applyInPandasWithState(run, "client string, event long, accepted boolean", "log array<double>", "append", "EventTimeTimeout")
    return out.select(F.when(F.col("client") != "", F.expr("substring(client, 2)")).alias("client"), "event", "accepted")


class _Held(StatefulProcessor):
    """A client's requests that the watermark has not passed yet, its accepted times, and a timer for each time at which it has to act."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "micros long, event long")
        self.kept = handle.getListState("kept", "micros long")

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs()
        for own in rows:
            late = own["micros"].isna() | (-(-own["micros"] // 1000) <= passed)
            if late.any():
                gone = own[late]
                yield pd.DataFrame({"client": key[0], "event": gone["event"].to_numpy(), "accepted": pd.Series([None] * len(gone), dtype="object"), "late": True})
            wait = own[~late]
            if len(wait):
                micros = wait["micros"].astype("int64").tolist()
                self.held.appendList(list(zip(micros, [None if pd.isna(e) else int(e) for e in wait["event"]], strict=True)))
                for ms in sorted({-(-x // 1000) for x in micros}):
                    self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        held, due = [], []
        for row in self.held.get():
            (due if -(-row[0] // 1000) <= passed else held).append((row[0], row[1]))
        kept = [row[0] for row in self.kept.get()]
        if due:
            due.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            good, log = fold([t / 1e6 for t, _ in due], [t / 1e6 for t in kept], self.limit, self.window)
            kept = [round(t * 1e6) for t in log]
            self._put(self.held, held)
            self._put(self.kept, [(t,) for t in kept])
            if kept:
                self.handle.registerTimer(math.ceil(kept[-1] / 1000 + self.window * 1000))
            yield pd.DataFrame({"client": key[0], "event": [e for _, e in due], "accepted": good, "late": False})
        elif not held and (not kept or kept[-1] / 1000 + self.window * 1000 <= passed):
            self.held.clear()
            self.kept.clear()

    @staticmethod
    def _put(state, rows) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def answered_stream(events: DataFrame, client: str, ts: str, event: str, limit: int = LIMIT, window: float = WINDOW_SECONDS, late: str = "0 seconds") -> DataFrame:
    """client, event, accepted and late: one row for every request, whenever it comes.

    A request waits until the watermark (``late`` behind the latest time seen) has passed its time, and a client's requests
    are then judged in order of time and event, as ``limited`` judges them, in whatever order and micro-batches they
    came.  One that comes behind the watermark, or has no time, is answered at once: late, with a null ``accepted``, and it counts for
    nothing.  Select ``late`` rows as a second output.  What lies after the last watermark of a stream that stopped waits for
    the next start.  A client's state is its waiting requests and its accepted times inside the window; a timer
    clears it when none of them can count any more.  Requests without a client are one client's.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise ValueError("answered_stream needs spark.sql.streaming.stateStore.providerClass to be the RocksDB provider")
    ship(spark)
    name = F.coalesce(F.concat(F.lit("="), F.col(client).cast("string")), F.lit(""))
    rows = events.select(name.alias("client"), F.col(event).cast("long").alias("event"), F.col(ts).cast("timestamp").alias("time"))
    # the watermark's own column goes on no further, as rows behind it would be dropped by it
    rows = rows.withWatermark("time", late).select("client", "event", F.unix_micros("time").alias("micros"))
    out = rows.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Held(limit, window), outputStructType="client string, event long, accepted boolean, late boolean", outputMode="Append", timeMode="EventTime"
    )
    return out.select(F.when(F.col("client") != "", F.expr("substring(client, 2)")).alias("client"), "event", "accepted", "late")
