"""Every request of a stream has an answer, and those in time have the batch query's."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from quire.streaming import limiter

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "event long, client string, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, before)


def stream(spark, batches, folder, name, late, parts=1):
    """Answers of a stream that gets one file of rows per micro-batch, started anew ``parts`` times from its checkpoint."""
    (folder / "in").mkdir(parents=True)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    answers, step = [], -(-len(batches) // parts)
    for at in range(0, len(batches), step):
        for i, rows in enumerate(batches[at : at + step]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"made{at + i}"))
            file = next((folder / f"made{at + i}").glob("*.parquet"))
            file.rename(folder / "in" / f"{at + i:03}.parquet")

        def keep(frame, _):
            answers.extend(tuple(r) for r in frame.collect())

        out = limiter.answered_stream(source, "client", "ts", "event", 2, 10, late)
        query = out.writeStream.foreachBatch(keep).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    return answers


def test_every_request_is_answered(rocks, tmp_path):
    rng, day = random.Random(5), datetime(2024, 3, 1)
    rows = [(i, rng.choice(["a", "a", "b", "", None]), day + timedelta(seconds=i // 3, microseconds=rng.choice([0, 1, 500]))) for i in range(120)]
    mixed = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.uniform(0, 8)), r[0]))  # out of order by less than the lateness
    tick = [(1000, "end", day + timedelta(days=1))]
    behind = [(2000, "a", day), (2001, None, day), (2002, "b", None)]
    later = [(1001, "end", day + timedelta(days=2))]
    batches = [mixed[:30], mixed[30:60], mixed[60:90], mixed[90:], tick, behind, later]
    got = stream(rocks, batches, tmp_path, "answers", "10 seconds", parts=2)
    late = {r[1]: r for r in got if r[3]}
    assert set(late) == {2000, 2001, 2002} and all(r[2] is None for r in late.values()) and late[2001][0] is None
    want = {(r.client, r.event, r.accepted) for r in limiter.limited(rocks.createDataFrame([*rows, *tick], SCHEMA), "client", "ts", "event", 2, 10).collect()}
    judged = [r[:3] for r in got if not r[3]]
    assert set(judged) == want and len(judged) == len(rows) + 1
    assert {r[2] for r in judged} == {True, False}


def test_the_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        limiter.answered_stream(spark.createDataFrame([], SCHEMA), "client", "ts", "event")
