"""Files written by tasks appear together or not at all."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.sources.folder import FolderSink, FolderWriter, inner_name, sweep


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def rows(spark, n=40):
    return spark.range(n).repartition(4).select(F.format_string("book %s/part.txt", "id").alias("name"), F.concat(F.lit("text "), "id").cast("binary").alias("content"), F.lit("more").alias("extra"))


def save(df, folder, mode="append"):
    df.sparkSession.dataSource.register(FolderSink)
    df.write.format("quire_files").mode(mode).save(str(folder))


def test_all_files(spark, tmp_path):
    save(rows(spark), tmp_path / "out")
    assert files(tmp_path / "out") == {f"book {i}/part.txt": f"text {i}".encode() for i in range(40)} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="exists"):
        save(rows(spark, 3), f"file://{tmp_path}/out")
    assert len(files(tmp_path / "out")) == 40
    save(rows(spark, 3), f"file://{tmp_path}/out", "overwrite")
    assert len(files(tmp_path / "out")) == 3 and os.listdir(tmp_path) == ["out"]
    save(rows(spark, 3).withColumn("content", F.lit(None).cast("binary")), tmp_path / "nothing")
    assert set(files(tmp_path / "nothing").values()) == {b""}


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    def die(batches):
        for i, batch in enumerate(batches):
            yield batch
        if 33 in [int(x.as_py().split()[1].split("/")[0]) for x in batch["name"]]:
            os._exit(1)

    with pytest.raises(Exception, match="(?i)job aborted|worker"):
        save(rows(spark).mapInArrow(die, "name string, content binary, extra string"), tmp_path / "out")
    time.sleep(1)  # tasks that still run
    left = os.listdir(tmp_path)
    assert "out" not in left and sweep(str(tmp_path / "out")) == len(left) and os.listdir(tmp_path) == []
    save(rows(spark, 5), tmp_path / "kept")
    with pytest.raises(Exception, match="(?i)job aborted|worker"):
        save(rows(spark).mapInArrow(die, "name string, content binary, extra string"), tmp_path / "kept", "overwrite")
    time.sleep(1)
    sweep(str(tmp_path / "kept"))
    assert len(files(tmp_path / "kept")) == 5 and os.listdir(tmp_path) == ["kept"]


def test_nothing_is_seen_before_the_end(spark, tmp_path):
    seen, end = [], threading.Event()

    def watch():
        while not end.is_set():
            seen.append(len(files(tmp_path / "out")))
            time.sleep(0.01)

    t = threading.Thread(target=watch)
    t.start()
    save(rows(spark, 300), tmp_path / "out")
    time.sleep(0.05)
    end.set()
    t.join()
    assert set(seen) <= {0, 300} and seen[-1] == 300


def test_attempts_that_do_not_count(tmp_path):
    writer = FolderWriter(str(tmp_path / "out"), ["name", "content"], False)
    first, again = (writer.write(iter([{"name": "a/b", "content": x}])) for x in (b"lost", b"counts"))
    writer.commit([again, None])
    assert files(tmp_path / "out") == {"a/b": b"counts"} and first.folder != again.folder


def test_names(spark, tmp_path):
    for bad in ("", None, "/x", "../x", "a/../b", "a//b", "."):
        with pytest.raises(ValueError, match="not a name"):
            inner_name(bad)
    twice = spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="twice"):
        save(twice, tmp_path / "out")
    with pytest.raises(Exception, match="content"):
        save(spark.createDataFrame([("a",)], "name string"), tmp_path / "out")
    assert not (tmp_path / "out").exists()
