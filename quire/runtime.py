"""What operators need from the session: the shared folder and the package on executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once per application.

    Rows here hold whole texts, so Arrow batches of Spark's default 10,000 rows take tens of megabytes in the JVM and
    again in Python, for each core.  Where the session leaves that default, batches have BATCH_ROWS rows from now on.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == "10000" and not sc.getConf().contains(BATCH_KEY):
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all is one machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        done = sc._jsc.sc().getCheckpointDir()
        if done.isDefined():
            at = done.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
            sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # this codec frees its buffers with the file; others keep direct memory until the heap is collected
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Delete the tables that this application wrote in the shared folder; results that were not saved yet go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
