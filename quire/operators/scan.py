"""Running sums over ordered groups of any size.

A window over a whole group runs in one task, however large the group is.  Here rows are dealt by ranges of
(group, order), so one group lies in many *blocks*; a block adds up its own rows, and what a group has in earlier blocks is added
to that.  Only a group that goes over the border of a block has anything there: at most two such sums for each
block, whatever the number of rows, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize

BLOCK = "block_of_scan"


def dealt(rows: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """The rows in a table of blocks: ranges of by and order, with the values as columns of whole numbers."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumns({k: F.coalesce(v.cast("long"), F.lit(0)) for k, v in values.items()}).repartitionByRange(n, *by, *order)
    # written down, as a range that is cut again could be cut elsewhere
    return materialize(spread.withColumn(BLOCK, F.spark_partition_id()), "scan")


def running(rows: DataFrame, by: list[str], order: list[str], exclusive: bool = False, **values: Column) -> DataFrame:
    """rows and, for each value, its sum over the rows of the group up to this one, or before it where exclusive.

    Nulls in by are a group and count as 0 in values.  Rows that tie in order lie in one block and follow each other in no given order.
    """
    spread = dealt(rows, by, order, **values)
    own = Window.partitionBy(BLOCK, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    totals = spread.groupBy(BLOCK, *by).agg(*[F.sum(k).alias(k) for k in values])
    group = F.struct(*by)
    edges = totals.groupBy(BLOCK).agg(F.min(group).alias("low"), F.max(group).alias("high"))
    # the first and the last group of a block may go on in others
    border = totals.join(F.broadcast(edges), BLOCK).filter(group.eqNullSafe(F.col("low")) | group.eqNullSafe(F.col("high"))).drop("low", "high")
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = border.select(F.col(BLOCK).alias("at"), group.alias("group"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"carried_{k}") for k in values])
    out = spread.withColumns({k: F.coalesce(F.sum(k).over(own), F.lit(0)) for k in values})
    out = out.join(F.broadcast(carried), (out[BLOCK] == carried["at"]) & group.eqNullSafe(carried["group"]), "left")
    names = [c for c in rows.columns if c not in values]
    return out.select(*names, *[(F.col(k) + F.coalesce(F.col(f"carried_{k}"), F.lit(0))).alias(k) for k in values])


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """1, 2, ... through each group."""
    return running(rows, by, order, **{name: F.lit(1)})
