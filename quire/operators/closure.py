"""Chains that are followed to their end: redirects, and styles based on styles.

Each row knows its next step.  Every round joins the table with itself and doubles the steps that a row has gone, so the rounds grow with the
logarithm of the longest chain, not with its length.  Cycles end as chains that are too long do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

REDIRECTS = 10  # as many as are followed
STYLES = 32  # styles over one another


def _rounds(limit: int) -> int:
    return max(1, limit.bit_length())


def followed(steps: DataFrame, source: str, target: str, limit: int = REDIRECTS) -> DataFrame:
    """source, final, hops and error of each source; final is null where more than limit steps, or a cycle, lie ahead.

    Of several steps from one source the least target counts; null targets are no steps, and null sources are left out.
    """
    one = steps.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.min(target).alias("at"))
    state = materialize(one.withColumn("hops", F.lit(1)), "steps")
    for _ in range(_rounds(limit)):
        ahead = state.select(F.col("source").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        gone = state.join(ahead, "at", "left").select("source", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        state = materialize(gone, "steps")
    on = state.join(state.select(F.col("source").alias("at"), F.lit(True).alias("goes_on")), "at", "left")
    lost = F.coalesce("goes_on", F.lit(False)) | (F.col("hops") > limit)
    return on.select("source", F.when(~lost, F.col("at")).alias("final"), F.when(~lost, F.col("hops")).alias("hops"), F.when(lost, f"more than {limit} steps").alias("error"))


def inherited(rows: DataFrame, key: str, parent: str, values: list[str], limit: int = STYLES) -> DataFrame:
    """rows with each value of the nearest of the row and those it is based on that has one; up to limit rows away.

    Keys are unique; a parent that isn't there ends the chain.
    """
    state = materialize(rows.select(F.col(key).alias("key"), F.col(parent).alias("at"), *values), "based-on")
    for _ in range(_rounds(limit)):
        ahead = state.select(F.col("key").alias("at"), F.col("at").alias("to"), *[F.col(v).alias(f"{v}_of") for v in values])
        gone = state.join(ahead, "at", "left").select("key", F.col("to").alias("at"), *[F.coalesce(v, f"{v}_of").alias(v) for v in values])
        state = materialize(gone, "based-on")
    rest = [c for c in rows.columns if c not in values]
    found = state.select(F.col("key").alias(key), *values)
    return rows.select(*rest).join(found, key, "left").select(*rows.columns)
