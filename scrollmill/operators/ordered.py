"""Ordered and stateful operators as windows: cards, carried state, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def segment(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Adds ``card``: how many starting rows stand at or before each row; 0 is
    what comes before the first."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("card", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def carry(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first by ``order`` (first writer wins)."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def islands(rows: DataFrame, key: str, order: list[str], inside: Column) -> DataFrame:
    """Adds ``island``: runs of equal ``inside`` share a number."""
    w = W.partitionBy(key).orderBy(*order)
    flagged = rows.withColumn("inside", inside)
    changed = flagged.withColumn("__c", F.when(F.col("inside") == F.lag("inside").over(w), 0).otherwise(1))
    return changed.withColumn("island", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long")).drop("__c")


def unresolved(rows: DataFrame, keys: list[str], order: list[str], error: Column, success: Column) -> DataFrame:
    """Error rows after which no success with the same keys follows."""
    later = W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return rows.withColumn("__s", F.max(F.when(success, 1)).over(later)).where(error & F.col("__s").isNull()).drop("__s")


def unpaired(rows: DataFrame, keys: list[str], ts: str, order: str, seconds: int = 120) -> DataFrame:
    """Rows without a later row of the same keys and none within ``seconds`` before.

    A theta self-join by meaning; the nearest neighbours decide, so one window
    does it and common keys cost no pairs.
    """
    w = W.partitionBy(*keys).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return rows.withColumn("__gap", gap).withColumn("__next", F.lead(order).over(w)).where(F.col("__next").isNull() & (F.col("__gap").isNull() | (F.col("__gap") > seconds * 1_000_000))).drop("__gap", "__next")


def multiset_new(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose n-th occurrence of ``keys`` exceeds the stored count."""
    have = stored.groupBy(*keys).agg(F.count("*").alias("__have"))
    nth = rows.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return nth.join(have, keys, "left").where(F.col("__nth") > F.coalesce("__have", F.lit(0))).drop("__nth", "__have")
