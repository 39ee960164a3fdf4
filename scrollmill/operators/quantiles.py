"""Exact quantiles of groups that one task could not hold.

Equal values count once with their number. A group's values are cut into slices at
about equal ranks; the slices' sizes tell in which one a rank lies, and only those
slices are ordered.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], slices: int = 256) -> DataFrame:
    """One row a group: ``keys`` and each wanted quantile of ``value`` under its name.

    Between two ranks the value is interpolated linearly. Null values don't count
    and a group of nulls only has null quantiles; null keys are a group. The cuts
    are read by the driver: at most ``slices`` doubles a group, so groups are few
    (kinds of metrics, features), their rows are not. Cuts only spread the work:
    rough ones make slices uneven, the result stays exact.
    """
    spark = rows.sparkSession
    counted = rows.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(value).alias("__n"))
    shares = [i / slices for i in range(1, slices)]
    found = counted.groupBy(*keys).agg(F.percentile_approx("__v", shares, slices * 40).alias("__cuts"))
    cuts = spark.createDataFrame(found.collect(), found.schema)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    slice_ = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col("__v")))
    # The cuts hold a bounded number of doubles a group.
    cut = counted.alias("a").join(F.broadcast(cuts.alias("b")), same("a", "b")).select(*(F.col(f"a.{k}").alias(k) for k in keys), "__v", "__n", slice_.alias("__s"))
    sizes = cut.groupBy(*keys, "__s").agg(F.sum("__n").alias("__size"))
    upto = sizes.withColumn("__before", F.sum("__size").over(W.partitionBy(*keys).orderBy("__s").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__size"))
    upto = upto.withColumn("__all", F.sum("__size").over(W.partitionBy(*keys)))
    ranks = lambda q: (F.lit(q) * (F.col("__all") - 1))
    holds = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__size"))
    of = [r for q in wanted.values() for r in (F.floor(ranks(q)), F.ceil(ranks(q)))]
    need = upto.where(reduce(or_, [holds(r) for r in of]))
    # At most two slices a wanted quantile and group are looked at.
    inside = cut.alias("a").join(F.broadcast(need.alias("b")), [*same("a", "b"), F.col("a.__s") == F.col("b.__s")]).select("a.*", "b.__before", "b.__all")
    last = F.col("__before") + F.sum("__n").over(W.partitionBy(*keys, "__s").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = inside.withColumn("__to", last).withColumn("__from", F.col("__to") - F.col("__n"))

    def at(r):
        return F.max(F.when((F.col("__from") <= r) & (r < F.col("__to")), F.col("__v")))

    def between(q: float):
        low, high, part = at(F.floor(ranks(q))), at(F.ceil(ranks(q))), F.max(ranks(q) - F.floor(ranks(q)))
        return F.when(part == 0, low).otherwise(low * (1 - part) + high * part)

    made = placed.groupBy(*keys).agg(*(between(q).alias(name) for name, q in wanted.items()))
    groups = cuts.select(*keys)
    return groups.alias("a").join(made.alias("b"), same("a", "b"), "left").select(*(F.col(f"a.{k}").alias(k) for k in keys), *wanted)
