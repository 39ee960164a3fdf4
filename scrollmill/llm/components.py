"""Connected components of a link table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): equal roots, one component.

    Each round every node hooks onto its neighbour of smallest pseudorandom
    priority (if below its own) and links are redrawn between hooks, which
    shrinks any graph, long chains included, by a constant factor on average.
    Minima are aggregated before the shuffle, and both sides of each join are
    tables just written, so adaptive execution can split a hub's rows. Nothing
    but one emptiness test a round reaches the driver.
    """
    links = materialize(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    labels, turn = None, 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(rank(F.col("v")).alias("r"), F.col("v"))).alias("m"))
        hooks = materialize(least.select(F.col("u").alias("node"), F.when(F.col("m.r") < rank(F.col("u")), F.col("m.v")).otherwise(F.col("u")).alias("hook")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("hook").alias("root"))
        else:
            labels = materialize(
                labels.join(hooks.select(F.col("node").alias("root"), "hook"), "root", "left").select("node", F.coalesce("hook", "root").alias("root")), "labels"
            )
        at_u, at_v = (hooks.select(F.col("node").alias(c), F.col("hook").alias(f"{c}2")) for c in "uv")
        drawn = links.join(at_u, "u").join(at_v, "v").where("u2 <> v2")
        links = materialize(drawn.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), "links")
    if labels is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
