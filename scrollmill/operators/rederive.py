"""Retroactive redaction: values learned late are masked in rows stored before."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import digests, harvested, value_strength
from ..streaming.store import Store
from .secrets import mask_digests, mask_known, stored


def harvest_stored(rows: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """(value, strength): what today's rules find in the secret contexts of stored
    texts, values that look like no secret and ``known`` (value) left out."""
    texts = rows.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("text")).where("text is not null")
    found = texts.select(F.explode(harvested(F.col("text"))).alias("value")).distinct()
    found = found.where(~F.col("value").contains("[REDACTED:")).withColumn("strength", value_strength(F.col("value"))).where("strength <> 'none'")
    return found if known is None else found.join(known.select("value"), "value", "left_anti")


def anchors(value: str, share: float = 0.7, least: int = 8) -> list[str]:
    """Pieces of a value of which one stands in every text that holds the value or
    a long fragment of it, encoded or broken over lines in one place: the halves of
    the letter and digit runs in the stretch that all long fragments share. None
    if there is no such piece."""
    shortest = max(least, -int(-share * len(value) // 1))
    middle = value[len(value) - shortest : shortest] if shortest < len(value) else value
    runs = sorted(re.findall(r"[A-Za-z0-9]{4,}", middle), key=len, reverse=True)
    return [runs[0][: len(runs[0]) // 2], runs[0][len(runs[0]) // 2 :]] if runs else []


def may_hold(values: list[str], columns: list[str]) -> Column:
    """Whether a row may hold one of the values: a test that misses none."""
    found = [anchors(v) for v in values]
    if not all(found):
        return F.lit(True)
    pieces = "|".join(sorted({p for x in found for p in x}))
    tests = [F.coalesce(F.col(c).rlike(pieces), F.lit(False)) for c in columns] if pieces else [F.lit(False)]
    return F.greatest(*tests, F.lit(False))


def changed_rows(rows: DataFrame, key: str, columns: list[str], learned: DataFrame, block: int = 2000) -> DataFrame:
    """The rows that today's values (value, strength) change, as they should be.

    Strong values are masked wherever they stand, weak ones where a text holds a
    digest of theirs. Rows are tested for the values' anchors before a text is
    read, and compared after: what does not change is no row of the result.
    """
    strong = learned.where("strength = 'strong'").select("value")
    own = [r.value for r in strong.limit(block + 1).collect()]
    before = {c: f"old_{i}" for i, c in enumerate(columns)}
    kept = rows.select("*", *(F.col(c).alias(o) for c, o in before.items()))
    if len(own) <= block:
        near = may_hold(own, columns)
        masked = mask_known(kept.where(near), columns, strong, block).unionByName(kept.where(~near))
    else:
        masked = mask_known(kept, columns, strong, block)
    weak = learned.where("strength = 'weak'").select(F.explode(digests(F.col("value"))).alias("digest"))
    for c in columns:
        masked = mask_digests(masked, key, c, strong, weak)
    differs = F.greatest(*(~F.col(c).eqNullSafe(F.col(o)) for c, o in before.items()), F.lit(False))
    return masked.where(differs).drop(*before.values())


def retro(store: Store, columns: list[str], learned: DataFrame, stream: str, batch: int, dry_run: bool = False) -> DataFrame:
    """Mask late values in a stored table; returns the keys of the changed rows.

    Only buckets with a changed row are written again. A dry run writes nothing.
    The keys tell the caller what to derive anew: the cards and search rows of
    these rows, and no others. The changed rows are worked out once, and neither
    they nor their keys pass through the driver; no keys if the batch was done before.
    """
    if not dry_run and store.done(stream, batch):
        return store.spark.createDataFrame([], store.schema).select(*store.keys)
    change = changed_rows(store.read(), store.keys[0], columns, learned)
    if not dry_run:
        change = stored(change, "changed")
        store.merge(change, stream, batch)
    return change.select(*store.keys)
