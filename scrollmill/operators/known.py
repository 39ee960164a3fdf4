"""Values learned from secret contexts, and their masking wherever they occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import digests, harvested, value_strength
from .secrets import mask_known


def learn(rows: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """(value, strength): distinct values in the secret contexts of ``rows`` that
    look like secrets and that ``known`` (value) lacks."""
    found = rows.select(F.explode(harvested(F.col(text))).alias("value")).distinct().withColumn("strength", value_strength(F.col("value"))).where("strength <> 'none'")
    return found if known is None else found.join(known.select("value"), "value", "left_anti")


def weak_digests(learned: DataFrame) -> DataFrame:
    """(digest): what is stored of values too weak to be kept in plain."""
    return learned.where("strength = 'weak'").select(F.explode(digests(F.col("value"))).alias("digest")).distinct()


def mask(rows: DataFrame, text: str, learned: DataFrame) -> DataFrame:
    """``rows`` with every strong learned value replaced wherever it stands, under
    any encoding, and its long fragments with it."""
    return mask_known(rows, [text], learned.where("strength = 'strong'").select("value"))
