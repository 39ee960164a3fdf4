"""SimHash near-duplicates, found by pigeonring filtering of the fingerprints.

With at most four of 64 bits different and the bits in a ring of five segments,
some segment starts a chain whose first l segments differ in at most 4 l / 5
bits together, for every l. The first segment is then equal and the second
differs in one bit at most: those 26 bits make the join key (the probing side
lists its few variants), and the longer chains prune what the key lets through
before the full Hamming check at l = 5. Equal fingerprints are one class, so a
thousand copies take part as one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .textarrays import pieces

SHINGLE, SEED, SEGMENTS, BITS, RADIUS = 4, 42, 5, 13, 4


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every run of four words (or of all words, if fewer)."""
    found = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - SHINGLE + 1)
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((h(joined[i:j], SEED) for i, j in pairs), np.uint64, n)


def bit_majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    edges = np.concatenate([[0], np.cumsum(counts[some])])
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # Eight byte-wide counters to a word: exact over at most 255 rows a block.
    starts = np.concatenate([np.arange(a, b, 255) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    blocks = np.add.reduceat(bits.view(np.uint64), starts, 0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(blocks, np.searchsorted(starts, edges[:-1]), 0)
    major = (2 * total > counts[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, fp): the 64-bit SimHash of each whole text as a signed long;
    ``more`` names columns of type long."""

    def run(batches):
        for piece in pieces(batches):
            each = [shingle_hashes(t or "") for t in piece.column("text").to_pylist()]
            fp = bit_majority(np.concatenate(each), np.array([len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(fp.view(np.int64))], [*names, "fp"])

    names = ["doc_id", *more]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def fingerprint_links(classes: DataFrame, chain: int | None = None) -> DataFrame:
    """(u, v) for all pairs of distinct ``fp`` with at most four different bits.

    ``chain`` segments make the join key: two of them (26 bits) by default, three
    (39 bits, where both sides list variants of one bit) from 2**26 fingerprints
    on, when chance matches of the short key would outnumber its rows.
    """
    chain = chain or (2 if classes.count() < 1 << 26 else 3)
    segment = lambda i: f"(shiftrightunsigned(fp, {BITS} * ({i})) & {(1 << BITS) - 1})"  # noqa: E731  the last has 12 bits left
    ring = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i"))
    key = " | ".join([f"shiftleft(cast(i as long), {chain * BITS})", *(f"shiftleft({segment(f'(i + {k}) % {SEGMENTS}')}, {(chain - 1 - k) * BITS})" for k in range(chain))])
    flips = F.expr(f"explode(concat(array(0L), transform(sequence(0, {(chain - 1) * BITS - 1}), j -> shiftleft(1L, j))))")
    varied = lambda name: ring.select("fp", "i", flips.alias("flip")).select(F.col("fp").alias(name), "i", F.expr(f"({key}) ^ flip").alias("key"))
    index = varied("u") if chain > 2 else ring.select(F.col("fp").alias("u"), "i", F.expr(key).alias("key"))
    probe = varied("v").drop("i")
    turned = f"(shiftrightunsigned(u ^ v, {BITS} * i) | shiftleft(u ^ v, 64 - {BITS} * i))"  # the chain's segments first

    def within(length):
        width = f"{BITS} * {length} - if(i + {length} > {SEGMENTS - 1}, 1, 0)"
        return f"bit_count({turned} & (shiftleft(1L, {width}) - 1)) <= {RADIUS * length // SEGMENTS}"

    met = F.expr(f"u < v and {within(3)} and {within(4)} and bit_count(u ^ v) <= {RADIUS}")
    # The planner doesn't see that explode() multiplies rows: never broadcast here.
    return index.join(probe.hint("merge"), "key").where(met).select("u", "v").distinct()


def roots(classes: DataFrame) -> DataFrame:
    """``classes`` (fp, ...) with the root of each fingerprint's component."""
    found = components(fingerprint_links(classes)).select(F.col("node").alias("fp"), "root")
    return materialize(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. A null text counts as
    empty; texts without words have fingerprint 0 and link like any other. Rows
    without a doc_id link but never name a component (null if nothing else
    does). Repeated rows share a component; a very long text is hashed by its
    task alone; other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    linked = roots(materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes"))
    least = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialize(linked.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of smallest doc_id, among
    rows that share it the one whose text has the smallest hash.

    A row without an id stays only if no row of its component has one; repeated
    rows stay once; rows of one id with unlike texts are judged by themselves. All
    columns stay; null texts count as empty; an empty table gives itself.
    """
    # The row rides along as one struct, so no name in it can clash; two columns
    # without nulls name it: they join, and later tell repeats.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    named = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"), "doc_id", "text")
    best = F.struct((F.col("doc_id").isNull()).alias("none"), "id", "key")
    rows = materialize(fingerprints(named, "id", "key"), "fingerprints")
    linked = roots(materialize(rows.groupBy("fp").agg(F.min(best).alias("best")), "classes"))
    kept = materialize(linked.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.key"), "kept")
    return named.select("row", "id", "key").join(kept, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("row.*")
