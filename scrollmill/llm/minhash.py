"""MinHash fingerprints over five-word shingles, and near-duplicates by bands.

Every batch of texts becomes one numpy array of shingle hashes; each of the
universal permutations x -> a x + b (mod 2**32, a odd) is one vector operation
over it and one segmented minimum. A fingerprint keeps the top 16 bits of each
of its minima, four hex digits apiece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textarrays import LOWERED, SPACE, column, mix, pieces, range_hashes, words

PERMUTATIONS, SHINGLE = 128, 5


def permutations(n: int = PERMUTATIONS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's shingles in a row, and how many each has.

    A text of fewer words has one shingle, the whole sequence; none: none.
    """
    starts, ends, first = words(data, at, ~SPACE[data])
    h = range_hashes(LOWERED[data], starts, ends)
    n = np.diff(first)
    counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    begin = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    stop = np.repeat(first[1:], counts)
    padded, total = np.concatenate([h, np.zeros(size, np.uint64)]), np.zeros(len(begin), np.uint64)
    for j in range(size):
        total = total * np.uint64(0x100000001B3) + np.where(begin + j < stop, padded[begin + j], np.uint64(0))
    return (mix(total) >> np.uint64(32)).astype(np.uint32), counts


def signatures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) minima's top 16 bits; all ones for a text without words."""
    x, counts = shingles(data, at)
    out = np.full((PERMUTATIONS, len(counts)), 0xFFFF, np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        edges = np.cumsum(counts[some]) - counts[some]
        for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
            out[k, some] = np.minimum.reduceat(x * a + b, edges) >> np.uint32(16)
    return out.T.copy()


def to_hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def of_texts(texts: list[str]) -> np.ndarray:
    """Signatures of a list of texts, worked off in pieces."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    return np.concatenate([np.zeros((0, PERMUTATIONS), np.uint16), *(signatures(*column(p.column("text"))) for p in pieces([batch]))])


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Of no id, and of what stands behind all others of its part.
NO_ID, BEHIND = -(1 << 63), (1 << 63) - 1


def part_starts(rows: DataFrame, parts: int, each: int = 20) -> list[tuple[int, int]]:
    """Sorted (o, key) of real rows at which about ``parts`` ranges of equal size
    begin; the first is the least of all. About ``each`` sampled pairs of numbers
    a range reach the driver; the sample moves borders, never rows."""
    n = rows.count()
    if not n:
        return []
    drawn = sorted({(r.o, r.key) for r in rows.sample(min(1.0, each * parts / n), seed=5).collect()})
    least = rows.agg(F.min(F.struct("o", "key")).alias("m")).first().m
    return sorted({(least.o, least.key), *drawn[each // 2 :: each]})


def part_of(starts: list[tuple[int, int]], o: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The index of the last start that is not behind each (o, key)."""
    ids, keys = (np.array(x, np.int64) for x in zip(*starts, strict=True))
    low, high = np.searchsorted(ids, o, "left"), np.searchsorted(ids, o, "right")
    out = high - 1
    among = np.flatnonzero(high > low)  # the id of a start itself: keys decide
    for i in np.unique(low[among]):
        own = among[low[among] == i]
        out[own] = i - 1 + np.searchsorted(keys[i : high[own[0]]], key[own], "right")
    return out


def _rows(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[list]:
    quarter = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - q] + n[:q] for t, q, n in zip(texts, quarter, following, strict=True)]
    changed = of_texts(edited)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        to_hex(own), to_hex(changed), (own == changed).mean(1).tolist(), (own == after).mean(1).tolist(),
    ]


def fingerprints_with_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, its edited
    text's, and their likeness to each other and to the next document's.

    The edited text ends with the start of the next document's, by ascending
    doc_id (nulls first; repeats of an id by the hash of their text); the last
    is followed by the first, a lone row by itself. Null texts are empty; very
    long ones take memory for themselves alone; an empty table gives an empty
    result; other columns are ignored.

    Rows are dealt into ranges of (doc_id, hash of the text), so that an id that
    many rows share is split, and every range gets the text that begins the next
    one as a last row: one shuffle of the texts, nothing stored in between, and
    tasks stream through their ranges row by row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("o"), F.xxhash64("text").alias("key"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = part_starts(docs.select("o", "key"), 4 * n)
    if not starts:
        return spark.createDataFrame([], _ROW)

    @F.pandas_udf("int")
    def part(o: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(part_of(starts, o.to_numpy(), key.to_numpy()))

    begin = spark.createDataFrame([(o, k, (i - 1) % len(starts)) for i, (o, k) in enumerate(starts)], "b_o long, b_key long, part int")
    heads = docs.join(F.broadcast(begin), (F.col("o") == F.col("b_o")) & (F.col("key") == F.col("b_key"))).groupBy("part").agg(F.min("text").alias("text"))
    ends = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(BEHIND).alias("o"), F.lit(BEHIND).alias("key"), "part", F.lit(True).alias("end"))
    whole = docs.withColumn("part", part("o", "key")).withColumn("end", F.lit(False)).unionByName(ends)
    ranges = whole.repartition(n, "part").sortWithinPartitions("part", "end", "o", "key", "text", "doc_id").select("doc_id", "text", "end")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([c.split()[0] for c in _ROW.split(", ")], kinds, strict=True)))

    def run(batches):
        held = ([], [], [], np.zeros((0, PERMUTATIONS), np.uint16))  # the row whose next is yet to come
        for piece in pieces(batches):
            ids, texts, end = (h + piece.column(c).to_pylist() for h, c in zip(held, ("doc_id", "text", "end"), strict=False))
            own = np.concatenate([held[3], signatures(*column(piece.column("text")))])
            held = ids[-1:], texts[-1:], end[-1:], own[-1:]
            at = [i for i in range(len(ids) - 1) if not end[i]]
            if at:
                pick = lambda x, d=0: [x[i + d] for i in at]  # noqa: B023, E731
                out = _rows(pick(ids), pick(texts), pick(texts, 1), own[at], own[np.array(at) + 1])
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, out, strict=True)), schema)

    return ranges.mapInArrow(run, _ROW)


def _classes(docs: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id and class key of every row, and for each key its
    shingle set, bands (a long each) and smallest doc_id. The key is a digest of the
    set: texts of one class have equal sets, whatever their ids are.

    Rows are stored without their sets, and sets are shuffled for one row of each
    class and task: copies cost nothing but their own pass.
    """
    each = PERMUTATIONS // bands
    key = lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()

    def sets(data, at):
        x, counts = shingles(data, at)
        return [np.unique(s) for s in np.split(x, np.cumsum(counts)[:-1])]

    def name(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([key(s) for s in sets(*column(piece.column("text")))], pa.string())], ["doc_id", "key"])

    def describe(batches):
        seen: set[str] = set()
        for piece in pieces(batches):
            data, at = column(piece.column("text"))
            found, sig = sets(data, at), signatures(data, at)
            keys = [key(s) for s in found]
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if len(seen) > 1 << 20:  # bounds the memory; a class told twice is merged below
                seen.clear()
            own = [[hash_of(r.tobytes()) for r in sig[i].reshape(bands, each)] for i in new]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in new], pa.string()), pa.array([found[i].astype(np.int64) for i in new], pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["key", "grams", "bands"])

    hash_of = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(texts.mapInArrow(name, "doc_id long, key string"), "minhash-rows")
    told = texts.select("text").mapInArrow(describe, "key string, grams array<long>, bands array<long>").groupBy("key").agg(F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    ids = rows.groupBy("key").agg(F.min("doc_id").alias("id"))
    return rows, materialize(told.join(ids, "key"), "minhash-classes")


def _pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): keys of classes whose sets are that alike, a < b."""
    keys = classes.where(F.size("grams") > 0).select("key", F.posexplode("bands").alias("band", "value"))
    met = keys.alias("x").join(keys.alias("y").hint("merge"), ["band", "value"]).where("x.key < y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    grams = lambda c: classes.select(F.col("key").alias(c), F.col("grams").alias(f"grams_{c}"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    likeness = both / (F.size("grams_a") + F.size("grams_b") - both)
    return met.join(grams("a"), "a").join(grams("b"), "b").select("a", "b", likeness.alias("jaccard")).where(F.col("jaccard") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """(a, b, jaccard): all found pairs of different texts at or over ``threshold``,
    named by the smallest doc_ids of their texts, a <= b.

    Texts of equal shingle sets are one class first, so copies and repeated rows
    never multiply. Signature bands (four values each) are joined in Spark, and each
    candidate's Jaccard likeness is verified exactly on its shingle hashes. At 0.8,
    bands miss a pair with a probability under 1e-7. Two unlike texts of one doc_id
    are a pair of that id with itself; a text of rows without an id has the name
    null, which stands first. Null and empty texts, and texts without words, have no
    pair; other columns are ignored; an empty table gives an empty result. A text's
    shingle set is held by its task as a whole.
    """
    _, classes = _classes(docs, bands)
    ids = lambda c: classes.select(F.col("key").alias(c), F.col("id").alias(f"id_{c}"))
    named = _pairs(classes, threshold).join(ids("a"), "a").join(ids("b"), "b")
    first = F.when(F.col("id_a").isNotNull() & F.col("id_b").isNotNull(), F.least("id_a", "id_b"))
    return named.select(first.alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")


def memberships(docs: DataFrame, threshold: float = 0.8, bands: int = 32) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text).

    class_id names the class of equal shingle sets by its smallest doc_id (null if
    no row of it has one), and n_links counts the classes that are near to it, those
    of rows without an id and those that share its doc_id among them. Repeated rows
    are rows of one class. Null and empty texts and texts without words are one
    class, without links; other columns are ignored; an empty table gives an empty
    result.
    """
    rows, classes = _classes(docs, bands)
    pairs = materialize(_pairs(classes, threshold), "minhash-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    names = classes.select("key", F.col("id").alias("class_id")).join(ends, "key", "left").select("key", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(names, "key").select("doc_id", "class_id", "n_links")
