"""Embedding whitening: compensated covariance and its principal components.

Sums and centred outer products are kept as unevaluated pairs of doubles (high
and low part), every addition and product with its exact error term. A task adds
up its own rows, tasks' parts are merged band by band in Spark, and one matrix of
the vectors' dimension comes to the driver, where LAPACK's divide and conquer on
the tridiagonal form solves for the eigenvectors.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Entries beyond this size count as it: above, doubles are no longer exact.
LARGEST = 1 << 52
#: Bytes of products worked on at a time within a task.
BLOCK_BYTES = 1 << 22
_SPLIT = 134217729.0  # 2**27 + 1 parts a double in two halves of 26 bits


def two_sum(a, b):
    """a + b as its double and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    c = _SPLIT * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    """a * b as its double and the exact error (no overflow below 2**996)."""
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add_pairs(ah, al, bh, bl):
    """Sum of two pairs, the error of both parts kept."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def fold(high, low):
    """Sum of the pairs along the first axis, by halves."""
    while len(high) > 1:
        odd = len(high) % 2
        h, l = add_pairs(high[odd::2], low[odd::2], high[odd + 1 :: 2], low[odd + 1 :: 2])  # noqa: E741
        high, low = (np.concatenate([high[:1], h]), np.concatenate([low[:1], l])) if odd else (h, l)
    return high[0], low[0]


def pair(value: Fraction) -> tuple[float, float]:
    """The pair of doubles nearest to an exact fraction."""
    high = float(value)
    return high, float(value - Fraction(high))


def _lists(flat: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width), pa.int32()), pa.array(flat.ravel()))


def _matrix(values: pa.Array, d: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(df: DataFrame, each, bands: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of ``each(batch)``, pairs of arrays (k, bands, width).

    A task yields one row a band; bands are dealt out and merged in a stream, so a
    merging task holds its bands' sums and nothing that grows with the tasks.
    """
    names = ["band", "high", "low"]

    def rows_of(at, high, low):
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), _lists(np.asarray(high), width), _lists(np.asarray(low), width)], names)

    def local(batches):
        high, low = np.zeros((bands, width)), np.zeros((bands, width))
        for batch in batches:
            for h, l in each(batch):  # noqa: E741
                high, low = add_pairs(high, low, *fold(h, l))
        yield rows_of(np.arange(bands), high, low)

    def merge(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, h, l in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), width), _matrix(batch.column(2), width), strict=True):  # noqa: E741
                sums[i] = add_pairs(*sums[i], h, l) if i in sums else (h, l)
        if sums:
            yield rows_of(list(sums), np.stack([x[0] for x in sums.values()]), np.stack([x[1] for x in sums.values()]))

    schema = "band int, high array<double>, low array<double>"
    merged = df.mapInArrow(local, schema).repartition("band").mapInArrow(merge, schema)
    found = merged.toArrow().combine_chunks()
    order = np.argsort(found.column("band").to_numpy())
    high, low = (_matrix(found.column(c).combine_chunks(), width)[order] for c in names[1:])
    return high, low


def sums(df: DataFrame, column: str, d: int) -> list[Fraction]:
    """Sum of each dimension of a column of arrays, as pairs of doubles hold it."""
    k = max(1, BLOCK_BYTES // (8 * d))

    def each(batch):
        x = _matrix(batch.column(column), d).astype(float)
        for i in range(0, len(x), k):
            yield x[i : i + k, None, :], np.zeros((len(x[i : i + k]), 1, d))

    high, low = _total(df.select(column), each, 1, d)
    return [Fraction(h) + Fraction(l) for h, l in zip(high[0].tolist(), low[0].tolist(), strict=True)]  # noqa: E741


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x less a mean of two parts, as pairs."""
    return add_pairs(x, np.zeros_like(x), -mean[0], -mean[1])


def covariance(df: DataFrame, column: str, d: int, n: int, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean outer product of the centred rows, divisor n, rounded once.

    Only the upper triangle is worked out: one band for each row of it.
    """
    k = max(1, BLOCK_BYTES // (8 * d * d))

    def each(batch):
        high, low = centred(_matrix(batch.column(column), d).astype(float), mean)
        for i in range(0, len(high), k):
            a, al = high[i : i + k], low[i : i + k]
            p, e = two_product(a[:, :, None], a[:, None, :])
            yield two_sum(p, e + (a[:, :, None] * al[:, None, :] + al[:, :, None] * a[:, None, :]))

    high, low = _total(df.select(column), each, d, d)
    return (high + low) / n


def cleaned(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the scaled integers of each vector that counts.

    Vectors that are null or hold null or non-finite entries are left out, and so
    are vectors shorter than the longest: their missing entries count as null.
    """
    value = lambda c: c.cast("double")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf")))
    whole = lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), value(c) * SCALE))
    found = embeddings.where(F.col("embedding").isNotNull() & ~bad)
    return found.select("vec_id", F.transform("embedding", lambda c: F.floor(whole(c)).cast("long") + F.lit(SHIFT)).alias("x"))


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 for each row, exactly; null where that
    is beyond a long."""
    rough = np.abs(n * x.astype(float) - np.array(totals, float))
    if not x.size or rough.max() < (1 << 62) and (rough**2).sum(1).max() < 1 << 62 and np.abs(n * x.astype(float)).max() < 1 << 62 and max(map(abs, totals)) < 1 << 62:
        return ((n * x - np.array(totals, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, totals, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame) -> DataFrame:
    """One row for each vector that counts and each of its first eight components
    (fewer if it has fewer dimensions): vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows that share a vec_id or a vector are rows of their own, a null vec_id
    stays null. A component without variance (constant vectors, one row) has no
    scale: its whitened is null, and identity_error is over the others (null if
    there are none); explained is null if nothing varies. Equal eigenvalues have
    components in an arbitrary but fixed order. A deviation beyond a long is null.
    The vectors' dimension is what memory depends on: d * d doubles a block. Other
    columns are ignored; an empty table gives an empty result.
    """
    x = materialize(cleaned(embeddings), "whitening-x")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("d")).first()
    d, n = sizes or (0, 0)
    x = x.where(F.size("x") == d)
    if not d:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    totals = [int(s) for s in sums(x, "x", d)]
    means = np.array([pair(Fraction(s, n)) for s in totals]).T
    mean = means[0], means[1]
    cov = covariance(x, "x", d, n, mean)
    values, vectors = np.linalg.eigh(cov)  # LAPACK syevd: tridiagonal, divide and conquer
    order = np.argsort(-values, kind="stable")[:COMPONENTS]
    values, vectors = values[order], vectors[:, order]
    trace, k = float(np.trace(cov)), len(order)
    varies = values > max(0.0, float(values[0])) * d * np.finfo(float).eps
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)

    def project(batches):
        for batch in batches:
            own = _matrix(batch.column("x"), d)
            high, low = centred(own.astype(float), mean)
            w = ((high @ vectors) + (low @ vectors)) * scale
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(own, n, totals), pa.int64()), _lists(w, k)], ["vec_id", "deviation", "w"])

    kind = x.schema["vec_id"].dataType.simpleString()
    made = materialize(x.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"), "whitened")
    error = None
    if varies.any():
        centre = np.array([pair(s / n) for s in sums(made, "w", k)]).T
        gap = covariance(made, "w", k, n, (centre[0], centre[1])) - np.eye(k)
        error = float(np.abs(gap[np.ix_(varies, varies)]).max())
    told = [(float(v / trace) if trace > 0 else None, bool(ok)) for v, ok in zip(values, varies, strict=True)]
    shares, kept = (F.array(*(F.lit(t[i]) for t in told)) for i in (0, 1))
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("i", "w"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.get(kept, F.col("i")), F.col("w")).alias("whitened"),
        F.get(shares, F.col("i")).cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
