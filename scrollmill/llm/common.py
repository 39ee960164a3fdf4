"""Shared storage, table access and the labelled-sample rule of the operators."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: ASCII letters only: a contract that says "lower-case A-Z" leaves É alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is made and put there, but only for a local master: machines
    of a cluster would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scrollmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Written(threading.local):
    """Folders written by this thread and not yet released, in order: a query that
    runs beside it in another thread keeps its own."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    return path


def written() -> int:
    """How many folders are in use; ``release`` takes it as its start."""
    return len(_written.paths)


def release(spark: SparkSession, start: int, keep: int = 1) -> None:
    """Delete the folders written since ``start`` but the last ``keep``.

    For a caller that has stored a result and needs nothing that led to it.
    """
    jvm = spark.sparkContext._jvm
    stop = len(_written.paths) - keep
    for path in _written.paths[start:stop]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _written.paths[start:stop] = []


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, so later stages survive lost executors without
    recomputing what stands before, and both reads see the same rows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int = 1 << 25, max_text: int = 1 << 18) -> DataFrame:
    """(doc_id, text, label): at most ``max_rows`` labelled training rows of at
    most ``max_bytes`` of text together, none of more than ``max_text`` bytes.

    Longer texts are left out of the sample, so no text can push the others out:
    at least max_bytes / max_text rows fit. They are scored whole like any other.

    Held-out rows (crc32 of the id mod 5 is 0) never enter. The sample holds the
    ids of smallest hash, so it is the same on every run; an id that repeats
    counts once, with its text of smallest hash and its largest label. Null
    labels and ids are left out. As ``max_rows`` bounds the chosen ids, joining
    the documents to them by broadcast is safe at any input size, and repeats of
    an id meet as one row of each task.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(label).cast("double").alias("label"))
        .where(remainder(F.col("__id"), 5) != 0)
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    own = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_text)
    met = own.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.max("label").alias("label"))
    rows = materialize(met.select(F.col("__id").alias("doc_id"), F.col("t.text").alias("text"), "label", F.octet_length("t.text").alias("bytes")), "sample")
    # One row an id of the bounded sample: the window sees ids and sizes only.
    upto = rows.select(F.col("doc_id").alias("__id"), F.sum("bytes").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"))
    inside = upto.where(F.col("upto") <= max_bytes).select("__id")
    return rows.join(F.broadcast(inside), F.col("doc_id") == F.col("__id"), "left_semi").select("doc_id", "text", "label")
