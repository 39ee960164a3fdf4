"""Keyed tables on Parquet: rows lie in buckets of their key, commits name pieces.

A piece is one write's folder of buckets. A commit is a small JSON file that
lists the pieces of every bucket and the last batch of every stream, so a reader
sees whole batches only, a batch that runs again after a crash is skipped or done
once, and a merge rewrites the buckets it touches and no others.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "store_bucket"


class Store:
    """A table of ``schema`` whose ``keys`` are never null.

    Driver and executors must both see ``path``; any file system of Spark's will
    do. ``buckets`` is fixed when the table is made: size it so that one bucket of
    the finished table is a few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        # What was read back may be null, whatever the writer's plan knew.
        self.schema = T.StructType.fromDDL(schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))

    # Files ----------------------------------------------------------------

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, name: str) -> list[str]:
        path, fs = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        path, fs = self._at(name)
        fs.delete(path, True)

    def state(self) -> dict:
        """The last whole commit: its number, the batches done, the pieces."""
        for name in reversed(self._names("_commits")):
            path, fs = self._at(f"_commits/{name}")
            stream = fs.open(path)
            try:
                return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue  # a writer died while it wrote this commit
            finally:
                stream.close()
        return {"n": 0, "buckets": self.buckets, "batches": {}, "pieces": {}}

    def _commit(self, state: dict) -> None:
        taken = self._names("_commits")
        after = max([state["n"], *(int(x.split(".")[0]) for x in taken[-1:])]) + 1
        path, fs = self._at(f"_commits/{after:012d}.json")
        stream = fs.create(path, False)  # fails if another writer was first
        stream.write(bytearray(json.dumps({**state, "n": after}).encode()))
        stream.close()

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their bucket in a column, all of a bucket in one partition.
        Tables of the same keys that are placed join on bucket and keys as they lie."""
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).repartition(BUCKET)

    def _write(self, rows: DataFrame, piece: str, fields: list[T.StructField] | None = None) -> list[int]:
        """Write rows by bucket and return the buckets they lie in; placed rows are
        not shuffled."""
        own = (rows if BUCKET in rows.columns else self.placed(rows)).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields or self.schema), BUCKET)
        own.write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.path}/{piece}")
        return [int(x.split("=")[1]) for x in self._names(piece) if x.startswith(BUCKET)]

    def _of(self, places: list[str], schema: T.StructType | None = None) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema or self.schema)
        return self.spark.read.schema(schema or self.schema).parquet(*(f"{self.path}/{p}" for p in places))

    # Reading and writing ----------------------------------------------------

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the last commit, or of the given buckets alone."""
        pieces = self.state()["pieces"]
        return self._of([f"{p}/{BUCKET}={b}" for b, found in sorted(pieces.items()) if only is None or int(b) in only for p in found])

    def done(self, stream: str, batch: int) -> bool:
        return self.state()["batches"].get(stream, -1) >= batch

    def _begin(self, stream: str, batch: int) -> dict | None:
        """The state to go on from; None if the batch was done before."""
        state = self.state()
        self.buckets = state["buckets"]
        return None if state["batches"].get(stream, -1) >= batch else state

    def _end(self, state: dict, stream: str, batch: int, pieces: dict) -> bool:
        self._commit({**state, "batches": {**state["batches"], stream: batch}, "pieces": {b: p for b, p in pieces.items() if p}})
        return True

    def append(self, rows: DataFrame, stream: str, batch: int) -> bool:
        """Add the rows whose key is new; ``rows`` hold a key once. Only buckets
        with a new row are looked at, and only their keys are read. False if the
        batch was done before."""
        state = self._begin(stream, batch)
        if state is None:
            return False
        mark = uuid.uuid4().hex
        stage, piece = f"_staging/{mark}", f"piece={mark}"
        touched = self._write(rows, stage)
        new = self._of([f"{stage}/{BUCKET}={b}" for b in touched]).join(self.read(touched).select(*self.keys), self.keys, "left_anti")
        pieces = state["pieces"]
        for b in self._write(new, piece) if touched else []:
            pieces[str(b)] = [*pieces.get(str(b), []), piece]
        self._end(state, stream, batch, pieces)
        self._delete(stage)
        return True

    def merge(self, rows: DataFrame, stream: str, batch: int, gone: DataFrame | None = None, marks: DataFrame | None = None) -> bool:
        """Put ``rows`` (a key once) in place of the rows of their keys and take
        out the keys of ``gone``; a key in both is put. ``marks`` (keys, columns)
        are values that the stored rows of their keys get, a key once and not in
        ``gone``. False if the batch was done before.

        New rows are written once, as a piece of their own; what stays of the
        touched buckets is written once beside it.
        """
        state = self._begin(stream, batch)
        if state is None:
            return False
        mark = uuid.uuid4().hex
        fresh, left, stage = f"piece={mark}-new", f"piece={mark}-old", f"_staging/{mark}"
        keys = [self.schema[k] for k in self.keys]
        named = [] if marks is None else [self.schema[c] for c in marks.columns if c not in self.keys]
        fields = [*keys, *(T.StructField(f"store_{f.name}", f.dataType) for f in named), T.StructField("store_gone", T.BooleanType())]
        put = self._write(rows, fresh)
        parts = [] if marks is None else [marks.select(*self.keys, *(F.col(f"`{f.name}`").alias(f"store_{f.name}") for f in named), F.lit(False).alias("store_gone"))]
        if gone is not None:
            parts.append(gone.select(*self.keys, *(F.lit(None).cast(f.dataType).alias(f"store_{f.name}") for f in named), F.lit(True).alias("store_gone")))
        staged = []
        if parts:
            staged = self._write(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), stage, fields)
        touched, pieces, kept = sorted({*put, *staged}), state["pieces"], []
        held = [b for b in touched if pieces.get(str(b))]
        if held:
            changes = self._of([f"{fresh}/{BUCKET}={b}" for b in put if b in held]).select(*self.keys).withColumn("store_new", F.lit(True))
            if staged:
                other = self._of([f"{stage}/{BUCKET}={b}" for b in staged if b in held], T.StructType(fields))
                changes = changes.unionByName(other.withColumn("store_new", F.lit(False)), allowMissingColumns=True)
            else:
                changes = changes.withColumn("store_gone", F.lit(False))
            # A key that is put and marked, or gone, comes twice: putting and taking out go before.
            changes = self.placed(changes).groupBy(BUCKET, *self.keys).agg(F.bool_or(F.col("store_new") | F.coalesce("store_gone", F.lit(False))).alias("store_out"), *(F.max(F.struct(F.col(f"store_{f.name}"))).alias(f"store_{f.name}") for f in named))
            old = self.placed(self.read(held)).join(changes.hint("shuffle_hash"), [BUCKET, *self.keys], "left").where("store_out is null or not store_out")
            values = {f.name: F.when(F.col("store_out").isNull(), F.col(f"`{f.name}`")).otherwise(F.col(f"store_{f.name}")[f"store_{f.name}"]) for f in named}
            kept = self._write(old.select(*(values.get(n, F.col(f"`{n}`")).alias(n) for n in self.schema.names), BUCKET), left)
        for b in touched:
            pieces[str(b)] = [*([left] if b in kept else []), *([fresh] if b in put else [])]
        self._end(state, stream, batch, pieces)
        self._delete(stage)
        return True

    def compact(self, most: int = 8) -> None:
        """Rewrite the buckets of more than ``most`` pieces as one piece each."""
        state = self.state()
        many = [int(b) for b, p in state["pieces"].items() if len(p) > most]
        if many:
            piece = f"piece={uuid.uuid4().hex}"
            self.buckets = state["buckets"]
            self._write(self.read(many), piece)
            self._commit({**state, "pieces": {**state["pieces"], **{str(b): [piece] for b in many}}})

    def vacuum(self) -> None:
        """Delete pieces that no bucket of the last commit holds, staged rows and
        older commits. For a table that nobody reads or writes meanwhile."""
        live = {p for found in self.state()["pieces"].values() for p in found}
        for name in self._names(""):
            if name.startswith("piece=") and name not in live:
                self._delete(name)
        self._delete("_staging")
        for name in self._names("_commits")[:-1]:
            self._delete(f"_commits/{name}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; a local master without the setting takes a
    temporary folder, a cluster has to name one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="scrollmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
