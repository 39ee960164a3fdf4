"""What lies in a folder: names, sizes and times, no file opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kind_of

_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: Fixed value: a session of the second dialect by its file's name.
ROLLOUT = rf"^codex/sessions/(?:[^/]+/)*rollout-[^/]*?({_UUID})\.jsonl$"
LINES = ["session", "subagent", "wf_agent", "journal", "history"]


def listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(path, size, mtime) of every file under a folder of any file system.

    Paths are relative to it, behind ``prefix``. Spark lists large trees in tasks,
    and as no content is asked for none is read. Hidden files are left out; an
    empty folder gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/").split("://")[-1]
    top = top[top.index("/"):] if "://" in folder and not top.startswith("/") else top
    whole = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    return files.select(F.concat(F.lit(prefix), F.substr(whole, F.lit(len(top) + 2))).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def kind(path: Column) -> Column:
    """What a path holds; of the second dialect sessions and the history alone."""
    second = F.when(path.rlike(ROLLOUT), "session").when(path == "codex/history.jsonl", "history")
    hidden = path.rlike(r"/memory/(?:[^/]+/)*\.[^/]+/")
    return F.when(path.startswith("codex/"), second).when(~hidden, kind_of(path))


def sources(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) that are read, with kind, project, sid and how: lines
    or a whole document. A second-dialect session's project is told by its head."""
    own = files.withColumn("kind", kind(F.col("path"))).where("kind is not null")
    part = lambda i: F.nullif(F.regexp_extract("path", r"^projects/([^/]+)/([^/]+)(?:/|$)", i), F.lit(""))
    sid = F.when(F.col("path").rlike(ROLLOUT), F.regexp_extract("path", ROLLOUT, 1)).when(F.col("kind").isin("memory", "history"), None).otherwise(F.regexp_replace(part(2), r"\.jsonl$", ""))
    return own.withColumns({"project": part(1), "sid": sid, "how": F.when(F.col("kind").isin(LINES), "jsonl").otherwise("doc")})


def unrecognised(files: DataFrame) -> DataFrame:
    """(place, ending, n): how many files of each folder kind nobody reads; what
    else the second dialect's folder holds is not even counted."""
    rest = files.where(~F.col("path").startswith("codex/") & kind(F.col("path")).isNull())
    place = F.when(F.col("path").rlike("^projects/[^/]+/memory/"), "memory").when(F.col("path").rlike("^projects/[^/]+/[^/]+$"), "project").when(F.col("path").rlike("^projects/[^/]+/[^/]+/"), "session").otherwise("other")
    return rest.groupBy(place.alias("place"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ending")).agg(F.count("*").alias("n"))
