"""What a session may resume: sessions that changed, that are near, that still run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tools import task_states

#: How long a session counts as recent, the slack of a late
#: collection, the tolerance of clocks, and how long a task may run, in seconds.
RECENT, SLACK, TOLERANCE, LONGEST = 7200, 1800, 60, 86400


def _shift(at: Column, seconds: int) -> Column:
    return at + F.make_dt_interval(secs=F.lit(seconds))


def pending(files: DataFrame, known: DataFrame, now: Column, collected: Column, left_out: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """The sessions whose files (path, project, sid, size, mtime) changed after
    the last collection: project, sid, mtime, ``place`` from the newest, and
    ``beyond``, how many more than ``limit`` there are.

    A file that the store knows (path, size) counts if its size differs, an unknown
    one as it is; changes before the recent window or after ``now`` don't count.
    Nothing is pending before the first collection (``collected`` null).
    """
    late = (F.col("mtime") > collected) & (F.col("mtime") >= _shift(now, -(RECENT + SLACK))) & (F.col("mtime") <= _shift(now, TOLERANCE))
    near = files.where(late)
    if left_out is not None:
        near = near.join(left_out.select("sid").distinct(), "sid", "left_anti")
    found = near.join(known.select("path", "size"), ["path", "size"], "left_anti")
    counts = found.groupBy("project").agg(F.count("*").alias("found"))
    w = W.partitionBy("project").orderBy(F.desc("mtime"), "sid")
    first = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return first.join(counts, "project").select("project", "sid", "mtime", "place", F.greatest(F.col("found") - limit, F.lit(0)).alias("beyond"))


def candidates(cards: DataFrame, sessions: DataFrame, now: Column, left_out: DataFrame | None = None, seen: int = 40, limit: int = 8) -> DataFrame:
    """Sessions to resume with: project, sid, ts and ``place`` from the newest.

    Of each project's last ``seen`` sessions by their last human input that was
    delivered (cards: project, sid, ts, human_kind, delivered) those with an input
    or any activity (sessions: project, sid, last_ts) in the recent window; the
    newest one always.
    """
    since = _shift(now, -(RECENT + SLACK))
    human = cards.where((F.col("delivered") == 1) & ~F.col("human_kind").isin("sdk", "no_human")).groupBy("project", "sid").agg(F.max("ts").alias("ts"))
    w = W.partitionBy("project").orderBy(F.desc_nulls_last("ts"), "sid")
    last = human.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= seen)
    if left_out is not None:
        last = last.join(left_out.select("sid").distinct(), "sid", "left_anti")
    active = sessions.where(F.col("last_ts") >= since).select("project", "sid").distinct().withColumn("active", F.lit(True))
    met = last.join(active, ["project", "sid"], "left").withColumn("first", F.row_number().over(W.partitionBy("project").orderBy("nr")) == 1)
    kept = met.where((F.col("ts") >= since) | F.coalesce("active", F.lit(False)) | F.col("first"))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("project").orderBy("nr"))).where(F.col("place") <= limit).select("project", "sid", "ts", "place")


def running(launches: DataFrame, notes: DataFrame, now: Column, seen: int = 20) -> DataFrame:
    """Background runs (launches: project, sid, ts, text) of the last day: project,
    sid, task, run, ts, note_ts, status; those without a note of their end run,
    those that ended are shown for the recent window.

    ``notes`` (sid, ts, text) name tasks and their states. A launch whose answer
    names no task or no run is none; of a project the last ``seen`` are looked at.
    """
    run = F.nullif(F.regexp_extract("text", r"workflows/(wf_[0-9a-f][0-9a-f-]{5,})", 1), F.lit(""))
    near = launches.where(F.col("ts") >= _shift(now, -LONGEST))
    last = near.withColumn("nr", F.row_number().over(W.partitionBy("project").orderBy(F.desc("ts"), "sid"))).where(F.col("nr") <= seen)
    named = last.withColumn("run", run).where("run is not null").withColumn("task", F.nullif(F.regexp_extract("text", r"Task ID: (\w+)", 1), F.lit(""))).where("task is not null")
    states = task_states(named.select("sid", "ts", "text"), notes)
    met = named.select("project", "sid", "task", "run", "ts").join(states, ["sid", "task", "ts"])
    return met.where(F.col("note_ts").isNull() | (F.col("note_ts") >= _shift(now, -RECENT))).select("project", "sid", "task", "run", "ts", "note_ts", "status")
