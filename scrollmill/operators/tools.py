"""Tool calls and their results as tables of the stored lines, and their joins.

``lines`` has key, sid, fid, off, ts, side and the arrays tool_uses and
tool_results. A tool id belongs to the first line that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.content import HARNESS
from ..functions.display import command_head
from ..functions.shell import nothing_found
from .ordered import first_by

_LINE = ["key", "sid", "fid", "off", "ts"]


def uses(lines: DataFrame) -> DataFrame:
    """One row a tool call: its line and tuid, idx, name, fpath, cmd, summary."""
    each = lines.select(*_LINE, F.explode("tool_uses").alias("u")).select(F.col("key").alias("ekey"), *_LINE[1:], "u.tuid", "u.idx", "u.name", "u.fpath", "u.cmd", "u.summary")
    return first_by(each, ["tuid"], ["fid", "off", "idx"])


def results(lines: DataFrame) -> DataFrame:
    """One row a result: its line and tuid, is_err, err_line, err_sig, denial, intr, link, text."""
    r = ["tuid", "is_err", "err_line", "err_sig", "denial", "intr", "link", "text"]
    each = lines.select(*_LINE, F.explode("tool_results").alias("r")).select(F.col("key").alias("ekey"), *_LINE[1:], *(f"r.{c}" for c in r))
    return first_by(each, ["tuid"], ["fid", "off"])


def with_calls(found: DataFrame, calls: DataFrame, how: str = "left") -> DataFrame:
    """Results with their call's name, file, command and summary."""
    return found.join(calls.select("tuid", "name", "fpath", "cmd", "summary", F.col("ts").alias("call_ts")), "tuid", how)


def unresolved(paired: DataFrame, now: Column | None = None, most_s: int = 24 * 3600) -> DataFrame:
    """The last error of each session that no later success on the same target
    resolves: the tool with its file, or a command's first three words. Commands
    that just found nothing are no errors; the harness' refusals are left out."""
    command = F.element_at(F.col("summary")["fields"], F.lit("command"))
    failed = (F.col("is_err") == 1) & ~((F.col("name") == "Bash") & nothing_found(F.col("text"), command))
    rows = paired.withColumn("target", F.struct(F.col("name"), F.when(F.col("name") == "Bash", command_head(F.col("cmd"))).otherwise(F.coalesce("fpath", F.lit(""))).alias("on"))).withColumn("failed", failed)
    after = W.partitionBy("sid", "target").orderBy("fid", "off").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("later", F.max(F.when(~F.col("failed"), 1)).over(after))
    refused = F.coalesce(F.col("err_line"), F.lit("")).rlike(HARNESS) | F.substring("text", 1, 2000).rlike(HARNESS)
    open_ = rows.where(F.col("failed") & F.col("later").isNull() & ~refused)
    if now is not None:
        open_ = open_.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= most_s * 1_000_000)
    last = open_.withColumn("__n", F.row_number().over(W.partitionBy("sid").orderBy(F.desc("fid"), F.desc("off")))).where("__n = 1")
    return last.select("sid", "ts", "name", "cmd", "fpath", "err_line", "err_sig")


def agent_tokens(found: DataFrame, meta: DataFrame, per_file: DataFrame) -> DataFrame:
    """(tuid, agent, tokens): what the agent of a call used, in that agent's file.

    The agent is what the agent's own note says of the call, else the result's
    link; of several calls that name one agent the first claims it.
    """
    named = found.join(meta.select("tuid", F.col("agent").alias("noted")), "tuid", "left").select("tuid", "fid", "off", F.coalesce("noted", "link").alias("agent"))
    claimed = first_by(named.where("agent is not null"), ["agent"], ["fid", "off"])
    return claimed.join(per_file.select("agent", "tokens"), "agent").select("tuid", "agent", "tokens")


def task_states(calls: DataFrame, notes: DataFrame) -> DataFrame:
    """Background tasks (sid, ts, text of their launch) with their last note's time
    and status; null while none names the task: they run."""
    task = calls.withColumn("task", F.nullif(F.regexp_extract("text", r"Task ID: (\w+)", 1), F.lit(""))).where("task is not null")
    told = notes.select("sid", F.col("ts").alias("note_ts"), F.regexp_extract("text", r"<task-id>(\w+)</task-id>", 1).alias("task"), F.nullif(F.regexp_extract("text", r"<status>(\w+)</status>", 1), F.lit("")).alias("status"))
    met = task.join(told, ["sid", "task"], "left").where("note_ts is null or note_ts >= ts")
    last = met.groupBy("sid", "task", "ts").agg(F.max(F.struct("note_ts", "status")).alias("m")).select("sid", "task", "ts", "m.note_ts", "m.status")
    before = task.select("sid", "task", "ts").join(last, ["sid", "task", "ts"], "left_anti")  # all its notes are older
    return last.unionByName(before, allowMissingColumns=True)
