"""A project by any of its names: the first kind of name that tells one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import project_from_cwd


def resolve(asked: DataFrame, projects: DataFrame, sessions: DataFrame, cards: DataFrame, short_name) -> DataFrame:
    """``asked`` (name) with ``project`` and ``level``; both null if nothing fits.

    In order: a project's own name (exact); the working folder of a session, then
    of a card (project, cwd, ts), the latest one's; the name made of a folder; the
    short name of one project alone, as two projects of one short name are no
    answer. A slash at a folder's end does not count; an empty or null name
    names nothing. ``short_name`` is a function of a project column.
    """
    known = projects.select("project").where("project is not null").distinct()
    names = asked.select("name").where("name <> ''").distinct().withColumn("folder", F.regexp_replace("name", "/+$", ""))
    latest = lambda df: df.where("cwd is not null and project is not null").groupBy(F.col("cwd").alias("folder")).agg(F.max_by("project", F.struct(F.coalesce("ts", F.lit(0).cast("timestamp")), "project")).alias("p"))
    short = known.groupBy(short_name(F.col("project")).alias("name")).agg(F.count("*").alias("n"), F.min("project").alias("p")).where("n = 1")
    levels = [
        ("exact", known.select(F.col("project").alias("name"), F.col("project").alias("p")), "name"), ("session_folder", latest(sessions), "folder"), ("card_folder", latest(cards), "folder"),
        ("made_of_folder", known.select(F.col("project").alias("made"), F.col("project").alias("p")), "made"), ("short_name", short.select("name", "p"), "name"),
    ]
    found: Column | None = None
    names = names.withColumn("made", project_from_cwd(F.col("folder")))
    for level, table, key in levels:
        names = names.join(table.withColumnRenamed("p", f"p_{level}"), key, "left")
        own = F.when(F.col(f"p_{level}").isNotNull(), F.struct(F.col(f"p_{level}").alias("project"), F.lit(level).alias("level")))
        found = own if found is None else F.coalesce(found, own)
    told = names.select(F.col("name").alias("asked_name"), found.alias("f"))
    return asked.join(told, F.col("name") == F.col("asked_name"), "left").select(*asked.columns, "f.project", "f.level")


def history_projects(prompts: DataFrame, sessions: DataFrame, folders: DataFrame) -> DataFrame:
    """``prompts`` (sid, folder, ...) with ``project``: that of the session's file
    (sid, project), else of the folder (cwd, project), else made of the folder."""
    by_sid = sessions.where("sid is not null").groupBy(F.col("sid").alias("own_sid")).agg(F.min("project").alias("p_sid"))
    by_folder = folders.where("cwd is not null").groupBy(F.col("cwd").alias("own_folder")).agg(F.min("project").alias("p_folder"))
    met = prompts.join(by_sid, F.col("sid") == F.col("own_sid"), "left").join(by_folder, F.col("folder") == F.col("own_folder"), "left")
    return met.select(*prompts.columns, F.coalesce("p_sid", "p_folder", project_from_cwd(F.col("folder"))).alias("project"))
