"""What a session resumes with: its parts as lines, packed under a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import first_by

#: Characters kept free for the closing note.
RESERVE = 120

_STATE = "struct<used:long,out:array<string>,lines:long,names:array<string>>"
_LINES = "struct<used:long,out:array<string>,cut:boolean,kept:long>"


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pack(head: Column, parts: Column, limit: Column) -> Column:
    """The parts (title, n, lines) after the head's lines: a part whose title does
    not fit is left out whole, one whose lines don't is cut with a note."""
    cost = lambda x: F.length(x).cast("long") + 1

    def line(s: Column, x: Column) -> Column:
        full = s["used"] + cost(x) + RESERVE > limit
        put = F.struct((s["used"] + cost(x)).alias("used"), F.concat(s["out"], F.array(x)).alias("out"), F.lit(False).alias("cut"), (s["kept"] + 1).alias("kept"))
        stop = F.struct(s["used"].alias("used"), s["out"].alias("out"), F.lit(True).alias("cut"), s["kept"].alias("kept"))
        return F.when(s["cut"] | full, stop).otherwise(put).cast(_LINES)

    def part(s: Column, p: Column) -> Column:
        title = F.concat(F.lit("\n## "), p["title"])
        out = F.struct(s["used"].alias("used"), s["out"].alias("out"), (s["lines"] + p["n"]).alias("lines"), F.concat(s["names"], F.array(p["title"])).alias("names"))
        begun = F.struct((s["used"] + cost(title)).alias("used"), F.concat(s["out"], F.array(title)).alias("out"), F.lit(False).alias("cut"), F.lit(0).cast("long").alias("kept")).cast(_LINES)

        def close(r: Column) -> Column:
            rest = p["n"] - r["kept"]
            note = F.concat(F.lit("- (잘림: 이 절 "), rest.cast("string"), F.lit("줄 생략)"))
            cut = F.struct((r["used"] + cost(note)).alias("used"), F.concat(r["out"], F.array(note)).alias("out"), (s["lines"] + rest).alias("lines"), s["names"].alias("names"))
            whole = F.struct(r["used"].alias("used"), r["out"].alias("out"), s["lines"].alias("lines"), s["names"].alias("names"))
            return F.when(rest > 0, cut).otherwise(whole)

        packed = _once(F.aggregate(p["lines"], begun, line), close)
        return F.when(s["used"] + cost(title) + RESERVE > limit, out).otherwise(packed).cast(_STATE)

    start = F.struct(
        F.coalesce(F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + cost(x)), F.lit(0)).alias("used"), head.alias("out"),
        F.lit(0).cast("long").alias("lines"), F.expr("cast(array() as array<string>)").alias("names"),
    ).cast(_STATE)

    def close(s: Column) -> Column:
        left = F.when(F.size(s["names"]) > 0, F.concat(F.lit(" · 빠진 절: "), F.array_join(s["names"], ", "))).otherwise("")
        tail = F.concat(F.lit("\n_잘림: 상한 "), limit.cast("string"), F.lit("자 · 생략 "), s["lines"].cast("string"), F.lit("줄"), left, F.lit("_"))
        told = F.when((s["lines"] > 0) | (F.size(s["names"]) > 0), F.array(F.substring(tail, 1, RESERVE))).otherwise(F.expr("cast(array() as array<string>)"))
        return _once(F.array_join(F.concat(s["out"], told), "\n"), lambda t: F.when(F.length(t) > limit, F.concat(F.substr(t, F.lit(1), F.greatest(limit - 12, F.lit(0)).cast("int")), F.lit("\n_잘림_"))).otherwise(t))

    return _once(F.aggregate(parts, start, part), close)


def assemble(heads: DataFrame, lines: DataFrame, limit: Column) -> DataFrame:
    """``heads`` (id, head: array<string>, and what ``limit`` needs) with ``text``.

    ``lines`` are (id, part, title, line_no, line); a part without lines has one
    row whose line is null. Of a part at most ``limit`` lines can fit, so a
    session's rows are cut to that many a part before they meet, and counted whole.
    A session without lines is its head; a null id has no lines.
    """
    w = W.partitionBy("id", "part")
    most = heads.select("id", limit.alias("most"))
    near = lines.withColumn("n", F.count("line").over(w)).withColumn("nr", F.row_number().over(w.orderBy("line_no"))).join(most, "id").where("nr <= greatest(most, 1)")
    own = near.groupBy("id", "part").agg(F.min("title").alias("title"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("nr", "line")))).alias("l"))
    parts = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "title", F.col("n").cast("long").alias("n"), F.transform("l", lambda x: x["line"]).alias("lines")))).alias("parts"))
    met = heads.join(parts, "id", "left")
    kind = parts.schema["parts"].dataType.simpleString()
    given = F.coalesce(F.col("parts").cast(kind), F.expr(f"cast(array() as {kind})"))
    return met.withColumn("text", _pack(F.coalesce("head", F.expr("cast(array() as array<string>)")), given, limit.cast("long"))).drop("parts")


def latest_compaction(sections: DataFrame, events: DataFrame) -> DataFrame:
    """One row a session: the last event (key, sid, ts, text) that has sections
    (ekey, part, body), with its sections in order."""
    own = events.join(sections.select(F.col("ekey").alias("key")).distinct(), "key")
    last = first_by(own, ["sid"], [F.desc_nulls_last("ts"), F.desc("key")])
    told = sections.groupBy(F.col("ekey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("sections"))
    return last.join(told, "key")


def recent_cards(cards: DataFrame, left_out: DataFrame, seen: int = 8, kept: int = 5) -> DataFrame:
    """Of each project's last ``seen`` cards (project, key, sid, ts) those not of
    a session to leave out (sid), the last ``kept``, with ``place`` from the oldest."""
    last = cards.withColumn("nr", F.row_number().over(W.partitionBy("project").orderBy(F.desc_nulls_last("ts"), F.desc("key")))).where(F.col("nr") <= seen)
    shown = last.join(left_out.select("sid").distinct(), "sid", "left_anti")
    some = shown.withColumn("k", F.row_number().over(W.partitionBy("project").orderBy("nr"))).where(F.col("k") <= kept)
    return some.withColumn("place", F.row_number().over(W.partitionBy("project").orderBy(F.desc("k")))).drop("nr", "k")
