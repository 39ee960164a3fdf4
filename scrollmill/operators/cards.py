"""Work cards from stored lines: where they open, what they own, their counters.

``lines`` has key, sid, path, fid, off, ts, kind, kind_sub, text, msg_id, model,
the usage columns, tool_uses and tool_results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.display import is_goal_input
from ..functions.extraction import queue_key

# Kinds that open a card, that are work, and that can stand for an
# input that a file begins without.
STARTERS = ["human", "sdk", "bash_in", "slash", "queued"]
WORK = ["assistant", "tool_result"]
INPUT_LIKE = ["peer", "task_note", "user_other", "meta", "command", "side_user"]


def openings(lines: DataFrame) -> DataFrame:
    """``lines`` with opens, delivered and card: how many cards a file has opened.

    A queued input that is not delivered later (nor two minutes before) is a card
    of its own, undelivered, that owns no other line. Work before any card opens one without an
    input.
    """
    goal = is_goal_input(F.col("kind"), F.col("kind_sub"), F.col("text"))
    starts = F.col("kind").isin(STARTERS) | goal
    keyed = lines.withColumn("__q", F.when(F.col("kind").isin(*STARTERS, "qo_human"), queue_key(F.col("kind"), F.col("text"))))
    same = W.partitionBy("fid", "__q").orderBy("off")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    near = F.coalesce(us(F.col("ts")) - us(F.lag("ts").over(same)) <= 120_000_000, F.lit(False))
    stray = (F.col("kind") == "qo_human") & F.lead("off").over(same).isNull() & ~near
    marked = keyed.withColumn("__stray", F.coalesce(stray, F.lit(False))).withColumn("__start", F.coalesce(starts, F.lit(False)))
    order = W.partitionBy("fid").orderBy("off")
    upto, before = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, -1)
    work = F.col("kind").isin(WORK)
    first_work = work & (F.coalesce(F.max((F.col("__start") | work).cast("int")).over(before), F.lit(0)) == 0)
    opened = marked.withColumn("no_human", first_work).withColumn("opens", F.col("__start") | first_work | F.col("__stray")).withColumn("delivered", (~F.col("__stray")).cast("int"))
    return opened.withColumn("card", F.sum((F.col("opens") & (F.col("delivered") == 1)).cast("int")).over(upto)).withColumn("seq", F.sum(F.col("opens").cast("int")).over(upto) - 1).drop("__q", "__stray", "__start")


def heads(opened: DataFrame) -> DataFrame:
    """One row a card: key, sid, fid, off, seq, ts, human_kind, human, delivered.

    A card without an input shows the last input-like line before it, one that is
    no note of the system if there is any.
    """
    before = W.partitionBy("fid").orderBy("off").rowsBetween(W.unboundedPreceding, -1)
    # The first input-like line is remembered; if it is a note, the first other one.
    memory = F.min(F.when(F.col("kind").isin(INPUT_LIKE), F.struct((F.col("kind") == "meta").cast("int").alias("meta"), "off", "text"))).over(before)
    rows = opened.withColumn("__memory", memory).where("opens")
    kind = (
        F.when(F.col("no_human"), "no_human").when(F.col("kind") == "att", "goal")
        .when(F.col("kind") == "human", F.concat_ws(":", F.lit("human"), "kind_sub")).otherwise(F.col("kind"))
    )
    return rows.select(
        F.concat(F.lit("c:"), "key").alias("card_key"), "sid", "path", "fid", "off", "card", "seq", F.col("ts").alias("start_ts"), kind.alias("human_kind"),
        F.when(F.col("no_human"), F.coalesce(F.col("__memory.text"), F.lit(""))).otherwise(F.col("text")).alias("human"), "delivered", F.col("key").alias("first_ekey"),
    )


def messages(opened: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_key, msg_id, model, usage): each message once, its line of largest
    output, for the first card of the session in which it stands."""
    own = opened.where("msg_id is not null").join(cards.where("delivered = 1").select("fid", "card", "card_key"), ["fid", "card"])
    session = W.partitionBy("sid", "msg_id")
    first = own.withColumn("card_key", F.first("card_key").over(session.orderBy("path", "off")))
    best = first.withColumn("__n", F.row_number().over(session.orderBy(F.desc_nulls_last("u_out"), "path", "off"))).where("__n = 1")
    return best.select("card_key", "msg_id", "model", "u_in", "u_out", "u_cc", "u_cr", "off")


def assemble(lines: DataFrame) -> DataFrame:
    """One row a card with its counters: events, answers, tools, files, commands,
    errors and repeats, denials, interrupts, tokens, model, end and last answer."""
    opened = openings(lines)
    cards = heads(opened)
    member = opened.where("card > 0 and (not opens or no_human)").join(cards.where("delivered = 1").select("fid", "card", "card_key"), ["fid", "card"])
    work = F.col("kind").isin(WORK)
    counts = member.groupBy("card_key").agg(
        F.count_if(~F.col("no_human")).alias("n_more"), F.count_if(F.col("kind") == "assistant").alias("n_lines"), F.max(F.when(work, F.col("ts"))).alias("work_ts"),
        F.count_if(F.col("kind") == "interrupt").alias("n_stop"), F.max_by(F.when((F.col("kind") == "assistant") & (F.col("kind_sub") == "text"), F.col("text")), F.when((F.col("kind") == "assistant") & (F.col("kind_sub") == "text"), F.col("off"))).alias("last_answer"),
    )
    calls = member.select("card_key", "off", F.explode("tool_uses").alias("u")).select("card_key", "off", "u.idx", "u.name", "u.fpath", "u.cmd")
    # Each value once, where it was first seen, then in that order.
    seen = lambda c: calls.where(F.col(c).isNotNull()).groupBy("card_key", c).agg(F.min(F.struct("off", "idx")).alias("at")).groupBy("card_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda x: x[c]).alias({"fpath": "files", "cmd": "cmds"}[c]))
    names = calls.groupBy("card_key", "name").agg(F.count("*").alias("n")).groupBy("card_key").agg(F.sum("n").alias("n_tools"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("tools"))
    given = member.select("card_key", F.explode("tool_results").alias("r"))
    errors = given.groupBy("card_key", "r.err_sig").agg(F.sum("r.is_err").alias("e"), F.count_if(F.col("r.denial").isNotNull()).alias("d"), F.sum("r.intr").alias("i"))
    failed = errors.groupBy("card_key").agg(F.sum("e").alias("n_err"), F.sum(F.when(F.col("err_sig").isNotNull(), F.greatest(F.col("e") - 1, F.lit(0))).otherwise(0)).alias("n_err_repeat"), F.sum("d").alias("n_denied"), F.sum("i").alias("n_cut"))
    said = messages(opened, cards)
    tokens = said.groupBy("card_key").agg(F.count("*").alias("n_asst"), *(F.sum(c).alias(f"tok_{c[2:]}") for c in ("u_in", "u_out", "u_cc", "u_cr")))
    per_model = said.where("model is not null and model <> '<synthetic>'").groupBy("card_key", "model").agg(F.count("*").alias("n"), F.min("off").alias("first"))
    model = per_model.groupBy("card_key").agg(F.max_by("model", F.struct(F.col("n"), -F.col("first"))).alias("model"))
    whole = cards
    for part in (counts, seen("fpath"), seen("cmd"), names, failed, tokens, model):
        whole = whole.join(part, "card_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    end = F.coalesce("work_ts", "start_ts")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return whole.select(
        *cards.columns, (F.coalesce("n_more", F.lit(0)) + 1).alias("n_events"), zero("n_asst"), zero("n_tools"), "tools", "files", F.slice("cmds", 1, 40).alias("cmds"), zero("n_err"), zero("n_err_repeat"), zero("n_denied"),
        (F.coalesce("n_stop", F.lit(0)) + F.coalesce("n_cut", F.lit(0))).alias("n_intr"), *(zero(f"tok_{c}") for c in ("in", "out", "cc", "cr")), "model", end.alias("end_ts"),
        F.greatest(F.lit(0.0), (us(end) - us(F.col("start_ts"))) / 1e6).alias("dur_s"), "last_answer",
    )


def raw_tokens(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(part, tokens): output tokens counted anew, each message once a file, of
    main files and of those of agents: what the cards' sums must agree with."""
    best = lines.where("msg_id is not null").groupBy("fid", "msg_id").agg(F.max("u_out").alias("u"))
    return best.join(files.select("fid", F.when(F.col("file_kind") == "session", "main").otherwise("sub").alias("part")), "fid").groupBy("part").agg(F.sum("u").alias("tokens"))


def differences(old: DataFrame, new: DataFrame, kind: str = "human_kind") -> DataFrame:
    """(kind, stored, rebuilt, added, removed) of two card tables by their keys."""
    a, b = old.select("card_key", F.col(kind).alias("ka")), new.select("card_key", F.col(kind).alias("kb"))
    both = a.join(b, "card_key", "full_outer").select(F.coalesce("kb", "ka").alias("kind"), "ka", "kb")
    gone = lambda x, y: F.count_if(F.col(x).isNotNull() & F.col(y).isNull())
    return both.groupBy("kind").agg(F.count("ka").alias("stored"), F.count("kb").alias("rebuilt"), gone("kb", "ka").alias("added"), gone("ka", "kb").alias("removed"))
