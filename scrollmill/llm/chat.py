"""Chat formatting: reply trees to conversations, with DataFrame functions only.

Iterative self-joins enumerate root-to-leaf paths: each step doubles how far a
node's pointer reaches, so a thread of n turns takes log2(n) steps. Branches are
ranked by their mean score, and every chosen path becomes one text whose turns
are marked and whose loss mask covers what the assistant says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Control strings of the template and what stands for them in a
#: text. A backslash in the output always begins one of these, so reading back
#: replaces them in the opposite order.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (":", "\\c"), ("\n", "\\n")]
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    """Texts need the first three, role names (up to the colon) all of them."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES if role else ESCAPES[:3], c)


def unescape(c: Column, role: bool = False) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES if role else ESCAPES[:3]), c)


def threads(turns: DataFrame) -> DataFrame:
    """Reply trees of conversations (conv_id, turn, role, text) without branches.

    Every row replies to the one before it by (turn, role, text), nulls first;
    repeated rows stay. Null roles and texts are empty; a null conv_id is a
    conversation of its own; other columns are ignored; an empty table has no
    conversations. A conversation is the unit of the output, so its turns meet in
    one task, however long their texts.
    """
    clean = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = clean.withColumn("node", order)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, back) for every node on the way from a leaf to its root.

    A parent that is not in the tree makes its child a root. Ways that lead into
    a circle of replies have no root and are no paths.
    """
    ids = materialize(nodes.select("tree", "node", "parent"), "nodes")
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = materialize(ids.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))).select("tree", "node", F.col("parent").alias("to")).distinct(), "pointers")
    parents = up.select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    leaves = ids.select("tree", "node").distinct().join(parents, same, "left_anti")
    whole = materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back")), "paths")
    most = ids.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    roots = materialize(ids.select("tree", "node").distinct().join(up.select(F.col("tree").alias("t"), F.col("node").alias("n")), same, "left_anti"), "roots")
    step = 1
    while step < most and not up.isEmpty():
        hop = up.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        # One table a round: its ways reach twice as far as those of the one before.
        whole = materialize(whole.unionByName(whole.join(hop, same).select("tree", "leaf", F.col("to").alias("node"), (F.col("back") + step).alias("back"))), "paths")
        far = up.select(F.col("tree"), F.col("node").alias("start"), F.col("to").alias("node")).join(hop, same)
        up = materialize(far.select("tree", F.col("start").alias("node"), "to"), "pointers")
        step *= 2
    ended = whole.join(roots.select(F.col("tree").alias("t"), F.col("node").alias("n")), same, "left_semi").select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
    return whole.join(ended, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_semi")


def format_paths(nodes: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """One conversation for each chosen path of nodes (tree, node, parent, role,
    text, score): tree, leaf, path_score, formatted, loss_spans.

    Of each tree the ``paths_per_tree`` paths of highest mean score are chosen
    (nulls count 0), ties by the smaller leaf. ``loss_spans`` are code point
    ranges of the assistant's texts in ``formatted``. What meets in one task is
    one conversation, the unit of the output. Null texts count as empty only if
    the caller made them so (``threads`` does); other columns are ignored; an
    empty table gives an empty result.
    """
    nodes = materialize(nodes, "turns")
    way = materialize(paths(nodes), "ways")
    here = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    branch = way.join(scores, here).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    best = W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    chosen = materialize(branch.withColumn("place", F.row_number().over(best)).where(F.col("place") <= paths_per_tree).drop("place"), "chosen")
    picked = way.join(chosen.select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "path_score"), F.col("tree").eqNullSafe(F.col("ct")) & (F.col("leaf") == F.col("cl")))
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), (F.col("role") == "assistant").alias("loss"), F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(COLON)).alias("head"), escape(F.col("text")).alias("body"))
    turn = F.struct((-F.col("back")).alias("at"), "head", "body", "loss")
    gathered = picked.join(texts, here).groupBy("tree", "leaf").agg(F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "")
    spans = F.expr(
        f"""aggregate(turns, named_struct('pos', 0, 'spans', cast(array() as array<struct<start:int,end:int>>)),
            (a, t) -> named_struct('pos', a.pos + length(t.head) + length(t.body) + {len(TAIL)},
                'spans', if(t.loss, concat(a.spans, array(named_struct('start', a.pos + length(t.head), 'end', a.pos + length(t.head) + length(t.body)))), a.spans)),
            a -> a.spans)"""
    )
    return gathered.select("tree", "leaf", "path_score", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    parts = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), COLON, 1)
    return F.transform(parts, lambda p: F.struct(unescape(role(p), role=True).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(HEAD) + len(COLON) + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
