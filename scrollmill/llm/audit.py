"""Filter interaction audit: what each filter removes in every order of filters.

A row's failures are one bit mask, so all orders follow from counts of masks.
Duplicates are found by refining a partition: rows part by length in code points,
then by the hashes of successive blocks of their texts; a class of one row is
dropped from each round on, and what survives is compared as full texts.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The filters, in the order of their bits: few words, few distinct words, many
#: capitals, odd marks, copy of a smaller id's text.
FILTERS = "ABCDE"
#: Ends of the successive blocks in code points; the last block is the rest.
BLOCKS = (64, 1024, 16384)
LEVELS = ["n_chars", *(f"k{i}" for i in range(len(BLOCKS) + 1))]


def fails(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    bit = lambda cond, i: F.when(cond, F.lit(1 << i)).otherwise(F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    # The words are an array of one element, so that they are split once a row.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    of_words = F.transform(counts, lambda c: bit(c["n"] < 200, 0) + bit(F.lit(100) * c["d"].cast("long") < F.lit(50) * c["n"].cast("long"), 1))
    return F.get(of_words, F.lit(0)) + bit(F.lit(100) * capitals.cast("long") > F.lit(2) * F.length(text).cast("long"), 2) + bit(text.rlike("[#$%&*|]"), 3)


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, part, text and the class of each row at each level."""
    found = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
    begun, above = 0, F.xxhash64(F.lit(seed), "n_chars")
    for level, end in zip(LEVELS[1:], (*BLOCKS, None), strict=True):
        block = F.substring("text", begun + 1, (end or (1 << 31) - 1 - begun) - (begun if end else 0))
        found = found.withColumn(level, F.xxhash64(above, block))
        begun, above = end or 0, F.col(level)
    return found


def place(level: str, log2_bits: int) -> Column:
    return F.pmod(F.xxhash64(level), F.lit(1 << log2_bits))


def shared_classes(rows: DataFrame, level: str, log2_bits: int) -> DataFrame:
    """The classes of more than one row as a bitmap of 2**log2_bits bits, in
    pages of 32768: its size has that bound however many classes there are."""
    several = rows.groupBy(level).agg(F.count("*").alias("n")).where("n > 1").select(place(level, log2_bits).alias("at"))
    return materialize(several.groupBy(F.expr("at div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits")), "shared-classes")


def survives(rows: DataFrame, level: str, bitmap: DataFrame, log2_bits: int) -> DataFrame:
    """``rows`` with ``live``: false only if no other row is of its class. The
    bitmap may let a few single rows pass, which costs work and no result."""
    at = rows.withColumn("at", place(level, log2_bits)).withColumn("page", F.expr("at div 32768"))
    met = at.join(F.broadcast(bitmap), "page", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("shiftleft(1, cast(at % 8 as int))")
    return met.withColumn("live", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("at", "page", "bits")


def duplicates(docs: DataFrame, log2_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(rows, copies): a compact row for each of ``docs`` (doc_id, part, fails,
    the last level's class, live), and for each class that holds copies the
    smallest doc_id of its text.

    Full texts are shuffled for survivors only, each text once a task. Should two
    different texts share a class, all starts again with another hash seed.
    """
    seed = 0
    while True:
        found = keyed(docs, seed)
        rows = materialize(found.select("doc_id", "part", fails(F.col("text")).alias("fails"), *LEVELS), "audit-rows")
        live = rows
        for level in LEVELS:
            bitmap = shared_classes(live.select(*LEVELS), level, log2_bits)
            rows_of = survives(rows, level, bitmap, log2_bits)
            live = rows_of.where("live")
        last = LEVELS[-1]
        texts = survives(found.select("doc_id", "text", last), last, bitmap, log2_bits).where("live")
        copies = texts.groupBy(last, "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).drop("text")
        copies = materialize(copies, "audit-copies")
        if copies.groupBy(last).count().where("count > 1").isEmpty():
            return rows_of.select("doc_id", "part", "fails", last, "live"), copies.where("n > 1").select(last, "least")
        seed += 1


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``mask``, the bits of all five filters, for every row."""
    rows, copies = duplicates(docs)
    met = rows.where("live").join(copies, LEVELS[-1], "left")
    copy = F.when(F.col("doc_id") > F.col("least"), F.lit(16)).otherwise(F.lit(0))
    return met.select("doc_id", "part", (F.col("fails") + copy).alias("mask")).unionByName(rows.where("not live").select("doc_id", "part", F.col("fails").alias("mask")))


def steps() -> Column:
    """All orders' steps: name, step, the filters before it, up to it, and its own."""
    made, bit = [], {f: 1 << i for i, f in enumerate(FILTERS)}
    for order in itertools.permutations(FILTERS):
        before = 0
        for i, f in enumerate(order):
            made.append({"filter_order": "".join(order), "step": i + 1, "before": before, "upto": before | bit[f], "own": FILTERS.index(f)})
            before |= bit[f]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<filter_order string, step int, before int, upto int, own int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), order of the five filters and step: kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A null text is empty, a null source is the empty string. A row is a copy if a
    smaller doc_id has the same text; rows of one id are no copies of each other,
    and a row without an id neither is one nor makes others copies. A label
    counts as 1 if any row of its id says so; null ids have no label. Texts of any
    length are hashed and compared whole; other columns of either table are
    ignored; an empty table gives an empty result.
    """
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    label = label.where("good = 1 or toxic = 1")
    seen = masks(docs).join(label, "doc_id", "left")
    counted = seen.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    apart = lambda c: [F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in range(32)]  # noqa: E731  rows that fail none of s
    single = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(5)]
    # A row that fails k filters is removed by each of them in 120 / k of the orders.
    value = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n") * F.expr("120 div greatest(1, bit_count(mask))")).otherwise(0)) for i in range(5)]
    parts = counted.groupBy("part").agg(*(F.array(*apart(c)).alias(c) for c in ("n", "good", "toxic")), F.array(*single).alias("single"), F.array(*value).alias("value"))
    each = parts.select("*", F.inline(steps()))
    at = lambda c, i: F.get(c, F.col(i) if isinstance(i, str) else i)
    removed = lambda c: at(c, "before") - at(c, "upto")
    own = F.expr("shiftleft(1, own)")
    return each.select(
        "part", "filter_order", "step", at("n", "upto").alias("kept"), removed("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", own) - removed("n")).alias("redundant"), at("single", "own").alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), at("value", "own").alias("shapley"),
    )


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, coalesce(doc_id > min(doc_id) over (partition by t), false) as copy from d),
m as (
    select doc_id, part, cast(len(ws) < 200 as int) + 2 * cast(100 * len(list_distinct(ws)) < 50 * len(ws) as int)
        + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) as int)
        + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(copy as int) as mask from w),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
c as (select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m left join l on m.doc_id = l.doc_id group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from f a, f b, f c, f d, f e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] as x from o, (select unnest([1, 2, 3, 4, 5]) as step)),
b as (
    select filter_order, cast(step as int) as step, cast(pow(2, ascii(x) - 65) as int) as own,
        cast(coalesce(sum(cast(pow(2, ascii(x) - 65) as int)) over (partition by filter_order order by step rows between unbounded preceding and 1 preceding), 0) as int) as before from s)
select part, filter_order, step,
    cast(coalesce(sum(n) filter (where mask & (before | own) = 0), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter (where mask & before = 0 and mask & own <> 0), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (where mask & before <> 0 and mask & own <> 0), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (where mask = own), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (where mask & before = 0 and mask & own <> 0), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter (where mask & before = 0 and mask & own <> 0), 0) as bigint) as toxic_lost,
    cast(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) filter (where mask & own <> 0), 0) as bigint) as shapley
from c, b group by part, filter_order, step
"""
