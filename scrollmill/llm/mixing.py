"""Mixing sources to target weights, with DataFrame functions only.

Documents of a source are dealt into buckets and packed there, in a fixed order,
into blocks of fixed length (the last of a bucket may be shorter). Every output
shard draws how many of its slots each source gets: a multinomial conditioned on
the sources' totals, as one pseudorandom permutation deals all slots to shards.
The counts give each source's range of slot numbers in the shard, numbers map
through a permutation of the source's block indexes for each pass, and blocks are
joined by index.

Permutations are swap-or-not networks over any length, in plain arithmetic, so
any engine repeats them and no table of random numbers is shipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
PRIME, ROUNDS, SHARD_SLOTS, SLOT_CHUNK, BUCKET_BLOCKS = 2147483647, 12, 4096, 4096, 1024


def mixed(a: str, turn: str, seed: str) -> str:
    """SQL for a pseudorandom number below PRIME; all inputs are long, a >= 0."""
    first = f"((({a}) % {PRIME} * 48271 + ({turn}) * 16807 + ({seed})) % {PRIME})"
    second = f"(({first} * {first} + ({turn}) * 12345 + ({seed})) % {PRIME})"
    return f"(({second} * 48271 + {first}) % {PRIME})"


def keys(n: str, seed: str) -> str:
    """SQL for the round keys of a permutation of 0 .. n - 1."""
    return f"transform(sequence(0L, {ROUNDS - 1}L), r -> ({mixed('r + 101', '7', seed)} * {PRIME} + {mixed('r + 211', '3', seed)}) % ({n}))"


def rounds(n: str) -> str:
    """SQL for one round of a permutation: y under the round key k. Its image is
    k - y or y itself, as a bit drawn for the pair says, so it is one to one."""
    partner = f"((k - y + {n}) % {n})"
    once = f"((greatest(y, {partner}) % {PRIME} * 48271 + k) % {PRIME})"
    return f"if(({once} * {once} + k) % {PRIME} div 65536 % 2 = 1, {partner}, y)"


def permuted(x: str, n: str, by: str) -> str:
    """SQL for the image of x under the permutation of 0 .. n - 1 with keys ``by``."""
    return f"aggregate({by}, {x}, (y, k) -> {rounds(n)})"


def permute(df: DataFrame, x: str, n: str, by: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: ``permuted`` as one projection a round.

    Within a round the repeated terms are common subexpressions, which become
    methods of their own: the JVM compiles those after a few rows, and leaves a
    method of over 8000 bytes, as one of all the steps would be, interpreted.
    """
    kept = df.columns
    df = df.select(*kept, F.expr(by).alias("__by"), F.expr(x).alias("__y"), F.expr(n).alias("__n"))
    for k in (f"__by[{r}]" for r in range(ROUNDS)):
        partner = f"({k} - __y + if({k} < __y, __n, 0L))"
        once = f"((greatest(__y, {partner}) % {PRIME} * 48271 + {k}) % {PRIME})"
        df = df.select(*kept, "__by", F.expr(f"if(({once} * {once} + {k}) % {PRIME} & 65536 = 0, __y, {partner})").alias("__y"), "__n")
    return df.select(*kept, F.col("__y").alias(name))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, text, size) and ``more`` for every row: size in words, null 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: nr, source, source_size, target.

    Weights 5, 2, 1 repeat over the sources by code point, null last; together
    they share 150 % of all words, none above twice its size. That is one level
    of words per weight, the largest that freezing the sources of least size per
    weight one after the other reaches. The windows see one row a source.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("nr") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nr", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", weight), "sources",
    )
    before = W.orderBy(F.col("source_size") / F.col("weight"), "nr").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.col("source_size") / F.col("weight"), "nr").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    taken = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = per.select(((F.sum("source_size").over(everything) * SHARE - taken) / left).alias("level")).agg(F.coalesce(F.max("level"), F.lit(0.0))).first()[0]
    return per.select("nr", "source", "source_size", F.least(F.col("source_size") * float(MOST), F.col("weight") * F.lit(float(level))).alias("target"))


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str, group: int = 1024) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of ``keys`` before this one
    by ``order``, a number. Groups of orders are summed first, so that no window
    holds more than a group or the list of groups."""
    df = df.withColumn("__g", F.expr(f"{order} div {group}"))
    before = lambda *by: W.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    tops = df.groupBy(*keys, "__g").agg(F.sum(value).alias("__s")).withColumn("__t", so_far("__s", before("__g"))).drop("__s")
    return df.join(tops, [*keys, "__g"]).withColumn(name, F.col("__t") + so_far(value, before("__g", order))).drop("__g", "__t")


def bucket(buckets: str, seed: int) -> str:
    """SQL for a document's bucket; its text's length counts too, so that an id
    that many rows share (or none) is spread."""
    return f"({mixed(f'pmod(coalesce(doc_id, -1), {PRIME}) + mark', '1', str(seed))} % ({buckets}))"


def packed(sizes: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The plan (one row a source), the buckets (nr, bucket, n blocks, first
    block), and the rows of ``sizes`` with nr and bucket: without their text but
    with its hash, as stored, and with it."""
    whole = sizes.withColumn("text_key", F.xxhash64("text")).withColumn("mark", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    small = materialize(whole.drop("text"), "sizes")
    per = targets(small).withColumn("buckets", F.expr(f"greatest(1L, (source_size + {block_words * BUCKET_BLOCKS - 1}) div {block_words * BUCKET_BLOCKS})"))

    def of_source(df):
        kept = [c for c in df.columns if c not in ("source", "mark")]
        return df.join(per.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).select(*kept, "source", "nr", "source_size", "target", F.expr(bucket("buckets", seed)).alias("bucket"))

    own = materialize(of_source(small), "mix-own")
    filled = own.groupBy("nr", "bucket").agg(F.sum("size").alias("words")).select("nr", "bucket", F.expr(f"(words + {block_words - 1}) div {block_words}").alias("n"))
    filled = materialize(running(filled, ["nr"], "bucket", "n", "first"), "mix-buckets")
    before = W.orderBy("nr").rowsBetween(W.unboundedPreceding, -1)  # one row a source
    plan = (
        per.join(filled.groupBy("nr").agg(F.sum("n").alias("blocks")), "nr")
        .withColumn("slots", F.expr("if(source_size = 0, 0L, cast(floor(target * blocks / source_size + 0.5) as long))"))
        .withColumn("base", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    )
    return materialize(plan, "mix-plan"), filled, own, of_source(whole)


def draw(plan: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, nr, n, first, before, size): how many of a shard's slots a source
    is drawn for, the number of its first one among the source's slots and in the
    shard, and the shard's slots.

    Slots are unrolled in two steps, chunks first, so that no task unrolls a
    large source by itself; a shard's counts are summed before the shuffle.
    """
    total = f"{max(1, plan.agg(F.coalesce(F.sum('slots'), F.lit(0))).first()[0])}L"
    # The keys ride along from the plan: an expression of no column would be worked out for every slot.
    chunks = plan.where("slots > 0").select("nr", "base", "slots", F.expr(f"{total} + nr * 0").alias("total"), F.expr(keys(total, f"{seed}L + 17 + nr * 0")).alias("every"))
    chunks = chunks.select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_CHUNK})")).alias("chunk"))
    chunks = chunks.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "nr", "chunk")
    each = chunks.select("nr", "base", "total", "every", F.explode(F.expr(f"sequence(chunk * {SLOT_CHUNK}, least(slots, (chunk + 1) * {SLOT_CHUNK}) - 1)")).alias("i"))
    each = permute(each, "base + i", "total", "every", "place").select("nr", F.expr(f"place div {SHARD_SLOTS}").alias("shard"))
    drawn = materialize(each.groupBy("shard", "nr").agg(F.count("*").alias("n")), "draw")
    in_shard = W.partitionBy("shard")
    ranges = running(drawn, ["nr"], "shard", "n", "first").withColumn("size", F.sum("n").over(in_shard))
    return materialize(ranges.withColumn("before", F.coalesce(F.sum("n").over(in_shard.orderBy("nr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "draw-ranges")


def slots(plan: DataFrame, drawn: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, slot, nr, block): what stands where in the output. A source's slot
    numbers run through all its blocks in one pass and through the rest in the
    next, each pass in an order of its own; no row unrolls more than a shard."""
    own = lambda turn: F.expr(keys("blocks", f"{seed}L + nr * 1009 + {turn}"))
    ranges = drawn.join(plan.select("nr", "blocks"), "nr").select("*", own(0).alias("own"), own(1).alias("own_again"), F.expr(keys("size", f"{seed}L + 31")).alias("of_shard"))
    ranges = ranges.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "nr")
    each = ranges.select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("j"))
    each = permute(each, "(first + j) % blocks", "blocks", "if(first + j < blocks, own, own_again)", "block")
    # Stored between, as a stage compiles one permutation well but not two, and after,
    # as a filter that a join's key implies would be pushed through the permutations.
    each = materialize(each.select("shard", "nr", "block", F.expr("before + j").alias("at"), "size", "of_shard"), "slot-blocks")
    return materialize(permute(each, "at", "size", "of_shard", "slot").select("shard", "slot", "nr", "block"), "slots")


def dealt(plan: DataFrame, filled: DataFrame, whole: DataFrame, block_words: int = 128, seed: int = 1) -> DataFrame:
    """The mix itself, one row a slot: shard, slot, nr, source, bucket, block,
    words and parts, array<struct<start, doc_id, words, text>>, the pieces of
    documents in the block by their place in the bucket; their words are joined
    by spaces.

    Texts are shuffled once: a bucket's documents and the slots that want its
    blocks come together, and all that follows keeps that partitioning.
    """
    index = filled.where("n > 0").select("nr", "bucket", "first", F.explode(F.expr("sequence(first, first + n - 1)")).alias("block"))
    # Both sides follow the input, which the planner's estimates don't see past
    # explode(); the hint keeps it from broadcasting them.
    wanted = slots(plan, draw(plan, seed), seed).join(index.hint("merge"), ["nr", "block"])
    wanted = wanted.select("nr", "bucket", (F.col("block") - F.col("first")).alias("at"), F.struct("shard", "slot", "block").alias("place"))
    docs = whole.where("size > 0").select("nr", "bucket", "source", "doc_id", "size", "text_key", "text")
    both = docs.unionByName(wanted, allowMissingColumns=True)
    order = W.partitionBy("nr", "bucket").orderBy(F.col("place").isNotNull(), "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("start", F.sum("size").over(order) - F.col("size"))
    cut = F.expr(f"""explode(if(place is not null, array(named_struct('at', at, 'part', cast(null as struct<start:bigint,doc_id:bigint,words:bigint,text:string>))),
        transform(array(regexp_extract_all(text, '{WORD}', 0)), w -> transform(
            sequence(start div {block_words}, (start + size - 1) div {block_words}),
            b -> named_struct('at', b, 'part', named_struct('start', start, 'doc_id', doc_id, 'words', least(start + size, (b + 1) * {block_words}) - greatest(start, b * {block_words}),
                'text', array_join(slice(w, int(greatest(0L, b * {block_words} - start)) + 1, int(least(start + size, (b + 1) * {block_words}) - greatest(start, b * {block_words}))), ' ')))))[0]))""".replace("\\", "\\\\"))
    met = both.select("nr", "bucket", "source", "place", cut.alias("p")).groupBy("nr", "bucket", "p.at").agg(
        F.first("source", ignorenulls=True).alias("source"), F.sum("p.part.words").alias("words"), F.sort_array(F.collect_list("p.part")).alias("parts"), F.collect_list("place").alias("places"),
    )
    rows = met.select("nr", "source", "bucket", "words", "parts", F.explode("places").alias("place"))
    return materialize(rows.select("place.shard", "place.slot", "nr", "source", "bucket", "place.block", "words", "parts"), "mix", "zstd")  # repeats of a block stand together


def blocks(sizes: DataFrame, block_words: int = 128, seed: int = 1) -> DataFrame:
    """The mix of ``sizes`` (doc_id, source, text, size) as ``dealt`` gives it.

    Rows without words are in no block; a null source is a source; repeated rows
    each take part; a very long text is cut over many blocks by the task of its
    bucket; other columns are ignored; an empty table gives an empty mix.
    """
    plan, filled, _, whole = packed(sizes.select("doc_id", "source", "text", "size"), block_words, seed)
    return dealt(plan, filled, whole, block_words, seed)


def mix(sizes: DataFrame, block_words: int = 128, seed: int = 1) -> DataFrame:
    """The columns of ``sizes`` (doc_id, source, size, ...) but its text, with
    source_size, target, taken (how many of the row's words the mix holds) and
    first_shard (the first output shard that holds any, null if none does), both
    read off the written mix.

    ``taken`` counts repeats; a source's sum is near its target (a bucket's last
    block may be short) and no document exceeds twice its size, as each pass
    takes a block once at most and targets end two passes. Rows without words
    take 0; a null source is a source; repeated rows each take their own part;
    an empty table gives none. Columns named as the added ones are replaced.
    """
    added = ("source_size", "target", "taken", "first_shard")
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "text", "size", *added)]
    own_row = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in more)).alias("more")
    plan, filled, own, whole = packed(sizes.select("doc_id", "source", "text", "size", own_row), block_words, seed)
    inside = W.partitionBy("nr", "bucket").orderBy("doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    parts = dealt(plan, filled, whole, block_words, seed).select("nr", "bucket", "shard", F.explode("parts").alias("p"))
    taken = parts.groupBy(F.col("nr").alias("t_nr"), F.col("bucket").alias("t_bucket"), F.col("p.start").alias("t_start")).agg(F.sum("p.words").alias("taken"), F.min("shard").alias("first_shard"))
    same = (F.col("nr") == F.col("t_nr")) & (F.col("bucket") == F.col("t_bucket")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0)
    found = placed.join(taken.hint("merge"), same, "left")
    return found.select("doc_id", "source", "size", *(F.col("more")[c].alias(c) for c in more), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def shard_counts(mix: DataFrame) -> DataFrame:
    """The source counts of a written mix: (shard, nr, n)."""
    return mix.groupBy("shard", "nr").agg(F.count("*").alias("n"))
