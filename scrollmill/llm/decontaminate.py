"""Benchmark decontamination by winnowing, with DataFrame functions only.

Any span of 13 words holds seven k-grams of seven words. A document keeps the
smallest k-gram hash of every seven in a row; whatever 13 words it shares with a
benchmark item, that hash is one of the item's k-grams, so joining the two never
misses. A hit is then extended: each window that kept the hash is looked up, word
for word, among the windows of the items, and overlapping windows are merged to
spans. Items are attached last, to a document's distinct windows. An item of fewer
words is one window; n-grams of just the lengths that occur are joined for those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

WINDOW, GRAM = 13, 7
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Counts the words of a text that is not yet in lower case.
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK, -1), lambda w: w != "")


def _grams(size: int) -> str:
    """SQL for the hashes of all runs of ``size`` words, in order, from theirs."""
    run = ", ".join(f"hashes[i + {k}]" for k in range(size))
    return f"if(size(hashes) < {size}, cast(array() as array<bigint>), transform(sequence(0, size(hashes) - {size}), i -> xxhash64({size}, {run})))"


def _kept() -> str:
    """SQL for what winnowing keeps: the smallest gram hash of each window, in order."""
    keep = WINDOW - GRAM + 1
    window = ", ".join(f"grams[i + {k}]" for k in range(keep))
    return f"if(size(grams) < {keep}, cast(array() as array<bigint>), transform(sequence(0, size(grams) - {keep}), i -> least({window})))"


def _prints(hashes: str, length: int, extra: str) -> str:
    """SQL for the fingerprints of the windows of ``length`` words: (key, length,
    first, last, and ``extra``, from ``first`` and ``last``). Neighbours of one hash
    are one fingerprint; ``first`` and ``last`` are the starts, from 1, of the
    windows that kept it."""
    heads = f"filter(sequence(1, size({hashes})), i -> i = 1 or {hashes}[i - 1] != {hashes}[i - 2])"
    ends = f"transform(heads, (at, k) -> named_struct('first', at, 'last', coalesce(get(heads, k + 1) - 1, size({hashes}))))"
    run = f"named_struct('key', {hashes}[r.first - 1], 'length', {length}, 'first', r.first, 'last', r.last, 'passage', {extra.format(length=length)})"
    # The array of heads is bound once: each run looks at the next one's start.
    return f"transform(if(size({hashes}) = 0, cast(array() as array<struct<first: int, last: int>>), transform(array({heads}), heads -> {ends})[0]), r -> {run})"


def _windows(first: str, last: str, length: str) -> str:
    return f"transform(sequence({first}, {last}), i -> array_join(slice(words, i, {length}), ' '))"


def hits(docs: DataFrame, items: DataFrame, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Where windows of items occur, (doc_id, text_key, start, length, window), and
    the items that hold each, (window, item_id), an item without an id left out.

    ``text_key`` is a hash of the text; with doc_id it names the row (repeated
    rows share their result). The items' fingerprints are broadcast up to
    ``broadcast_rows`` of them; beyond, they are joined by a shuffle. A document
    meets fingerprints and windows, not items: however many items share a passage,
    its words are looked at once.
    """
    bench = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    bench = materialize(bench.withColumn("length", F.least(F.lit(WINDOW), F.size("words"))), "bench")
    held = materialize(bench.select("item_id", "length", F.explode(F.expr(_windows("1", "size(words) - length + 1", "length"))).alias("window")).distinct(), "bench-windows")
    windows = held.select("window", "length").distinct()
    short = sorted(r.length for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # at most 12
    own_length = " ".join(f"when length = {n} then {_grams(n)}" for n in short)
    keys = windows.withColumn("hashes", F.transform(F.split("window", " "), lambda w: F.xxhash64(w)))
    keys = keys.select(F.explode(F.expr(f"case {own_length} when length = {WINDOW} then {_grams(GRAM)} end")).alias("key")).distinct()
    keys = materialize(keys, "bench-keys")

    small = keys.count() <= broadcast_rows
    # With the keys in every task, a fingerprint carries its passage (the words of the
    # windows that kept it) to the join and texts are read once; joined by a shuffle it
    # would be too wide, and the documents that it leads to are read again.
    passage = "array_join(slice(words, r.first, r.last - r.first + {length}), ' ')" if small else "cast(null as string)"
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    prints = named.select("doc_id", "text_key", words(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    prints = prints.withColumn("grams", F.expr(_grams(GRAM))).withColumn("kept", F.expr(_kept()))
    for n in short:
        prints = prints.withColumn(f"of_{n}", F.expr(_grams(n)))
    wanted = ", ".join([_prints("kept", WINDOW, passage), *(_prints(f"of_{n}", n, passage) for n in short)])
    # Outer, as the optimiser filters on what a plain explode is given: that filter
    # would work out the whole expression once more, with nothing of it bound.
    prints = prints.select("doc_id", "text_key", F.explode_outer(F.expr(f"flatten(array({wanted}))")).alias("p")).select("doc_id", "text_key", "p.*").where("key is not null")

    # A hit is extended to the windows that kept its hash, each looked up whole.
    if small:
        met = materialize(prints.join(F.broadcast(keys), "key", "left_semi"), "candidates")
        near = met.select("doc_id", "text_key", "first", "length", F.split("passage", " ").alias("words"))
        near = near.select("doc_id", "text_key", "first", "length", F.posexplode_outer(F.expr(_windows("1", "size(words) - length + 1", "length"))).alias("k", "window"))
        near = near.select("doc_id", "text_key", (F.col("first") + F.col("k")).alias("start"), "length", "window")
    else:
        met = prints.join(keys.hint("merge"), "key", "left_semi").select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), F.struct("length", "first", "last").alias("run"))
        met = materialize(met.groupBy("c_id", "c_key").agg(F.collect_set("run").alias("runs")), "candidates")
        same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))
        whole = named.join(met, same).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
        near = whole.select("doc_id", "text_key", words(F.col("text")).alias("words"), F.explode("runs").alias("run"))
        near = near.select("doc_id", "text_key", "run", F.posexplode_outer(F.expr(_windows("run.first", "run.last", "run.length"))).alias("k", "window"))
        near = near.select("doc_id", "text_key", (F.col("run.first") + F.col("k")).alias("start"), F.col("run.length").alias("length"), "window")
    found = materialize(near.join(windows, ["window", "length"], "left_semi"), "hits")
    return found, held.where("item_id is not null").select("window", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key, n_words,
    n_hit, n_items, item_ids, contaminated.

    A word is hit if an occurring window covers it; a document is contaminated
    if its hits are a twentieth of its words or more. Null and empty texts have
    no words; items without words are no windows; items without an id hit but
    are not listed; rows that repeat give the same result each; a very long text
    is hashed by one task, in time linear in its words; other columns are ignored; an empty table of
    documents gives an empty result, one of items no hits.
    """
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    # Overlaps count once: walk the spans by start, adding what lies past the end so far.
    covered = F.expr("aggregate(array_sort(spans), named_struct('end', 0, 'n', 0L), (a, s) -> named_struct('end', greatest(a.end, s.end), 'n', a.n + greatest(0, s.end - greatest(a.end, s.start))), a -> a.n)")
    found, held = hits(docs, items)
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(span).alias("spans")).select("doc_id", "text_key", covered.alias("n_hit"))
    named = found.select("doc_id", "text_key", "window").distinct().join(held, "window").select("doc_id", "text_key", F.col("item_id").cast("string").alias("item"))
    named = named.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids")).select(F.col("doc_id").alias("i_id"), F.col("text_key").alias("i_key"), "item_ids")
    per = spans.join(named, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key")), "left").select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "n_hit", "item_ids")
    per = materialize(per, "hit-documents")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.join(per, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
