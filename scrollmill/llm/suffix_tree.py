"""LM scoring with a probabilistic suffix tree over the characters of tokens.

Symbols are the bytes of a text's lower-cased words in 64 classes, one separator
after every word and one end after every text. Contexts of up to ``depth``
symbols are counted over the whole training corpus; a context is kept if its
next-symbol distribution diverges from that of the context one symbol shorter
by more than a BIC penalty. Distributions are smoothed into their parents', and
a symbol is scored in the state of the longest kept suffix before it. A word's
probability mixes its spelling's under the tree with its smoothed share of the
training tokens (the distribution of the root, over whole words).

Nothing is capped: every context that passes the test is kept. Codes are dealt
into buckets by the three symbols before the next one, so a bucket holds whole
subtrees and tests and smooths them by itself; each chunk of documents asks the
buckets for its distinct codes. Only tables over three symbols, whose size the
alphabet bounds (64 ** 3), reach the driver and all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder
from .textarrays import LOWERED, SPACE, column, pieces, range_hashes, sums, words

SYMBOLS, START, SEPARATOR, END = 64, 0, 1, 2
#: Stands for the end among the word hashes.
END_KEY = np.int64(-1)


def _classes() -> np.ndarray:
    """Bytes to symbols: letters by themselves, continuation bytes by their low
    five bits, digits together, lead bytes together, the rest of ASCII together."""
    b = np.arange(256)
    out = np.full(256, 30)
    out[97:123] = 3 + b[97:123] - 97
    out[48:58] = 29
    out[128:192] = 32 + (b[128:192] & 31)
    out[192:] = 31
    return out.astype(np.int64)


CLASSES = _classes()


#: Symbols of bytes as they stand in a text.
SYMBOL_OF = CLASSES[LOWERED]


def symbol_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and where each text begins (plus one)."""
    inside = ~SPACE[data]
    starts, ends, first = words(data, at, inside)
    length = np.cumsum(ends - starts)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    begin = np.r_[0, length][first] + first + np.arange(len(at))
    out, letter = np.full(begin[-1], SEPARATOR, np.int64), np.ones(begin[-1], bool)
    letter[length + np.arange(len(length)) + text] = False
    letter[begin[1:] - 1] = False
    out[letter] = SYMBOL_OF[data[inside]]
    out[begin[1:] - 1] = END
    return out, begin


def context_codes(stream: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """Next symbol in the low six bits, the one before it in the next six, ..."""
    code = stream.copy()
    for d in range(1, depth + 1):
        code[d:] |= stream[:-d] << (6 * d)
    for seen in range(depth):  # START is 0: what stands before a text is cleared
        at = begin[:-1] + seen
        code[at[at < begin[1:]]] &= low(seen + 1)
    return code


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats the hashing of ``np.unique`` here."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Lookup:
    """Where distinct int64 ``keys`` stand, by open addressing: a few memory
    accesses a question where a binary search takes one for every halving."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, at = np.arange(len(keys), dtype=np.int32), self.home(keys)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            lost = self.slots[at] != waiting
            waiting, at = waiting[lost], (at[lost] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """Index of each asked key, or -1."""
        at = self.home(asked)
        found = self.slots[at]
        if not len(self.keys):
            return found
        going = np.flatnonzero((found >= 0) & (self.keys[found] != asked))
        at = at[going]
        while len(going):
            at = (at + 1) & self.mask
            found[going] = here = self.slots[at]
            more = (here >= 0) & (self.keys[here] != asked[going])
            going, at = going[more], at[more]
        return found


def by_chunk(values: np.ndarray, chunk: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, its distinct values); texts have a chunk and a number of values each."""
    chunks = np.unique(chunk)
    for c in chunks:
        yield int(c), distinct(values if len(chunks) == 1 else values[np.repeat(chunk == c, sizes)])


class Tally:
    """Counts of int64 keys, merged now and then so that memory stays bounded."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.keys, self.n, self.held = most, [], [], 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            keys, n = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.n.append(n.astype(np.int64))
        self.held += len(keys)

    def full(self) -> bool:
        if self.held > self.most:
            self.merge()
        return self.held > self.most // 2

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        self.keys, self.n = [keys[new]], [np.add.reduceat(n, new) if len(new) else n]
        self.held = len(new)
        return self.keys[0], self.n[0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, n = self.merge()
            self.keys, self.n, self.held = [], [], 0
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["key", "n"])


def word_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the index of each text's first one."""
    starts, ends, first = words(data, at, ~SPACE[data])
    return range_hashes(LOWERED[data], starts, ends).view(np.int64), first


def _count(make):
    def tally(batches):
        t = Tally()
        for piece in pieces(batches):
            t.add(*make(*column(piece.column("text"))))
            if t.full():
                yield from t.batches()
        yield from t.batches()

    return tally


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): how often each word occurs in ``docs``; the end once a text."""

    def make(data, at):
        keys, n = np.unique(word_keys(data, at)[0], return_counts=True)
        return np.r_[keys, END_KEY], np.r_[n, len(at) - 1]

    return docs.select("text").mapInArrow(_count(make), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def context_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(key, n): counts of packed contexts of ``depth`` with their next symbol."""
    make = lambda data, at: np.unique(context_codes(*symbol_stream(data, at), depth), return_counts=True)
    return docs.select("text").mapInArrow(_count(make), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def byte_counts(docs: DataFrame) -> DataFrame:
    """(key, n): counts of the lower-cased bytes; at most 256 rows."""
    make = lambda data, at: (np.arange(256), np.bincount(LOWERED[data], minlength=256))
    return docs.select("text").mapInArrow(_count(make), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def token_scores(data: np.ndarray, at: np.ndarray, depth: int, log_next, log_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of every word (with its separator) and of every end.

    ``log_next`` gives those of packed contexts with their next symbol.
    """
    stream, begin = symbol_stream(data, at)
    per_symbol = np.cumsum(log_next(context_codes(stream, begin, depth)), dtype=np.float64)
    per_byte = np.concatenate([[0.0], np.cumsum(np.where(SPACE[data], 0.0, log_byte[LOWERED[data]]))])
    last = np.flatnonzero(stream <= END)
    token = np.diff(per_symbol[last], prepend=0.0)
    ends = stream[last] == END
    starts, stops, _ = words(data, at, ~SPACE[data])
    return token[~ends] + per_byte[stops] - per_byte[starts], token[ends]


#: Weights of the word distribution beside the character states. A text's
#: probability is the mean of its probabilities under each weight, so the one
#: that suits the text wins at a price of log10 of their number.
WEIGHTS = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95, 0.999)


def mixed(word: np.ndarray, spelled: np.ndarray, first: np.ndarray, end: np.ndarray, end_spelled: np.ndarray) -> np.ndarray:
    """log10 probability of each text from both log10 views of its tokens.

    The word view has no zeros, so a spelling too improbable for a double adds none.
    """
    views, known, own = [], (10.0**word, 10.0**end), (10.0**spelled, 10.0**end_spelled)
    for w in WEIGHTS:
        token, last = (np.log10(w * a + (1 - w) * b) for a, b in zip(known, own, strict=True))
        views.append(sums(token, first) + last)
    views = np.stack(views)
    top = views.max(0)
    return top + np.log10(np.mean(10 ** (views - top), 0))


#: Contexts of this depth with their next symbol are few enough for every task.
NEAR = 2


def low(symbols: int) -> int:
    return (1 << (6 * symbols)) - 1


def kept(gain: np.ndarray, total: np.ndarray, kinds: np.ndarray, min_count: int) -> np.ndarray:
    """Twice the divergence (count times Kullback-Leibler distance to the parent)
    must exceed the BIC price of the context's own distribution."""
    return (total >= min_count) & (2 * gain > kinds * np.log(np.maximum(total, 1)) + 10)


@dataclass
class Level:
    """The contexts of one depth, sorted; ``keys`` are theirs with the next symbol."""

    keys: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    node: np.ndarray


def far_levels(keys: np.ndarray, n: np.ndarray, near: np.ndarray, depth: int, min_count: int) -> list[Level]:
    """The levels over NEAR of whole subtrees: their codes and the counts ``near``."""
    levels: list[Level] = []
    for d in range(NEAR + 1, depth + 1):
        own, back = np.unique(keys & low(d + 1), return_inverse=True)
        m = np.bincount(back, n, len(own))
        begin = np.flatnonzero(np.r_[True, np.diff(own >> 6) != 0])
        kinds, contexts, total = np.diff(np.r_[begin, len(own)]), own[begin] >> 6, np.add.reduceat(m, begin)
        above = contexts & low(d - 1)
        if levels:
            parent = levels[-1]
            pn, ptotal = parent.n[np.searchsorted(parent.keys, own & low(d))], parent.total[np.searchsorted(parent.contexts, above)]
        else:
            pn, ptotal = near[own & low(d)], near.reshape(-1, SYMBOLS).sum(1)[above]
        gain = np.add.reduceat(m * np.log((m / np.repeat(total, kinds)) / (pn / np.repeat(ptotal, kinds))), begin)
        levels.append(Level(own, m, contexts, total, kinds, kept(gain, total, kinds, min_count)))
    for d in range(depth, NEAR + 1, -1):  # all suffixes, so that a walk can reach it
        below, parent = levels[d - NEAR - 1], levels[d - NEAR - 2]
        parent.node[np.searchsorted(parent.contexts, below.contexts[below.node] & low(d - 1))] = True
    return levels


def near_distribution(near: np.ndarray, reached: np.ndarray, min_count: int) -> np.ndarray:
    """Probability of each code of NEAR + 1 symbols in its longest kept suffix of
    NEAR at most; ``reached``: the contexts of NEAR with kept ones beyond them."""
    two = near.reshape(SYMBOLS, SYMBOLS, SYMBOLS)  # two back, one back, next
    one, none = two.sum(0), two.sum((0, 1))

    def tested(own, parent):
        share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1)
        ratio = np.where(own > 0, share(own), 1) / np.where(own > 0, share(parent), 1)
        return kept((own * np.log(ratio)).sum(-1), own.sum(-1), np.count_nonzero(own, -1), min_count)

    def smoothed(own, prior, node):
        kinds = np.maximum(1, np.count_nonzero(own, -1))[..., None]
        return np.where(node[..., None], (own + kinds * prior) / (own.sum(-1, keepdims=True) + kinds), prior)

    node_two = tested(two, one[None]) | reached.reshape(SYMBOLS, SYMBOLS)
    node_one = tested(one, none[None]) | node_two.any(0)
    root = (none + np.r_[0, np.full(SYMBOLS - 1, SYMBOLS / (SYMBOLS - 1))]) / (none.sum() + SYMBOLS)
    return smoothed(two, smoothed(one, root[None], node_one)[None], node_two).ravel()


def far_lookups(levels: list[Level]) -> list[tuple[Level, np.ndarray, Lookup, Lookup]]:
    """Each level with its kept contexts, and where these and its keys stand."""
    rows = [np.flatnonzero(level.node) for level in levels]
    return [(level, r, Lookup(level.contexts[r]), Lookup(level.keys)) for level, r in zip(levels, rows, strict=True)]


def far_probabilities(levels: list[tuple[Level, np.ndarray, Lookup, Lookup]], codes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``codes`` have a kept context over NEAR, and the probabilities of all
    in their longest kept suffix; ``p`` has those at NEAR."""
    far, p, live = np.zeros(len(codes), bool), p.copy(), np.arange(len(codes))
    for d, (level, rows, context_at, key_at) in enumerate(levels, NEAR + 1):
        at = context_at((codes[live] >> 6) & low(d))
        live, at = live[at >= 0], rows[at[at >= 0]]  # all suffixes of a kept context are kept
        where = key_at(codes[live] & low(d + 1))
        n = np.where(where >= 0, level.n[where], 0)
        p[live] = (n + level.kinds[at] * p[live]) / (level.total[at] + level.kinds[at])
        far[live] = True
    return far, p


def byte_shares(bytes_seen: DataFrame) -> np.ndarray:
    """log10 share of each byte in its class."""
    seen = np.zeros(256)
    for r in bytes_seen.collect():  # at most 256
        seen[r.key] = r.n
    usable = ~SPACE & (LOWERED == np.arange(256))
    seen = np.where(usable, seen + 0.5, 0)
    of_class = np.bincount(CLASSES, seen, SYMBOLS)
    return np.log10(np.where(usable, seen, 1) / np.where(usable, of_class[CLASSES], 1))


def bucket_of(code, buckets: int):
    """By the three symbols before the next one; for arrays."""
    return ((code >> 6) & low(NEAR + 1)) * 48271 % 2147483647 % buckets


def packed(codes: np.ndarray, width: int) -> np.ndarray:
    """(codes, width) low bytes."""
    return codes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<i8").ravel()


def joined(blobs: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.drop_null().to_pylist()), np.uint8).reshape(-1, width)


def score(docs: DataFrame, held_out_mod: int = 10, depth: int = 5, chunk_bytes: int = 6_000_000, min_count: int = 20) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) under the tree.

    Learns from rows whose crc32(doc_id as text) mod ``held_out_mod`` is not 0.
    Returns one row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-0.1 unigrams), score (log10 probability).
    Both scores are over the same tokens: the training ones, the end, and one
    that stands for any other word, of which the tree adds no more than the
    spelling at hand; so the probabilities of all tokens sum to one at most.
    A null or empty text has one token, its end. Equal rows get equal results;
    other columns are ignored; an empty table gives an empty result.

    Neither the corpus' word counts nor its tree are broadcast: documents are
    dealt into chunks of about ``chunk_bytes``, each chunk's distinct words and
    codes are joined with the counts and the buckets of the tree, and chunk and
    dictionary meet again in one task of bounded size.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", remainder(F.col("doc_id"), held_out_mod) == 0)
    train = docs.where(~F.col("held_out"))
    counts = materialize(word_counts(train), "words")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    seen = materialize(context_counts(train, depth), "contexts")
    log_byte = byte_shares(byte_counts(train))
    n_all, below = int(total.n), float(total.n + 0.1 * (total.v + 1))

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(64, int(size // chunk_bytes) + 1)
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    width, buckets = (6 * (depth + 1) + 7) // 8, max(64, chunks // 8, seen.count() // 500_000 + 1)
    codes = seen.withColumn("bucket", F.expr(f"int((shiftrightunsigned(key, 6) & {low(NEAR + 1)}) * 48271 % 2147483647 % {buckets})"))
    near = np.zeros(SYMBOLS ** (NEAR + 1))
    rows = seen.groupBy(F.col("key").bitwiseAND(low(NEAR + 1)).alias("key")).agg(F.sum("n").alias("n")).toPandas()  # bounded by the alphabet
    near[rows["key"].to_numpy(int)] = rows["n"].to_numpy(float)
    near_shared = spark.sparkContext.broadcast(near)

    def levels_of(codes: pa.Table) -> list[Level]:
        return far_levels(codes.column("key").to_numpy(), codes.column("n").to_numpy(), near_shared.value, depth, min_count)

    def reach(codes: pa.Table) -> pa.Table:
        first = levels_of(codes)[:1]
        found = np.unique(np.concatenate([np.zeros(0, np.int64), *(x.contexts[x.node] & low(NEAR) for x in first)]))
        return pa.table({"context": pa.array(found, pa.int64())})

    reached = np.zeros(SYMBOLS**NEAR, bool)
    for r in codes.groupBy("bucket").applyInArrow(reach, "context long").distinct().collect():  # bounded by the alphabet
        reached[r.context] = True
    near_p = spark.sparkContext.broadcast(near_distribution(near, reached, min_count))

    def ask(batches):
        asked: dict[int, list[np.ndarray]] = {}
        for piece in pieces(batches):
            stream, begin = symbol_stream(*column(piece.column("text")))
            for c, codes in by_chunk(context_codes(stream, begin, depth), piece.column("chunk").to_numpy(), np.diff(begin)):
                asked.setdefault(c, []).append(codes)
        for c, found in asked.items():
            code = distinct(np.concatenate(found))
            bucket = bucket_of(code, buckets)
            order = np.argsort(bucket, kind="stable")
            raw, edges = packed(code[order], width), np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            blobs = [raw[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][edges[:-1]], pa.int32()), pa.array(np.full(len(blobs), c, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "chunk", "codes"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        levels, chunk, out = far_lookups(levels_of(left)) if left.num_rows else [], [], []
        for c, blob in zip(right.column("chunk").to_pylist(), right.column("codes").to_pylist(), strict=True):
            code = unpacked(np.frombuffer(blob, np.uint8).reshape(-1, width))
            far, p = far_probabilities(levels, code, near_p.value[code & low(NEAR + 1)])
            if far.any():
                chunk.append(c)
                out.append(np.hstack([packed(code[far], width), np.log10(p[far]).astype("<f4").view(np.uint8).reshape(-1, 4)]).tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "spelled": pa.array(out, pa.binary())})

    asked = dealt.mapInArrow(ask, "bucket int, chunk int, codes binary")
    answers = codes.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, "chunk int, spelled binary")

    def ask_words(batches):
        tallies: dict[int, list[np.ndarray]] = {}
        for piece in pieces(batches):
            keys, first = word_keys(*column(piece.column("text")))
            for c, own in by_chunk(keys, piece.column("chunk").to_numpy(), np.diff(first)):
                tallies.setdefault(c, []).append(own)
        for c, found in tallies.items():
            keys = distinct(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys)], ["chunk", "key"])

    known = dealt.mapInArrow(ask_words, "chunk int, key long").join(counts, "key").select("chunk", "key", "n")
    known = known.unionByName(answers, allowMissingColumns=True)
    end_n = counts.where(F.col("key") == int(END_KEY)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = np.log10(0.1 / below)
    end_base = np.log10((end_n + 0.1) / below)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = joined(right.column("spelled"), width + 4)
        codes, log_p = unpacked(raw[:, :width]), raw[:, width:].copy().view("<f4").ravel()
        code_at, log_p = Lookup(codes), np.r_[log_p, np.float32(0)]
        log_near = np.log10(np.maximum(near_p.value, 1e-300)).astype(np.float32)

        def log_next(code):
            where = code_at(code)
            return np.where(where >= 0, log_p[where], log_near[code & low(NEAR + 1)])

        keys, n = (right.column(c).drop_null().to_numpy() for c in ("key", "n"))
        word_at, logs = Lookup(keys), np.r_[np.log10((n + 0.1) / below), floor]  # the last one for -1
        out = []
        for piece in pieces(left.to_batches()):
            data, at = column(piece.column("text"))
            own, first = word_keys(data, at)
            where = word_at(own)
            hit, word = where >= 0, logs[where]
            base = sums(word, first) + end_base
            spelled, end_spelled = token_scores(data, at, depth, log_next, log_byte)
            total = mixed(word, spelled, first, np.full(len(first) - 1, end_base), end_spelled)
            known = sums(hit.astype(np.int8), first).astype(np.int64) + (end_n > 0)
            out.append(pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(first) + 1), pa.array(known), pa.array(base), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.Table.from_batches([b.cast(schema) for b in out], schema)

    rated = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
