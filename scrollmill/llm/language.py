"""Language identification of whole texts and of the spans inside them.

The script of a word narrows its candidate languages to those whose training
letters use that script. Each candidate scores the word by its letter n-grams and
by the word itself; a Viterbi pass with a penalty for each change of language
labels the words, and runs of one label are the text's spans.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, remainder
from .textarrays import mix, pieces

#: First and last code points of scripts; letters elsewhere are of
#: one further script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
ORDERS = (1, 2, 3, 4)
#: Longer runs of letters (scripts without spaces) are cut into words of this size.
WORD_LETTERS = 24
#: Code points of a text that are decoded at a time.
BLOCK_CHARS = 1 << 18
#: Languages learned, the most frequent ones; it bounds the model.
MAX_LANGUAGES = 256
#: Text that is decoded together: many texts share each step of the Viterbi loop.
PIECE_BYTES = 1 << 21
_MADE = ["lang_pred", "lang_score", "lang_spans"]
SPANS = "array<struct<lang:string,start:long,end:long>>"


@lru_cache(maxsize=1)
def scripts_of_letters() -> np.ndarray:
    """For every code point: 0 if it is no letter, else 1 and up for its script."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    out = np.where(letter, len(SCRIPTS) + 1, 0).astype(np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            out[first : last + 1][letter[first : last + 1]] = i + 1
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lowered(points: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, Latin-1, basic Greek and basic Cyrillic, one for one."""
    p = points.copy()
    for first, last, by in ((0x41, 0x5A, 32), (0xC0, 0xDE, 32), (0x391, 0x3A9, 32), (0x410, 0x42F, 32), (0x400, 0x40F, 80)):
        p[(points >= first) & (points <= last) & (points != 0xD7)] += np.uint32(by)
    return p


def cut_words(script: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters of one script, at most WORD_LETTERS
    each, cut at the texts' borders."""
    if not len(script):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(script), bool)
    new[1:] = script[1:] != script[:-1]
    new[borders[borders < len(script)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(script))
    keep = script[starts] > 0
    starts, ends = starts[keep], ends[keep]
    parts = -(-(ends - starts) // WORD_LETTERS)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, stop = np.repeat(starts, parts) + nth * WORD_LETTERS, np.repeat(ends, parts)
        return begin, np.minimum(begin + WORD_LETTERS, stop)
    return starts, ends


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges one after another, and the range of each."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths), owner


def word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at, owner = spread(starts, ends - starts)
    salt = mix((at - starts[owner] + 1).astype(np.uint64)) | np.uint64(1)
    first = np.cumsum(ends - starts) - (ends - starts)
    return mix(np.add.reduceat(mix(points[at].astype(np.uint64) + np.uint64(7)) * salt, first)) if len(starts) else np.zeros(0, np.uint64)


def features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, log2_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram of the words, borders included, and of the
    words themselves; orders have buckets of their own."""
    n = ends - starts
    framed = np.zeros(int((n + 2).sum()), np.uint64)
    first = np.cumsum(n + 2) - (n + 2)
    at, owner = spread(starts, n)
    framed[at - starts[owner] + first[owner] + 1] = points[at] + np.uint64(1)
    owner = np.repeat(np.arange(len(n)), n + 2)
    inside = np.arange(len(framed)) - first[owner]
    found, words, h = [], [], np.zeros(len(framed), np.uint64)
    size = np.uint64((1 << log2_buckets) - 1)
    for k in ORDERS:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h[: len(h) - k + 1] += framed[k - 1 :]
        ok = inside + k <= (n + 2)[owner]
        if k == 1:
            ok &= framed > 0
        found.append((mix(h[ok] + np.uint64(k << 60)) & size).astype(np.int64) * (len(ORDERS) + 1) + k - 1)
        words.append(owner[ok])
    found.append((word_hashes(points, starts, ends) & size).astype(np.int64) * (len(ORDERS) + 1) + len(ORDERS))
    words.append(np.arange(len(n)))
    return np.concatenate(found), np.concatenate(words)


def unique_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, an index of one of each, and each word's."""
    return np.unique(word_hashes(points, starts, ends), return_index=True, return_inverse=True)


def training_rows(docs: DataFrame, max_train_rows: int) -> DataFrame:
    """(lang, text) of about ``max_train_rows`` rows of each language at most.

    Rows with a null text or lang, or whose crc32 of the id mod 3 is 1, never
    enter. A row is in by the hash of its id and text, so the choice needs no
    shuffle of texts and is the same on every run; equal rows count once.
    """
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    own = own.withColumn("key", F.xxhash64("doc_id", "text"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    chosen = own.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 40)) < F.lit(float(max_train_rows) * (1 << 40)) / F.col("n"))
    return materialize(chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text"), "language-train")


class Model:
    """Weights of n-grams and words for each language, and its scripts."""

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: np.ndarray, prior: np.ndarray, log2_buckets: int):
        self.languages, self.weights, self.scripts, self.prior, self.log2_buckets = languages, weights, scripts, prior, log2_buckets


def learn(docs: DataFrame, max_train_rows: int = 4000, log2_buckets: int = 16) -> Model | None:
    """The model of a bounded sample; None without training rows.

    Spark counts hashed features by language; the driver gets one count for each
    of at most (orders + 1) * 2**log2_buckets features of each language.
    """
    train = training_rows(docs, max_train_rows)

    def count(batches):
        table = scripts_of_letters()
        total: dict[str, list[np.ndarray]] = {}
        size = (len(ORDERS) + 1) << log2_buckets
        for piece in pieces(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                sums = total.setdefault(lang, [np.zeros(size, np.int64), np.zeros(len(SCRIPTS) + 2, np.int64)])
                for i in range(0, len(text), BLOCK_CHARS):
                    points = lowered(code_points(text[i : i + BLOCK_CHARS]))
                    script = table[points]
                    starts, ends = cut_words(script, np.zeros(0, np.int64))
                    sums[0] += np.bincount(features(points, starts, ends, log2_buckets)[0], minlength=size)
                    sums[1] += np.bincount(script, minlength=len(SCRIPTS) + 2)
        for lang, (grams, letters) in total.items():
            at = np.flatnonzero(grams)
            found = np.concatenate([at, -1 - np.arange(1, len(letters))])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(np.concatenate([grams[at], letters[1:]]), pa.int64())], ["lang", "feature", "n"])

    counted = materialize(train.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "language-counts")
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return None
    size, at = (len(ORDERS) + 1) << log2_buckets, {x: i for i, x in enumerate(languages)}
    grams, letters = np.zeros((size, len(languages))), np.zeros((len(SCRIPTS) + 2, len(languages)))
    for lang in languages:  # one language at a time
        found = counted.where(F.col("lang") == lang).select("feature", "n").toArrow()
        feature, n = (found.column(c).to_numpy() for c in ("feature", "n"))
        grams[feature[feature >= 0], at[lang]] = n[feature >= 0]
        letters[-1 - feature[feature < 0], at[lang]] = n[feature < 0]
    weights = np.zeros((size, len(languages)), np.float32)
    for k in range(len(ORDERS) + 1):
        own = grams[k :: len(ORDERS) + 1]
        seen = max(1, int((own.sum(1) > 0).sum()))
        p = np.log((own + 0.5) / (own.sum(0) + 0.5 * seen))
        weights[k :: len(ORDERS) + 1] = np.where(own.sum(1, keepdims=True) > 0, p - p.mean(1, keepdims=True), 0.0)
    share = letters / np.maximum(letters.sum(0), 1)
    prior = np.log(np.maximum(letters.sum(0), 1) / max(1.0, letters.sum()))
    return Model(languages, weights, share >= 0.005, prior, log2_buckets)


class Scorer:
    """Scores of words under a model; equal words of a piece are scored once."""

    def __init__(self, model: Model, reach: float = 8.0):
        self.model, self.reach = model, reach

    def fresh(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        feature, word = features(points, starts, ends, self.model.log2_buckets)
        order = np.argsort(word, kind="stable")
        first = np.searchsorted(word[order], np.arange(len(starts)))
        total = np.add.reduceat(self.model.weights[feature[order]], first).astype(float)
        # N-grams overlap: their mean over the orders counts, and no word decides alone.
        total /= len(ORDERS) + 1
        return np.maximum(total - total.max(1, keepdims=True), -self.reach)

    def __call__(self, points: np.ndarray, script: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(words, languages): at most 0; -inf for no candidate, and a row of zeros
        where no language is one."""
        if not len(starts):
            return np.zeros((0, len(self.model.languages)))
        _, sample, owner = unique_words(points, starts, ends)
        scores = self.fresh(points, starts[sample], ends[sample])
        candidate = self.model.scripts[script[starts[sample]]]
        scores[~candidate] = -np.inf
        best = scores.max(1, keepdims=True)
        scores = np.where(np.isfinite(best), scores - np.where(np.isfinite(best), best, 0), 0.0)
        return scores[owner]


def viterbi(scores: np.ndarray, first: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word of many texts at once.

    Text i owns scores[first[i]:first[i + 1]] and starts from begin[i]; a change of
    label costs ``penalty``. All texts step together, longest first, so the work
    is proportional to the words and the loop to the longest text.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at, length = first[:-1][order], n[order]
    labels = np.zeros(len(scores), np.int32)
    came = np.zeros(scores.shape, bool)  # whether the best way to a label stays
    tops = np.zeros(len(scores), np.int32)
    value, live = begin[order].copy(), len(order)
    for t in range(int(length[0]) if len(length) else 0):
        while live and length[live - 1] <= t:
            live -= 1
        v, i = value[:live], at[:live] + t
        top = v.argmax(1)
        changed = v[np.arange(live), top] - penalty
        stays = v >= changed[:, None]
        came[i], tops[i] = stays, top
        v[...] = np.where(stays, v, changed[:, None]) + scores[i]
        v -= v.max(1, keepdims=True)
    last = value.argmax(1).astype(np.int32)
    for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
        live = np.searchsorted(-length, -t, "left")
        i = at[:live] + t
        labels[i] = last[:live]
        last[:live] = np.where(came[i, last[:live]], last[:live], tops[i])
    return labels


def decode(texts: list[str | None], model: Model, scorer: Scorer, penalty: float):
    """(lang, score, spans) of each text."""
    table, k = scripts_of_letters(), len(model.languages)
    letters = np.zeros((len(texts), k + 1))  # by label; the last: no candidate
    spans: list[list] = [[] for _ in texts]
    begin = np.tile(model.prior, (len(texts), 1))
    todo = [(i, 0) for i, t in enumerate(texts) if t]
    while todo:
        parts = [texts[i][a : a + BLOCK_CHARS] for i, a in todo]
        raw = code_points("".join(parts))
        borders = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        script = table[raw]
        starts, ends = cut_words(script, borders)
        first = np.searchsorted(starts, borders)
        scores = scorer(lowered(raw), script, starts, ends)
        own = np.array([i for i, _ in todo])
        labels = viterbi(scores, first, begin[own], penalty)
        size = (ends - starts).astype(float)
        lost = ~model.scripts[script[starts]].any(1) if len(starts) else np.zeros(0, bool)
        shown = np.where(lost, k, labels)
        owner = np.repeat(own, np.diff(first))
        np.add.at(letters, (owner, shown), size)
        new = np.ones(len(shown), bool)
        new[1:] = (shown[1:] != shown[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        offset = np.repeat(np.array([a for _, a in todo]) - borders[:-1], np.diff(first))
        for h, stop in zip(heads.tolist(), np.append(heads[1:], len(shown))[: len(heads)].tolist(), strict=True):
            lang, a, b = int(shown[h]), int(starts[h] + offset[h]), int(ends[stop - 1] + offset[h])
            before = spans[owner[h]]
            if before and before[-1][0] == lang:
                before[-1][2] = b
            else:
                before.append([lang, a, b])
        nxt = []
        for j, (i, a) in enumerate(todo):
            if a + BLOCK_CHARS < len(texts[i]):
                nxt.append((i, a + BLOCK_CHARS))
                if first[j + 1] > first[j]:
                    begin[i] = np.where(np.arange(k) == labels[first[j + 1] - 1], 0.0, -penalty)
        todo = nxt
    for i, found in enumerate(spans):
        named = letters[i, :k]
        total = letters[i].sum()
        if not total:
            yield "und", 0.0, []
            continue
        # Without any candidate the most frequent language is named, without confidence.
        best = int(named.argmax()) if named.any() else int(model.prior.argmax())
        yield model.languages[best], float(named[best] / total), [(model.languages[s[0]] if s[0] < k else "und", s[1], s[2]) for s in found]


def identify(docs: DataFrame, model: Model | None, penalty: float = 4.0) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, lang_score and lang_spans.

    ``lang_pred`` is the language of most of the text's letters, its score their
    share (ties: the first by name); a span is (lang, start, end) in code points,
    from its first to after its last word. A null text, or one without a letter,
    is ``und`` with score 0 and no spans; words of a script that no learned
    language uses are spans of ``und``, and a text of only such words is named by
    the most frequent language, with score 0. Without a model all is ``und``. Long
    texts are decoded in blocks of BLOCK_CHARS, each going on from the language in
    which the one before ended. Repeated rows score alike; an empty table gives an
    empty result; columns of these three names are replaced, any other may occur.
    """
    docs = docs.drop(*_MADE)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_spans": F.expr(f"cast(array() as {SPANS})")})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES and the buckets
    kinds = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    # A row rides along as one struct: no name in it can clash with another.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")

    def run(batches):
        known = shared.value
        scorer = Scorer(known)
        for piece in pieces(batches, limit=PIECE_BYTES):
            found = list(decode(piece.column("text").to_pylist(), known, scorer, penalty))
            spans = pa.array([[dict(zip(("lang", "start", "end"), s, strict=True)) for s in x[2]] for x in found], kinds)
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], ["row", *_MADE])

    more = T.StructType.fromDDL(f"lang_pred string, lang_score double, lang_spans {SPANS}")
    return whole.mapInArrow(run, T.StructType([whole.schema["row"], *more.fields])).select("row.*", *_MADE)


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the training rows of ``docs`` (doc_id, text, lang) and label all."""
    own: list[Column] = [F.col("doc_id"), F.col("text")]
    return identify(docs.select(*own), learn(docs))
