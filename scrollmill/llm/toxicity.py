"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

The features are densities in the whole text: words of a lexicon learned from
the training labels (whole words and stems that words begin with, as insults are inflected
and compounded), the same words in disguise (digits and marks for letters), how near they stand to second-person words, capitals and punctuation.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, labelled_sample, materialize
from .textarrays import LOWERED, SPACE, column, pieces, RangeHashes, range_hashes, sums, words

#: Words that address the reader, in four languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes ti tus su".split()

#: Common insults in four languages, to which labels add their own.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool foolish loser losers pathetic worthless scum disgusting trash garbage clown clowns jerk creep "
    "liar ugly vermin filth imbecile cretin degenerate parasite coward disgrace hate despise "
    "idiote imbécile crétin débile ordure minable pourriture abruti dummkopf trottel abschaum versager widerlich erbärmlich müll "
    "estúpido imbécil basura escoria patético asqueroso inútil payaso"
).split()

FEATURES = ["lexicon", "lexicon_log", "stems", "stems_log", "disguised", "disguised_log", "second_person", "near", "capitals", "shouted", "exclaimed", "marks", "digits", "word_length", "words_log"]
_COLUMNS = [f"__tox_{f}" for f in FEATURES]
_NEAR = 5
_LOWER = str.maketrans(UPPER, LOWER)
#: Lengths of stems in characters.
STEMS = range(3, 9)


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[97:123] = out[65:91] = out[128:] = True
    return out


LETTERS = _letters()
#: Signs commonly written for letters.
LEET = LOWERED.copy()
LEET[[ord(c) for c in "013457@$"]] = [ord(c) for c in "oieastas"]


def word_set_hashes(found: list[str]) -> np.ndarray:
    encoded = [w.encode() for w in found]
    ends = np.cumsum([len(w) for w in encoded]).astype(np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    return np.sort(range_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)) if encoded else np.zeros(0, np.uint64)


def _member(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(h), bool)
    return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h


def feature_rows(data: np.ndarray, at: np.ndarray, lexicon: np.ndarray, stems: np.ndarray, second: np.ndarray) -> np.ndarray:
    """(texts, features): the dense features of each text."""
    starts, ends, first = words(data, at, ~SPACE[data])
    n_words, n_bytes = np.maximum(np.diff(first), 1), np.maximum(np.diff(at), 1)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(first))
    letter, low = LETTERS[data], LOWERED[data]
    runs, stops, run_first = words(data, at, letter)
    hashed = RangeHashes(low)
    h = hashed(runs, stops)
    plain, spoken = _member(h, lexicon), _member(h, second)
    # Words that begin with a stem: the ends of their first characters, by length.
    leads = (data & 0xC0) != 0x80
    lead_at = np.append(np.flatnonzero(leads), [len(data)] * (max(STEMS) + 1))
    nth = np.cumsum(leads)[runs] - 1 if len(runs) else runs
    stemmed = np.zeros(len(runs), bool)
    for k in STEMS if len(stems) else ():
        stop = lead_at[nth + k]
        i = np.flatnonzero(stop <= stops)
        stemmed[i] |= _member(hashed(runs[i], stop[i]), stems)
    # Disguises: every word with its signs turned into letters and the rest dropped.
    turned = LEET[data]
    kept = LETTERS[turned]
    place = np.concatenate([[0], np.cumsum(kept)])
    disguised = _member(range_hashes(turned[kept], place[starts], place[ends]), lexicon)
    marked = np.concatenate([[0], np.cumsum(~letter)])
    inner_end = np.maximum(ends - 1, starts)  # a mark at the end alone is punctuation
    disguised &= marked[inner_end] > marked[starts]
    # Of the lexicon's words, the share with a second-person word within five runs.
    upto = np.concatenate([[0], np.cumsum(spoken)])
    run_text = np.repeat(np.arange(len(at) - 1), np.diff(run_first))
    i = np.flatnonzero(plain)
    lo, hi = np.maximum(i - _NEAR, run_first[run_text[i]]), np.minimum(i + _NEAR + 1, run_first[run_text[i] + 1])
    near = np.zeros(len(h))
    near[i] = upto[hi] > upto[lo]
    upper = (data >= 65) & (data <= 90)
    upper_upto = np.concatenate([[0], np.cumsum(upper)])
    shouted = (upper_upto[stops] - upper_upto[runs] == stops - runs) & (stops - runs > 2)
    begun = sums(stemmed, run_first)
    hits, hidden = sums(plain, run_first), np.bincount(text_of[disguised], minlength=len(at) - 1)
    rate = lambda mask: sums(mask, at) / n_bytes
    return np.stack([
        hits / n_words, np.log1p(hits), begun / n_words, np.log1p(begun), hidden / n_words, np.log1p(hidden), sums(spoken, run_first) / n_words,
        sums(near, run_first) / np.maximum(hits, 1), rate(upper), sums(shouted, run_first) / n_words, rate(data == 33),
        rate((data < 128) & ~letter & ~SPACE[data] & ~((data >= 48) & (data <= 57)) & (data != 33)),
        rate((data >= 48) & (data <= 57)), sums(ends - starts, first) / n_words, np.log1p(np.diff(first)),
    ], 1)


def learn_lexicon(sample: DataFrame, min_docs: int = 5, least_rate: float = 0.004) -> tuple[list[str], list[str]]:
    """Words and stems significantly more often frequent in toxic texts.

    A text counts for a word or stem if that makes up ``least_rate`` of its
    words. Score: log-odds with add-half smoothing over their standard error, at
    least 4, and three of five such texts toxic. ``sample`` is bounded, and so is
    what is collected: a word needs ``min_docs`` of its texts, and a text holds at
    most 1 / ``least_rate`` such words.
    """
    letters = re.compile(r"[a-z\x80-\U0010ffff]+")

    def run(batches):
        for piece in pieces(batches):
            for t, y in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist(), strict=True):
                n = Counter(letters.findall(t.translate(_LOWER)))
                least, found = least_rate * n.total(), Counter()
                for w, c in n.items():
                    if len(w) > 2:
                        found[w, False] += c
                        for k in STEMS:
                            if k <= len(w):
                                found[w[:k], True] += c
                kept = [x for x, c in found.items() if c >= least]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.bool_()), pa.array([y] * len(kept), pa.float64())], ["word", "stem", "label"])

    n = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("all")).first()
    if not n["all"] or not n["toxic"]:
        return [], []
    counted = sample.select("text", "label").mapInArrow(run, "word string, stem boolean, label double").groupBy("word", "stem").agg(F.sum("label").alias("a"), F.count("*").alias("c"))
    a, b = F.col("a"), F.col("c") - F.col("a")
    odds = F.log((a + 0.5) / (n["toxic"] - a + 0.5)) - F.log((b + 0.5) / (n["all"] - n["toxic"] - b + 0.5))
    error = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    scored = counted.where((a >= min_docs) & (a >= 1.5 * b)).select("word", "stem", (odds / error).alias("z")).where("z >= 4")
    return tuple([r.word for r in scored.where(kind).orderBy("word").collect()] for kind in (~F.col("stem"), F.col("stem")))


def with_features(df: DataFrame, lexicon: list[str], stems: list[str]) -> DataFrame:
    """All columns of ``df`` and one column for each feature of its text."""
    known, begun, second = word_set_hashes(lexicon), word_set_hashes(stems), word_set_hashes(SECOND_PERSON)
    names = df.columns

    def run(batches):
        for piece in pieces(batches):
            x = feature_rows(*column(piece.column("text")), known, begun, second)
            yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(c) for c in x.T)], [*names, *_COLUMNS])

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in _COLUMNS)])
    return df.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, max_train_rows: int = 10_000, max_train_bytes: int = 1 << 25, max_train_text: int = 1 << 18, trees: int = 15, depth: int = 3) -> DataFrame:
    """All columns of ``docs`` plus ``toxicity``, a calibrated probability.

    Lexicon and trees learn from three quarters of a bounded sample of
    ``max_train_rows`` labelled rows (``max_train_bytes`` of text together, texts up
    to ``max_train_text`` bytes each), the isotonic calibration from the rest, which
    neither has seen; with fewer than ten rows of a label in that rest, from all; held-out rows (crc32 of the id mod 5 is 0) take no
    part. Null and empty texts have zero features and the score that follows;
    repeated rows score alike; a very long text is one piece of its task. Without
    labels of both kinds every row scores the share of toxic labels (0 if there
    are none). A column ``toxicity`` of the caller's is replaced, any other name
    may occur; an empty table gives an empty result.
    """
    docs = docs.drop("toxicity")
    sample = materialize(labelled_sample(docs, labels, "toxic", max_train_rows, max_train_bytes, max_train_text), "toxic-sample")
    calibration = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    kinds = {(r.c, r.label): r["count"] for r in sample.groupBy(calibration.alias("c"), "label").count().collect()}
    if any(not kinds.get((False, y)) for y in (0.0, 1.0)):
        total = sum(kinds.values())
        share = sum(n for (_, y), n in kinds.items() if y == 1) / total if total else 0.0
        return docs.withColumn("toxicity", F.lit(float(share)))
    learned, stems = learn_lexicon(sample.where(~calibration))
    lexicon = sorted({*INSULTS, *learned})
    assembler = VectorAssembler(inputCols=_COLUMNS, outputCol="__tox_x")
    train = materialize(with_features(sample, lexicon, stems).drop("text").coalesce(4), "toxic-train")
    fit = assembler.transform(train)
    boosted = GBTClassifier(featuresCol="__tox_x", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=7).fit(fit.where(~calibration))
    margin = vector_to_array("probability")[1]
    # With too few rows to split off, the calibration learns from all of them.
    enough = all(kinds.get((True, y), 0) >= 10 for y in (0.0, 1.0))
    held = boosted.transform(fit.where(calibration) if enough else fit).select("label", margin.alias("__tox_m"))
    isotonic = IsotonicRegression(featuresCol="__tox_m", labelCol="label", predictionCol="toxicity").fit(held.coalesce(1))
    # The row rides along as one struct: no column of it can clash with a model's.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__tox_row"), "text")
    rows = with_features(whole, lexicon, stems).drop("text")
    scored = isotonic.transform(boosted.transform(assembler.transform(rows)).select("__tox_row", margin.alias("__tox_m")))
    return scored.select("__tox_row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "toxicity")).alias("toxicity"))
