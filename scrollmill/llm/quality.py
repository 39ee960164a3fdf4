"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from dense features of
its characters and from hashed counts of its words and word pairs; gated attention says how much each passage weighs, and the weighted sum is
scored. Only document labels are needed: the weights learn where quality shows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample
from .textarrays import LOWERED, SPACE, column, mix, pieces, range_hashes, sums, words

PASSAGE_WORDS, HIDDEN, GATE, HASHED = 64, 16, 8, 32


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of 64 words, and where each text's begin.

    A text without words is one passage of zeros.
    """
    starts, ends, first = words(data, at, ~SPACE[data])
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE_WORDS))
    begin = np.concatenate([[0], np.cumsum(count)])
    text_of = np.repeat(np.arange(len(n)), count)
    nth = np.arange(begin[-1]) - begin[text_of]
    word_at = np.minimum(first[text_of] + nth * PASSAGE_WORDS, first[text_of + 1])
    word_at = np.append(word_at, first[-1])
    size = np.maximum(np.diff(word_at), 1)
    first_byte = np.append(starts, len(data))
    byte_at = np.where(nth == 0, at[text_of], first_byte[word_at[:-1]])
    byte_at = np.append(byte_at, len(data))
    n_bytes = np.maximum(np.diff(byte_at), 1)
    rate = lambda mask: sums(mask, byte_at) / n_bytes
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    common = np.isin(data, np.frombuffer(b".,;:?'\"-()", np.uint8))
    other = (data < 128) & ~upper & ~lower & ~digit & ~common & ~SPACE[data]
    h = range_hashes(LOWERED[data], starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    passage_of = np.repeat(np.arange(begin[-1]), np.diff(word_at))
    keyed = h ^ (passage_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    distinct = np.bincount(passage_of[order][new], minlength=begin[-1])
    length = ends - starts
    mean = sums(length, word_at) / size
    marked = other[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, bool)
    x = np.stack([
        rate(upper), rate(lower), rate(digit), rate(data == 33), rate(data == 124), rate(common), rate(other), rate(data >= 128), rate(data == 10),
        mean / 10, np.sqrt(np.maximum(sums(length.astype(float) ** 2, word_at) / size - mean**2, 0)) / 10,
        distinct / size, sums(same, word_at) / size, sums(marked, word_at) / size, np.log1p(np.diff(word_at)) / 4,
    ], 1)
    # Words and pairs of words by hash: what the passage says, not only its shape.
    follows = np.zeros(len(h), bool)
    follows[1:] = passage_of[1:] == passage_of[:-1]
    pairs = mix(h[1:] * np.uint64(0x100000001B3) + h[:-1])[follows[1:]]
    shift = np.uint64(64 - HASHED.bit_length() + 1)
    counted = [np.bincount(of * HASHED + (k >> shift).astype(np.int64), minlength=begin[-1] * HASHED).reshape(-1, HASHED) for of, k in ((passage_of, h), (passage_of[1:][follows[1:]], pairs))]
    return np.hstack([x, *(np.sqrt(c / size[:, None]) for c in counted)]), begin


class AttentionModel:
    """Encoder, gated attention and scorer; trained by Adam on whole bags."""

    def __init__(self, n: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        w = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.p = {"W": w(n, HIDDEN), "b": np.zeros(HIDDEN), "V": w(HIDDEN, GATE), "U": w(HIDDEN, GATE), "a": w(GATE), "c": w(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple:
        p, bag = self.p, np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
        weight = e / np.add.reduceat(e, begin[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, begin[:-1], 0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, bag, h, t, g, weight, z, y

    def fit(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        share = np.clip(label.mean(), 0.01, 0.99)
        self.p["d"][:] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, epochs + 1):
            xs, bag, h, t, g, weight, z, y = self.forward(x, begin)
            p, dy = self.p, (y - label) / len(label)
            dz = dy[:, None] * p["c"]
            dw = (dz[bag] * h).sum(1)
            de = weight * (dw - np.add.reduceat(weight * dw, begin[:-1])[bag])
            dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
            dh = weight[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
            da = dh * (1 - h**2)
            grad = {"W": xs.T @ da, "b": da.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}
            for k, d in grad.items():
                d = d + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)[-1]


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int, max_train_bytes: int = 1 << 25, max_train_text: int = 1 << 18) -> AttentionModel:
    """Fit on passage features of a sample that ``max_train_rows`` bounds."""

    def run(batches):
        for piece in pieces(batches):
            x, begin = passages(*column(piece.column("text")))
            bags = [x[i:j].ravel() for i, j in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(bags, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, "quality", max_train_rows, max_train_bytes, max_train_text)
    rows = sample.mapInArrow(run, "doc_id long, label double, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    width = passages(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    model = AttentionModel(width)
    if rows.num_rows:
        bags = rows.column("x").combine_chunks()
        x = bags.flatten().to_numpy().reshape(-1, width)
        begin = np.concatenate([[0], np.cumsum(bags.value_lengths().to_numpy() // width)])
        model.fit(x, begin, rows.column("label").to_numpy())
    return model


def score(docs: DataFrame, labels: DataFrame, max_train_rows: int = 5_000, max_train_bytes: int = 1 << 25, max_train_text: int = 1 << 18) -> DataFrame:
    """All columns of ``docs`` plus ``quality``: the probability of label 1.

    Held-out rows (crc32 of the id mod 5 is 0) are never learned from, and at most
    ``max_train_bytes`` of text of texts up to ``max_train_text`` bytes is. Null and
    empty texts are one passage without features; repeated rows score alike; a
    very long text is one piece of its task. Without labels the untrained model's
    scores are near one half. A column ``quality`` of the caller's is replaced,
    any other name may occur; an empty table gives an empty result. Work is one
    pass in pieces, no shuffle.
    """
    docs = docs.drop("quality")
    model = train(docs, labels, max_train_rows, max_train_bytes, max_train_text)
    # The row rides along as one struct, whatever its columns are called.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")

    def run(batches):
        for piece in pieces(batches):
            y = model.scores(*passages(*column(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(y)], ["row", "quality"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("quality", T.DoubleType())])).select("row.*", "quality")
