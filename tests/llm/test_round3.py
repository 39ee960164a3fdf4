"""The filter audit, whitening and language identification against plain versions."""

import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrollmill.llm import audit, common, decontaminate, language, minhash, whitening

SF = "/root/testdata/sf0.001"

# Whitening ------------------------------------------------------------------


def plain_whitening(rows):
    """Exact integers and fractions; eigenvectors of the exactly rounded matrix."""
    good = {i: v for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    d = max(len(v) for v in good.values())
    x = {i: [int(np.floor(1024 * float(c))) + 100000 for c in v] for i, v in good.items() if len(v) == d}
    n, s = len(x), [sum(c) for c in zip(*x.values())]
    y = {i: [n * c - t for c, t in zip(v, s)] for i, v in x.items()}
    cov = np.array([[float(Fraction(sum(v[a] * v[b] for v in y.values()), n**3)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    w = {i: np.array([c / n for c in v]) @ u / np.sqrt(e) for i, v in y.items()}
    return n, {i: sum(c * c for c in v) for i, v in y.items()}, w, e / np.trace(cov)


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12)) * np.linspace(1, 0.05, 12) + 1000.0
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(100, None), (101, [1.0, None] + [0.0] * 10), (102, [float("nan")] * 12), (103, [float("inf")] + [0.0] * 11), (104, [1.0]), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).repartition(5)
    got = whitening.whiten(df).collect()
    n, dev, w, share = plain_whitening(rows)
    assert {r.vec_id for r in got} == set(w) and len(got) == 8 * n and {r.n for r in got} == {n}
    assert {r.vec_id: r.deviation for r in got} == dev
    assert max(r.identity_error for r in got) < 1e-9
    at = {(r.vec_id, r.component): r for r in got}
    for c in range(8):
        assert at[0, c + 1].explained == pytest.approx(share[c], rel=1e-9)
        sign = np.sign(at[0, c + 1].whitened * w[0][c])
        assert all(at[i, c + 1].whitened * sign == pytest.approx(v[c], rel=1e-6, abs=1e-9) for i, v in w.items())


def test_whitening_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kinds)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kinds)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kinds)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 5.0]), (2, [2.0, 5.0]), (2, [2.0, 5.0])], kinds)).collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], kinds)).collect()
    assert {r.deviation for r in huge} == {None}


def test_pairs_of_doubles_keep_what_doubles_lose():
    a = np.array([1e16, 1.0, -1e16, 2.0**-30])[:, None, None]
    high, low = whitening.fold(a, np.zeros_like(a))
    assert Fraction(float(high[0, 0])) + Fraction(float(low[0, 0])) == 1 + Fraction(1, 2**30)
    p, e = whitening.two_product(1 + 2.0**-40, 1 - 2.0**-41)
    assert Fraction(p) + Fraction(e) == (1 + Fraction(1, 2**40)) * (1 - Fraction(1, 2**41))


# Filter audit ---------------------------------------------------------------

CASES = [
    (1, "a b c", "s"), (2, "a b c", None), (None, "a b c", "s"), (2, "a b c", "s"), (5, None, "s"), (6, "", ""), (7, "word " * 300, "s"),
    (8, " ".join(f"w{i}" for i in range(250)), "s"), (9, " ".join(f"w{i}" for i in range(250)), "t"), (10, "ABC def #", "t"), (11, "x" * 70 + "y", "t"), (12, "x" * 70 + "z", "t"), (13, "é b\x1fc", "t"),
]


def odd_tables(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(1)).withColumn("live", F.lit(None).cast("int"))
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 1), (9, 0, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_audit_against_sql_on_odd_tables(spark):
    import duckdb

    docs, labels = odd_tables(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "toxic": "Int64"}))
    ours, theirs = audit.audit(docs, labels), con.sql(audit.SQL)
    assert sorted(tuple(r) for r in ours.collect()) == sorted(theirs.fetchall())
    assert ours.count() == 600 * 3 and audit.audit(docs.limit(0), labels).count() == 0


def test_audit_starts_again_when_unlike_texts_share_a_class(spark, monkeypatch):
    docs, labels = odd_tables(spark)
    right = sorted(tuple(r) for r in audit.masks(docs).collect() if r.doc_id is not None)
    real, seeds = audit.keyed, []

    def weak(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found if seed else found.withColumns({level: F.lit(1).cast("long") for level in audit.LEVELS[1:]})

    monkeypatch.setattr(audit, "keyed", weak)
    assert sorted(tuple(r) for r in audit.masks(docs).collect() if r.doc_id is not None) == right and seeds == [0, 1]


def test_a_small_bitmap_costs_work_and_no_result(spark):
    docs, _ = odd_tables(spark)
    for bits in (3, 15, 20):
        rows, copies = audit.duplicates(docs, log2_bits=bits)
        assert sorted(r.least for r in copies.collect() if r.least) == [1, 5, 8] and rows.count() == len(CASES)

# Language identification ----------------------------------------------------


def plain_viterbi(scores, begin, penalty):
    value, back = list(begin), []
    for row in scores:
        best = [max(range(len(value)), key=lambda j: value[j] - penalty * (j != i) + 1e-12 * (j == i)) for i in range(len(value))]
        value = [value[j] - penalty * (j != i) + row[i] for i, j in enumerate(best)]
        back.append(best)
    out = [max(range(len(value)), key=value.__getitem__)]
    for best in reversed(back[1:]):
        out.append(best[out[-1]])
    return out[::-1]


def test_viterbi_of_many_texts_is_that_of_each():
    rng = np.random.default_rng(1)
    lengths = [0, 3, 40, 1, 17, 0, 40]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores, begin = -rng.exponential(2, (first[-1], 4)), -rng.exponential(1, (len(lengths), 4))
    labels = language.viterbi(scores, first, begin, 3.0)
    for i, n in enumerate(lengths):
        if n:
            assert labels[first[i] : first[i + 1]].tolist() == plain_viterbi(scores[first[i] : first[i + 1]], begin[i], 3.0)


def test_words_are_scored_by_their_ngrams_alone():
    text = "Straße ÉTÉ naïve straße été"
    points = language.lowered(language.code_points(text))
    starts, ends = language.cut_words(language.scripts_of_letters()[points], np.zeros(0, np.int64))
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    h = language.word_hashes(points, starts, ends)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    feature, word = language.features(points, starts, ends, 16)
    each = [Counter(feature[word == i].tolist()) for i in range(5)]
    n = len("straße")
    assert each[0] == each[3] and each[1] == each[4] and sum(each[0].values()) == n + (n + 1) + n + (n - 1) + 1


@pytest.fixture(scope="module")
def tongues(spark):
    words = {"en": "the cat and dog with house that", "fr": "le chat et chien avec maison une", "ru": "и кот в доме это собака"}
    rows, rng = [], np.random.default_rng(5)
    for i in range(150):
        lang = list(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), 20)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), words


def test_languages_of_odd_texts_and_spans(spark, tongues, monkeypatch):
    docs, words = tongues
    model = language.learn(docs)
    en, fr, ru = (" ".join([words[x]] * 3) for x in ("en", "fr", "ru"))
    cases = [None, "", " 12 §% ", en, fr + " ... " + en, ru, "汉字", en + " 汉字", "THE CAT", ("the cat " * 40_000) + "le chat avec une maison", en, en]
    odd = spark.createDataFrame([(i if i < 10 else 10, t, "x") for i, t in enumerate(cases)] + [(None, ru, None)], "doc_id long, text string, lang_pred string").withColumn("a.b", F.lit(1))
    found = language.identify(odd, model)
    assert found.columns == ["doc_id", "text", "a.b", "lang_pred", "lang_score", "lang_spans"]
    got = {(r.doc_id, r.text): r for r in found.collect()}
    at = lambda i: got[i, cases[i]]
    assert [(at(i).lang_pred, at(i).lang_score, at(i).lang_spans) for i in range(3)] == [("und", 0.0, [])] * 3
    assert [at(i).lang_pred for i in (3, 5, 8, 9)] == ["en", "ru", "en", "en"] and got[None, ru].lang_pred == "ru"
    assert [(s.lang, s.start, s.end) for s in at(4).lang_spans] == [("fr", 0, len(fr)), ("en", len(fr) + 5, len(cases[4]))]
    assert at(6).lang_pred in words and at(6).lang_score == 0 and [s.lang for s in at(6).lang_spans] == ["und"]
    assert [s.lang for s in at(7).lang_spans] == ["en", "und"] and 0 < at(7).lang_score < 1
    assert [s.lang for s in at(9).lang_spans] == ["en", "fr"] and at(9).lang_spans[1].end == len(cases[9])
    assert language.identify(odd.limit(0), model).count() == 0 and {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.learn(docs.where("lang is null")) is None


def test_long_texts_decode_the_same_in_blocks(spark, tongues, monkeypatch):
    docs, words = tongues
    model = language.learn(docs)
    text = " ".join([words["en"]] * 9 + [words["fr"]] * 9 + [words["ru"]] * 5)
    whole = list(language.decode([text, None, words["fr"]], model, language.Scorer(model), 4.0))
    monkeypatch.setattr(language, "BLOCK_CHARS", len(words["en"]) * 3 + 3)
    assert list(language.decode([text, None, words["fr"]], model, language.Scorer(model), 4.0)) == whole


def test_held_out_accuracy_and_no_look_at_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    found = {r.doc_id: r.lang_pred for r in language.predict(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(found[r.doc_id] == r.lang for r in held) >= 0.98 * len(held)
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in language.predict(swapped).collect()} == found

# Mended parts ------------------------------------------------------------------


def test_one_long_text_does_not_empty_the_sample(spark):
    train = sorted((i for i in range(200) if zlib.crc32(str(i).encode()) % 5), key=lambda i: i)
    docs = spark.createDataFrame([(i, "x" * 5000 if k % 7 == 0 else f"short {i}") for k, i in enumerate(train)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 1000, max_bytes=100_000, max_text=1000).collect()
    assert {r.doc_id for r in got} == {i for k, i in enumerate(train) if k % 7}


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    def base(seed):
        return [f"{seed}w{i}" for i in range(60)]

    def near(words, i):
        return " ".join([*words[:i], "changed", *words[i + 1 :]])

    one, two = base("a"), base("b")
    rows = [(7, near(one, 0)), (7, near(two, 0)), (9, near(one, 59)), (9, near(two, 59)), (5, " ".join(base("c"))), (5, near(base("c"), 59)), (None, near(base("d"), 0)), (3, near(base("d"), 59)), (None, None), (8, ""), (7, near(one, 0)), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))

    def grams(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {grams(t) for _, t in rows}
    like = {s: sum(1 for o in sets if o != s and s and o and len(s & o) / len(s | o) >= 0.8) for s in sets}
    least = {s: min((i for i, t in rows if grams(t) == s and i is not None), default=None) for s in sets}
    want = Counter((i, least[grams(t)], like[grams(t)]) for i, t in rows)
    assert Counter(tuple(r) for r in minhash.memberships(docs).collect()) == want and max(like.values()) == 1
    assert sorted((r.a, r.b) for r in minhash.near_duplicates(docs).where("a is not null").collect()) == [(5, 5), (7, 9), (7, 9)]
    assert [(r.a, r.b) for r in minhash.near_duplicates(docs).where("a is null").collect()] == [(None, 3)]
    assert minhash.memberships(docs.limit(0)).count() == 0


def test_stages_keep_values_of_any_columns(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, spans string, toxicity double, __id long, __key string, row int, `a.b` int, shard long"
    rows = [(1, None, None, None, None, "p", 0.1, 2, "k", 5, 6, 7), (2, "write to a@b.org", "en", "s", 16, "q", 0.9, 3, "l", 8, 9, 1), (2, "write to a@b.org", "en", "s", 16, "q", 0.9, 3, "l", 8, 9, 1)]
    df = spark.createDataFrame(rows, odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = {tuple(r) for r in stage(spark, df, SF).collect()}
        keep = {(r[0], "write to [EMAIL]" if name == "pii" and r[1] else r[1], r[2], r[3], *r[4:]) for r in rows}
        assert got == keep, name


def _hit_by_hand(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, ids = split(text), set(), set()
    for item_id, other in items:
        other = split(other)
        n = min(13, len(other))
        for at in range(len(other) - n + 1) if n else []:
            for start in range(len(words) - n + 1):
                if words[start : start + n] == other[at : at + n]:
                    hit |= set(range(start, start + n))
                    ids |= {item_id} - {None}
    return len(words), len(hit), sorted(map(str, ids))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_winnowing_of_passages_that_many_items_share(spark, monkeypatch, broadcast_rows):
    opening = "read the passage below with care and answer each of the questions that follow it in order"
    items = [(i, f"{opening} item {i} asks about w{i} x{i} y{i} z{i} and also about {' '.join(f'q{i}v{k}' for k in range(12))}") for i in range(40)]
    items += [(900, "same same same same same same same same same same same same same same same"), (901, "only five words stand here"), (902, "only five words stand here"), (None, "an item without any id still marks the words that it shares with other texts"), (903, ""), (904, None)]
    texts = [opening, f"so {opening} item 3", items[7][1] + " " + items[8][1], ("same " * 40).strip(), "Here ONLY five words stand here, only five words stand here", items[43][1], f"x {opening} y {opening} z", "nothing in common", "", None, "five words", " ".join(opening.split()[:12])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, opening), (None, opening), (0, "another text of one id")]
    whole = decontaminate.hits
    monkeypatch.setattr(decontaminate, "hits", lambda d, i: whole(d, i, broadcast_rows))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = [(i, *_hit_by_hand(t, items)) for i, t in docs]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=str) == sorted(want, key=str)
