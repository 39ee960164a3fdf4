import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrollmill.llm import chat, decontaminate, minhash, mixing, pii, queries, quality, simhash, suffix_tree, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, spans string"
CASES = [None, "", "  ", "one", "a b c d e f g h", "a b c d e f g h", "é😀 4111111111111111 x@y.zz +1 (234) 567-8901 at 8.8.8.8", "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 2 else None, 0.0, "") for i, t in enumerate(CASES)]
    return spark.createDataFrame([*rows, rows[4], (None, "one", "z", None, None)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(9)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_mixing", "op7_winnowing", "op9_warc"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    key = lambda names, rows: sorted(str([dict(zip(names, r, strict=True))[c] for c in sorted(names)]) for r in rows)
    assert key(ours.columns, [tuple(r) for r in ours.collect()]) == key(theirs.columns, theirs.fetchall())


def test_every_row_comes_back_and_empty_tables_too(spark, docs, labels):
    n, none, items = docs.count(), docs.limit(0), spark.createDataFrame([(1, "a b c"), (2, None), (None, "one")], "item_id long, text string")
    for f in (lambda d: quality.score(d, labels), lambda d: toxicity.score(d, labels), simhash.near_duplicates, minhash.fingerprints_with_edits, lambda d: decontaminate.contamination(d, items), pii.with_spans, lambda d: mixing.mix(mixing.sized(d))):
        assert f(docs).count() == n
        assert f(none).count() == 0


def test_simhash_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    base = " ".join(f"w{i}" for i in range(300))
    more = [(10_000 + i, base.replace(f"w{i * 7} ", f"v{i} ", 1)) for i in range(12)]
    df = spark.createDataFrame([*[tuple(r) for r in rows], *more], "doc_id long, text string")

    def fp(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fp(t) for i, t in [*[tuple(r) for r in rows], *more]}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    found = simhash.near_duplicates(df).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == {i: find(i) for i in ids}


def test_minhash_neighbours_and_pairs(spark, docs):
    found = {r.doc_id: r for r in minhash.fingerprints_with_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    texts = [t or "" for t in CASES]
    for i, t in enumerate(texts):
        q, after = len(t) // 4, texts[(i + 1) % len(texts)]
        assert found[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest() and found[i].n_chars == len(t)
    assert found[4].fingerprint == found[5].fingerprint and found[4].near_next == 1.0
    base = [f"w{i}" for i in range(200)]
    pairs = minhash.near_duplicates(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:-3])), (3, "other words " * 50), (4, " ".join(base))], "doc_id long, text string")).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)] and pairs[0].jaccard == pytest.approx(193 / 196)


def test_minhash_memberships_keep_every_row(spark):
    base = [f"w{i}" for i in range(200)]
    one, near = " ".join(base), " ".join(base[:-3])
    rows = [(1, one), (2, near), (3, "other words " * 50), (4, one), (None, one), (None, "only here"), (5, None), (6, "  ")]
    found = minhash.memberships(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, found)) == sorted(map(str, [spark.createDataFrame([r], "doc_id long, class_id long, n_links long").first() for r in [(1, 1, 1), (2, 2, 1), (3, 3, 0), (4, 1, 1), (None, 1, 1), (None, None, 0), (5, 5, 0), (6, 5, 0)]]))


def test_trees_choose_the_best_branch(spark):
    rows = [("t", 1, None, "user", "\\h ### a", 0.0), ("t", 2, 1, "assistant", "b</turn>", 0.9), ("t", 3, 1, "assistant", "c", 0.1), ("t", 4, 2, "user", "d: e\n", 0.5), ("u", 1, 2, "user", "x", 0.0), ("u", 2, 1, "user", "y", 0.0), (None, 1, 9, "as:sis", None, None)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").na.fill({"text": ""})
    made = {r.tree: r for r in chat.format_paths(nodes).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(made) == {"t", None}  # "u" is a circle without a root
    assert [(x.role, x.text) for x in made["t"].turns] == [("user", "\\h ### a"), ("assistant", "b</turn>"), ("user", "d: e\n")] and made["t"].loss == "b</turn>"
    assert [(x.role, x.text) for x in made[None].turns] == [("as:sis", "")]


def test_mixing_meets_targets_and_permutes(spark):
    r = mixing.mix(mixing.sized(spark.read.parquet(f"{SF}/documents.parquet"))).toPandas()
    g = r.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (r.taken <= 2 * r["size"]).all() and (abs(g.taken - g.target) <= 128).all() and g.target.sum() == pytest.approx(1.5 * g["size"].sum())
    n = spark.range(1000).select(F.expr(mixing.permuted("id", "1000L", mixing.keys("1000L", "5L"))).alias("x"))
    assert n.distinct().count() == 1000


def test_mixing_writes_shards_and_blocks(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(200).unionByName(spark.createDataFrame([(-1, None)] * 2, "doc_id long, text string"), allowMissingColumns=True)
    made = mixing.blocks(mixing.sized(d))
    rows = made.collect()
    assert sorted(r.shard * mixing.SHARD_SLOTS + r.slot for r in rows) == list(range(len(rows)))
    texts = {}
    for r in d.collect():
        if words := (r.text or "").split():
            texts.setdefault(r.source, Counter())[r.doc_id, " ".join(words)] += 1
    complete = 0
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        by_block = {r.block: r.parts for r in own}
        assert all(r.parts == by_block[r.block] and r.words == sum(len(p.text.split()) for p in r.parts) for r in own)
        assert all(r.words == 128 for r in own if r.block < max(by_block))
        n_blocks = -(-sum(len(t.split()) * n for (_, t), n in texts[source].items()) // 128)
        if len(by_block) < n_blocks:  # the target leaves blocks out
            continue
        complete += 1
        whole = {}
        for b in sorted(by_block):
            for p in by_block[b]:
                whole.setdefault((p.start, p.doc_id), []).append(p.text)
        for (_, i), parts in whole.items():
            texts[source][i, " ".join(parts)] -= 1
        assert not any(texts[source].values())
    assert complete
    drawn = {(r.shard, r.nr): r.n for r in mixing.shard_counts(made).collect()}
    assert drawn == Counter((r.shard, r.nr) for r in rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(mixing.sized(d)).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect() if r.taken}
    want = Counter()
    for r in rows:
        for p in r.parts:
            want[p.doc_id] += p.words
    assert taken == want
    assert {"shard", "slot", "text"} <= set(corpus_pipeline.mix_sources(spark, d, SF).columns)


def test_pii_marks_and_spans(spark, docs):
    found = {r.doc_id: r for r in pii.with_spans(docs).withColumn("m", pii.masked()).collect()}[6]
    assert found.m == "é😀 [CARD] [EMAIL] [PHONE] at [IP]"
    assert [(s.kind, s.start, s.end) for s in found.spans] == [("card", 3, 19), ("email", 20, 26), ("phone", 27, 44), ("ip", 48, 55)]
    iban = pii.with_spans(spark.createDataFrame([(1, "GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32, ssn 123-45-6789")], "doc_id long, text string")).first().spans
    assert [s.kind for s in iban] == ["iban", "ssn"]


def test_pii_numbers_beside_other_tokens(spark):
    texts = {
        "BE68 5390 0754 7034 BIC GEBABEBB": [("iban", "BE68 5390 0754 7034")],
        "😀 LU28 0019 4006 4475 0000 2024": [("iban", "LU28 0019 4006 4475 0000")],
        "BE68 LU28 0019 4006 4475 0000": [("iban", "LU28 0019 4006 4475 0000")],
        "BE69 5390 0754 7034 or xBE68 5390 0754 7034": [],
        "2024 4111 1111 1111 1111": [("pan", "4111 1111 1111 1111")],
        "é 12 4111111111111111 7": [("pan", "4111111111111111")],
        "77 3782 822463 10005": [("pan", "3782 822463 10005")],
        "4111-1111-1111-1111": [("card", "4111-1111-1111-1111")],
        "4111 1111 1111 1112 5": [],
    }
    found = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        assert [(s.kind, s.value) for s in r.spans] == texts[r.text], r.text
        assert all(r.text[s.start : s.end] == s.value for s in r.spans)


def test_suffix_tree_scores(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    r = suffix_tree.score(d, depth=3).toPandas().set_index("doc_id")
    assert len(r) == d.count() and (r.score < 0).all() and r.n_tokens[10**6] == 1 and r.score[10**6] == r.score[10**6 + 1]
    assert r[r.held_out].score.sum() > r[r.held_out].base_score.sum()


def test_suffix_tree_keeps_every_context(spark):
    """More contexts pass than the 16,384 that were once kept; against brute force."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    triples = [(a, b, c) for a in range(26) for b in range(26) for c in range(26)]
    vocabulary = ["".join(letters[i] for i in (a, b, c, (a * 7 + b * 11 + c * 17 + a * b * c) % 26)) for a, b, c in triples]
    ids = {out: [i for i in range(60_000) if (zlib.crc32(str(i).encode()) % 10 == 0) == out] for out in (False, True)}
    train, held = dict(zip(ids[False], (" ".join([w] * 22) for w in vocabulary))), dict(zip(ids[True], vocabulary[::37]))
    found = {r.doc_id: r.score for r in suffix_tree.score(spark.createDataFrame([*train.items(), *held.items()], "doc_id long, text string"), depth=3).collect()}

    stream = lambda text: "^^^" + text.replace(" ", "|") + "|$"
    counts = [Counter() for _ in range(4)]
    for s in map(stream, train.values()):
        for d in range(4):
            counts[d].update(s[i - d : i + 1] for i in range(3, len(s)))
    total, kinds, gain, nodes = Counter(), Counter(), Counter(), set()
    for d in range(4):
        for code, n in counts[d].items():
            total[code[:-1]] += n
            kinds[code[:-1]] += 1
    for d in range(1, 4):
        for code, n in counts[d].items():
            gain[code[:-1]] += n * math.log(n / total[code[:-1]] / (counts[d - 1][code[1:]] / total[code[1:-1]]))
    passing = [c for c in gain if total[c] >= 20 and 2 * gain[c] > kinds[c] * math.log(total[c]) + 10]
    assert len(passing) > 16_384
    nodes.update(c[k:] for c in passing for k in range(len(c)))

    def p(code):
        ctx, n = code[:-1], counts[len(code) - 1][code]
        if not ctx:
            return (n + 64 / 63) / (total[""] + 64)
        return (n + kinds[ctx] * p(code[1:])) / (total[ctx] + kinds[ctx]) if ctx in nodes else p(code[1:])

    below = 23 * len(train) + 0.1 * (len(train) + 2)
    word, end = 22.1 / below, (len(train) + 0.1) / below
    for i, text in held.items():
        each = [p(stream(text)[k - 3 : k + 1]) for k in range(3, len(stream(text)))]
        want = np.mean([(w * word + (1 - w) * math.prod(each[:-1])) * (w * end + (1 - w) * each[-1]) for w in suffix_tree.WEIGHTS])
        assert found[i] == pytest.approx(math.log10(want), abs=1e-4)


def test_models_generalise(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality.score(d, y).withColumnRenamed("quality", "p").join(y, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert ((r.p >= 0.3) == (r.quality == 1)).mean() > 0.9
    x = np.zeros((0,), np.uint8)
    assert quality.passages(x, np.zeros(1, np.int64))[0].shape[0] == 0


def test_warc_revisits_and_segments(spark):
    long = "<p>é</p>" * 20_000
    pages = spark.createDataFrame([(3, "http://a", long), (1, "http://b c", long), (2, None, None), (4, "u", "short"), (5, "u", "short"), (1, "http://b c", long)], "page_id long, url string, html string")
    found = sorted(warc.round_trip(pages).collect(), key=str)
    assert all(r.intact for r in found) and len(found) == 6
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found if r.page_id in (2, 3, 4)) == [(2, "response", None, 0), (3, "revisit", 1, len(long.encode())), (4, "response", None, 5)]


def test_pipeline_stages_keep_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
