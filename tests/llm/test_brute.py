"""Operators that SQL cannot express against plain versions, and their odd cases."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrollmill.llm import chat, common, components, decontaminate, minhash, mixing, pii, quality, queries, simhash, suffix_tree, toxicity, warc

SF = "/root/testdata/sf0.001"


def rows_of(spark, rows, kinds="doc_id long, text string"):
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Shared parts ---------------------------------------------------------------


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_sample_is_bounded_by_rows_and_bytes(spark):
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = rows_of(spark, [*((train[0], f"t{k}") for k in range(1000)), *((i, "x" * 100) for i in train[1:50])])
    labels = rows_of(spark, [(i, i % 2) for i in range(400)], "doc_id long, quality int")
    assert common.labelled_sample(docs, labels.where(f"doc_id = {train[0]}"), "quality", 1).count() == 1
    assert common.labelled_sample(docs, labels, "quality", 10**6, max_bytes=1000).agg(F.sum(F.length("text"))).first()[0] <= 1000
    assert not {r.doc_id for r in common.labelled_sample(docs, labels, "quality", 10**6).collect()} - set(train)


def test_components_end_on_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(10_000, 10_000 + i) for i in range(1, 500)]
    found = {r.node: r.root for r in components.components(rows_of(spark, links, "u long, v long")).collect()}
    assert len({found[i] for i in range(301)}) == 1 and len({found[10_000 + i] for i in range(500)}) == 1 and found[0] != found[10_000]


def test_release_deletes_what_led_to_a_result(spark, tmp_path):
    start = common.written()
    first, second = (common.materialize(spark.range(3).toDF("x"), n) for n in "ab")
    common.release(spark, start)
    assert second.count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist|not found|no such"):
        first.count()


# 2 and 8: scores --------------------------------------------------------------


@pytest.mark.parametrize(("name", "label"), [("op2_quality", "quality"), ("op8_toxicity", "toxic")])
def test_scores_rank_held_out_labels(spark, name, label):
    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.QUERIES[name](spark, sf).toPandas()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= (0.3 if name == "op2_quality" else 0.5))).all()
    held = found[found.held_out].merge(y.toPandas(), on="doc_id")
    one, none = held.score[held[label] == 1].to_numpy(), held.score[held[label] == 0].to_numpy()
    assert np.mean([(one[:, None] > none) + 0.5 * (one[:, None] == none)]) > 0.95


def test_lexicon_does_not_see_the_calibration_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda sample, **_: seen.update(ids={r.doc_id for r in sample.collect()}) or ([], []))
    rows = [(i, "you idiot " * 9 if i % 2 else "a fine day") for i in range(300)]
    toxicity.score(rows_of(spark, rows), rows_of(spark, [(i, i % 2) for i in range(300)], "doc_id long, toxic int")).count()
    apart = {r.id for r in spark.range(300).where(F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0).collect()}
    assert seen["ids"] and not seen["ids"] & apart


# 4: tokens, counts and the base -------------------------------------------------


def test_suffix_tree_base_against_brute_force(spark, documents):
    docs = [*((r.doc_id, r.text) for r in documents.collect()), (10**6, None), (10**6 + 1, " É x É ")]
    found = {r.doc_id: r for r in suffix_tree.score(rows_of(spark, docs), depth=3).collect()}
    lower = {i: i + 32 for i in range(65, 91)}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    seen = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(seen.values()), len(seen)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in seen for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws))
        assert r.score < 0


# 5: base kinds ----------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_pii_base_against_brute_force(spark, documents):
    hard = ["a@b a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 010.020.030.040 1.2.3.256", "+1 (2) 3", "+12345678901+12345678901", "4111 1111 1111 1111 4111-1111-1111-1111", "é4111111111111111", "0" * 18, "x" * 70_000 + "@a.b", "1 " * 40_000, "+1" + "-" * 50_000, None, ""]
    docs = [*((r.doc_id, r.text) for r in documents.collect()), *((10**6 + k, t) for k, t in enumerate(hard))]
    for r in pii.with_spans(rows_of(spark, docs)).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == plain_spans(r.text or ""), (r.doc_id, (r.text or "")[:80])


def test_pii_masks_long_texts(spark):
    text = "é😀 word " * 100_000 + "write to ann@x.org now " * 300
    r = pii.with_spans(rows_of(spark, [(1, text)])).withColumn("m", pii.masked()).first()
    assert len(r.spans) == 300 and r.m == text.replace("ann@x.org", "[EMAIL]")


# 6: signatures, likeness, recall --------------------------------------------------


def plain_sets(texts):
    lower = {i: i + 32 for i in range(65, 91)}
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_minhash_against_brute_force(spark, documents):
    docs = sorted((r.doc_id, r.text or "") for r in documents.collect())
    texts = [t for _, t in docs]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    own, changed = minhash.of_texts(texts), minhash.of_texts(edited)
    found = {r.doc_id: r for r in minhash.fingerprints_with_edits(documents).collect()}
    assert len(found) == len(docs)
    sets, other = plain_sets(texts), plain_sets(edited)
    for k, (i, t) in enumerate(docs):
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[k].encode()).hexdigest())
        assert r.fingerprint == minhash.to_hex(own[k : k + 1])[0] and r.edited_fingerprint == minhash.to_hex(changed[k : k + 1])[0]
        assert r.near_edited == pytest.approx((own[k] == changed[k]).mean()) and r.near_next == pytest.approx((own[k] == own[(k + 1) % len(docs)]).mean())
        both = len(sets[k] | other[k])
        assert not both or abs(r.near_edited - len(sets[k] & other[k]) / both) < 0.2


def test_minhash_splits_an_id_that_all_rows_share(spark):
    docs = rows_of(spark, [(None if i % 2 else 7, f"text {i} " * 20) for i in range(400)])
    found = minhash.fingerprints_with_edits(docs, 4).collect()
    assert Counter(r.doc_id for r in found) == {None: 200, 7: 200}
    starts = minhash.part_starts(docs.select(F.coalesce("doc_id", F.lit(minhash.NO_ID)).alias("o"), F.xxhash64("text").alias("key")), 16)
    assert len(starts) > 8


def test_near_duplicate_recall(spark):
    draw = np.random.default_rng(0)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in draw.integers(0, 5000, 120)]
        for k in range(3):
            near = list(base)
            for i in draw.integers(0, 120, k * 2):
                near[i] = f"v{draw.integers(0, 9999)}"
            rows.append((g * 3 + k, " ".join(near)))
    sets = plain_sets([t for _, t in rows])
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(r.a, r.b) for r in minhash.near_duplicates(rows_of(spark, rows)).collect()}
    assert len(want) > 30 and found <= want and len(found) >= 0.9 * len(want)


# 9: damaged archives ---------------------------------------------------------------


def test_warc_tells_damaged_records(spark, tmp_path):
    text = "é" * 60_000
    payload = text.encode()
    digest = hashlib.sha256(payload).hexdigest()
    whole = lambda i: warc.page_records(i, "u", payload, digest, "response", None)
    assert len(whole(1)) > 3
    shuffled, third, short = list(reversed(whole(2))), whole(3), whole(4)[:-1]
    lost = third[:1] + third[2:] + whole(8)[1:2]  # and a segment of a record that is not there
    revisit, stray = warc.page_records(5, "u", payload, digest, "revisit", 1), warc.page_records(6, "u", payload, digest, "revisit", 3)
    wrong = warc.page_records(7, "u", b"other", digest, "response", None)
    for k, some in enumerate([whole(1) + shuffled, lost + short + revisit + stray + wrong]):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in some)))
    found = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert {i for i, r in found.items() if r.intact} == {1, 2, 5}
    assert all((found[i].payload_bytes, found[i].payload_digest) == (120_000, digest) for i in (1, 2, 5))
    assert found[6].payload_bytes is None and found[5].refers_to == 1


# 10: pigeonring, kept rows ------------------------------------------------------------


def test_longer_chain_finds_the_same_links(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for n in (1, 2, 3, 4, 5):
            prints.add(int(np.bitwise_xor.reduce([np.int64(1) << np.int64(x) for x in draw.choice(63, n, False)], initial=b)))
    prints = sorted(prints)
    want = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4}
    df = rows_of(spark, [(p,) for p in prints], "fp long")
    for chain in (2, 3):
        assert {(r.u, r.v) for r in simhash.fingerprint_links(df, chain).collect()} == want


def test_keep_first_judges_rows_by_themselves(spark):
    one, two, three = ("alpha beta gamma delta " * 30, "quite other words stand here " * 30, "a third text of its own kind " * 30)
    rows = [(5, one), (None, one), (None, two), (None, two), (7, two + "x y z"), (8, three), (8, one), (9, three), (9, three), (None, None), (None, "  "), (3, "lone words in a row")]
    kept = simhash.keep_first(rows_of(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept if r.text and r.text.strip()])) == sorted(map(str, [(5, one), (7, two + "x y z"), (8, three), (3, "lone words in a row")]))
    assert len(kept) == 5  # and one of the texts without words
    again = simhash.keep_first(rows_of(spark, [(None, two), (None, two), (4, three), (4, one)])).collect()
    assert Counter(r.doc_id for r in again) == {None: 1, 4: 2}


# 1: branches ----------------------------------------------------------------------


def test_trees_rank_several_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), *(("t", k, 1, "assistant", f"a{k}", s) for k, s in ((2, 0.5), (3, 0.5), (4, 0.9), (5, None)))]
    nodes = rows_of(spark, rows, "tree string, node long, parent long, role string, text string, score double")
    best = [(r.leaf, round(r.path_score, 3)) for r in chat.format_paths(nodes, 3).collect()]
    assert sorted(best) == [(2, 0.25), (3, 0.25), (4, 0.45)]
    deep = rows_of(spark, [("d", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], nodes.schema)
    assert [t.text for t in chat.format_paths(deep).select(chat.read_back(F.col("formatted")).alias("x")).first().x] == [str(i) for i in range(70)]


# All: empty tables, clashing names, long texts ----------------------------------------

CLASH = "doc_id long, text string, source string, lang string, n_chars long, score double, spans string, quality int, toxicity int, fp long, nr long, bucket long, start long, target double, size long, `a.b` string, __pii_text string, __tox_row string, key long, part int"


def run_all(spark, docs):
    labels = rows_of(spark, [(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    items = rows_of(spark, [(1, "one two three"), (2, None)], "item_id long, text string")
    return {
        "quality": quality.score(docs, labels), "mixing": mixing.mix(mixing.sized(docs.drop("size"), "nr", "bucket", "start")), "tree": suffix_tree.score(docs, depth=3), "pii": pii.with_spans(docs), "minhash": minhash.fingerprints_with_edits(docs),
        "members": minhash.memberships(docs), "winnowing": decontaminate.contamination(docs, items), "toxicity": toxicity.score(docs, labels), "simhash": simhash.near_duplicates(docs), "kept": simhash.keep_first(docs),
    }


def test_empty_tables(spark):
    for name, found in run_all(spark, rows_of(spark, [], CLASH)).items():
        assert found.count() == 0, name
    turns = rows_of(spark, [], "conv_id long, turn long, role string, text string")
    assert chat.format_paths(chat.threads(turns)).count() == 0
    assert warc.round_trip(rows_of(spark, [], "page_id long, url string, html string")).count() == 0
    assert mixing.blocks(mixing.sized(rows_of(spark, [], CLASH).drop("size"))).count() == 0


def test_clashing_names_and_long_texts(spark):
    long = "some words of a very long text é " * 60_000  # two megabytes
    rows = [(i, t, None if i % 2 else "s", "en", 1, 0.5, "x", 1, 1, 2, 3, 4, 5, 6.0, 7, "dot", "p", "r", 8, 9) for i, t in enumerate([long, None, "", "one two three", "one two three", "idiot you " * 9])]
    rows += [(-(1 << 63), "least id", *rows[0][2:]), (None, "no id", *rows[0][2:]), rows[3]]
    docs = rows_of(spark, rows, CLASH)
    for name, found in run_all(spark, docs).items():
        assert name == "kept" or found.count() == len(rows), name
    made = pii.with_spans(docs)
    assert made.columns == [*(c for c in docs.columns if c != "spans"), "spans"] and made.select("`a.b`", "__pii_text").distinct().collect() == [("dot", "p")]
    assert toxicity.score(docs, rows_of(spark, [], "doc_id long, toxic int")).columns == [*(c for c in docs.columns if c != "toxicity"), "toxicity"]


# The pipeline ---------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, documents):
    """Each stage on its own input, and the whole run as their sequence."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), common.materialize(stage(spark, docs, SF), "t")
        assert out.columns == documents.columns
        after = out.collect()
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert ids == {i for i, s in scores.items() if s < 0.5}
        elif name == "simhash_near_dedup":
            def fp(text):
                w = (text or "").encode().lower().split()
                h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
                return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

            prints, root = {r.doc_id: fp(r.text) for r in before}, {r.doc_id: r.doc_id for r in before}
            order = sorted(prints)
            changed = True
            while changed:
                changed = False
                for k, a in enumerate(order):
                    for b in order[k + 1 :]:
                        if root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                            root[a] = root[b] = min(root[a], root[b])
                            changed = True
            assert ids == {i for i in order if root[i] == i}
        elif name == "benchmark_decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
            windows = defaultdict(set)
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(r.text)
                for i in range(max(1, len(w) - 12)) if w else ():
                    windows[min(13, len(w))].add(tuple(w[i : i + 13]))

            def bad(text):
                w, hit = words(text), set()
                for n, some in windows.items():
                    for i in range(len(w) - n + 1):
                        if tuple(w[i : i + n]) in some:
                            hit |= set(range(i, i + n))
                return hit and 20 * len(hit) >= len(w)

            assert ids == {r.doc_id for r in before if not bad(r.text)}
        else:
            texts = {r.doc_id: r.text for r in before}
            assert ids == set(texts)
            for r in after:
                assert r.n_chars == (len(r.text) if r.text is not None else None) and not plain_spans(r.text or "")
        docs = out
    shape = lambda df: sorted(map(str, df.collect()))
    assert shape(corpus_pipeline.run(spark, SF)) == shape(corpus_pipeline.STAGES[-1][1](spark, docs, SF))


def test_pipeline_stages_take_odd_tables(spark):
    odd = "doc_id long, text string, lang string, source string, n_chars long, shard long, parts string, toxicity double, __id long"
    rows = [(1, None, None, None, None, 1, "p", 0.1, 2), (None, "", "en", "s", 0, None, None, None, None), (2, "one " * 30_000, "en", "s", 9, 1, "p", 0.1, 2), (3, "write to a@b.org", "en", "s", 9, 1, "p", 0.1, 2), (3, "write to a@b.org", "en", "s", 9, 1, "p", 0.1, 2)]
    for df in (rows_of(spark, rows, odd), rows_of(spark, [], odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert (name == "mixing") != (out.columns == df.columns), name
            assert out.count() <= 30_000
