"""Keyed tables and ingest in batches: upserts, replays, crashes, resets."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from scrollmill.streaming import documents
from scrollmill.streaming import ingest as ing
from scrollmill.streaming.store import Store

ROW = "k string, v int"


def rows(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_merge_replaces_touched_buckets_alone(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ROW, ["k"], 8)
    of = lambda x: spark.createDataFrame(x, ROW)
    assert rows(s) == [] and s.append(of([(str(i), i) for i in range(40)]), "a", 0)
    before = s.state()["pieces"]
    assert s.merge(of([("3", 33), ("new", 1)]), "a", 1, gone=of([("5", 0), ("none", 0), ("3", 0)]).select("k"))
    assert rows(s) == sorted([(str(i), i) for i in range(40) if i not in (3, 5)] + [("3", 33), ("new", 1)])
    after = s.state()["pieces"]
    touched = {r[0] for r in of([("3", 0), ("5", 0), ("new", 0), ("none", 0)]).select(F.pmod(F.xxhash64("k"), F.lit(8)).cast("string")).collect()}
    assert {b for b in after if after[b] != before.get(b)} <= touched and len(touched) < 8
    assert not s.merge(of([("3", 99)]), "a", 1) and s.merge(of([("4", 44)]), "b", 0) and ("3", 33) in rows(s)
    assert not Store(spark, str(tmp_path / "none"), ROW, ["k"]).read().count()


def test_append_keeps_first_writers_and_compacts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ROW, ["k"], 4)
    for n in range(5):
        s.append(spark.createDataFrame([("x", n), (f"y{n}", n)], ROW), "a", n)
    want = rows(s)
    assert want == sorted([("x", 0), *((f"y{n}", n) for n in range(5))])
    s.compact(most=1)
    assert rows(s) == want and all(len(p) == 1 for p in s.state()["pieces"].values())
    s.vacuum()
    assert rows(s) == want and len(s._names("_commits")) == 1 and {x for x in s._names("") if x.startswith("piece=")} == {p for x in s.state()["pieces"].values() for p in x}


def test_a_broken_commit_is_no_commit_and_a_batch_runs_again(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "t"), ROW, ["k"], 4)
    s.append(spark.createDataFrame([("a", 1)], ROW), "s", 0)
    real = s._commit
    monkeypatch.setattr(s, "_commit", lambda _: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        s.append(spark.createDataFrame([("b", 2)], ROW), "s", 1)
    assert rows(s) == [("a", 1)]
    (tmp_path / "t" / "_commits" / "000000000009.json").write_text('{"n": 9, "pie')
    monkeypatch.setattr(s, "_commit", real)
    assert rows(s) == [("a", 1)] and s.append(spark.createDataFrame([("b", 2)], ROW), "s", 1)
    assert rows(s) == [("a", 1), ("b", 2)] and s.state()["n"] == 10


def codex(sid="c1", source="cli"):
    line = lambda t, **p: json.dumps({"timestamp": "2025-01-01T00:00:00Z", "type": t, "payload": p})
    said = lambda role, text: line("response_item", type="message", role=role, content=[{"type": "input_text" if role == "user" else "output_text", "text": text}])
    return [
        line("session_meta", id=sid, cwd="/w/p", cli_version="1.2", source=source), line("turn_context", cwd="/w/q", model="m1"), said("user", "first"), said("assistant", "one"),
        line("response_item", type="function_call", call_id="k1", name="shell", arguments=json.dumps({"command": ["bash", "-lc", "ls x"]})),
        line("response_item", type="function_call_output", call_id="k1", output="Exit code: 2\nOutput:\nls: cannot access 'x'"),
        said("user", "second"), line("turn_context", cwd="/w/r", model="m2"), said("assistant", "two"), line("event_msg", type="token_count"),
    ]


def placed(path, lines, start=0):
    out, off = [], start
    for x in lines:
        out.append((path, off, x))
        off += len(x.encode()) + 1
    return out


def taken(tables):
    cols = [c for c in tables.events.schema.names if c not in ("tool_uses", "tool_results")]
    return sorted(tables.events.read().select(*cols).collect(), key=lambda r: (r.path, r.off, r.key))


def test_a_file_in_three_batches_is_as_in_one(spark, tmp_path):
    a = [json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"content": f"t{i}"}}) for i in range(6)]
    a += ["", "{bad", json.dumps({"type": "file-history-snapshot"}), json.dumps({"type": "file-history-snapshot"})]
    lines = placed("codex/c.jsonl", codex()) + placed("codex/x.jsonl", codex("c2", "exec")) + placed("projects/p/s.jsonl", a)
    df = lambda x: spark.createDataFrame(x, ing.LINES)
    one, three = (ing.Tables(spark, str(tmp_path / n), 4) for n in ("one", "three"))
    ing.ingest_batch(df(lines), one, "s", 0)
    cuts = [[x for k in range(0, 30, 10) for x in lines[k + lo : k + hi]] for lo, hi in ((0, 3), (3, 7), (7, 10))]
    for n, part in enumerate(cuts):
        ing.ingest_batch(df(part), three, "s", n)
    ing.ingest_batch(df(part), three, "s", 2)  # once more: nothing changes
    assert taken(one) == taken(three) and len(taken(one)) == 30
    assert rows(one.files) == rows(three.files) and rows(one.counters) == rows(three.counters)
    got = {(r.path, r.off): r for r in taken(three)}
    at = lambda i, path="codex/c.jsonl": got[path, lines[i + (10 if path != "codex/c.jsonl" else 0)][1]]
    assert (at(6).cwd, at(6).version, at(6).kind, at(6).sid, at(8).cwd, at(8).model) == ("/w/q", "1.2", "human", "c1", "/w/r", "m2")
    assert at(6, "codex/x.jsonl").kind == "sdk" and at(9).excluded == "codex:token_count"
    tools = {r.off: r for r in three.events.read().where("path = 'codex/c.jsonl'").collect()}
    call, result = tools[lines[4][1]].tool_uses[0], tools[lines[5][1]].tool_results[0]
    assert (call.tuid, call.cmd, result.tuid, result.is_err) == ("k1", "ls x", "k1", 1) and "cannot access" in result.err_line


def test_a_crash_between_tables_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    a = [json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"content": "x"}}) for i in range(3)] + ["{bad", "{bad"]
    lines = spark.createDataFrame(placed("p/s.jsonl", a), ing.LINES)
    t, real = ing.Tables(spark, str(tmp_path / "t"), 4), Store._commit
    for broken in (t.events, t.counters, t.files):

        def commit(self, state, path=broken.path):
            if self.path == path:
                raise OSError("crash")
            real(self, state)

        monkeypatch.setattr(Store, "_commit", commit)
        with pytest.raises(OSError):
            ing.ingest_batch(lines, t, "s", 0)
    monkeypatch.setattr(Store, "_commit", real)
    ing.ingest_batch(lines, t, "s", 0)
    assert len(taken(t)) == 5 and [tuple(r)[1:4] for r in t.counters.read().collect()] == [("bad_json", False, 2)]
    assert [(r.off, r.n_lines, r.n_bad, r.resets) for r in t.files.read().collect()] == [(sum(len(x) + 1 for x in a), 5, 2, 0)]


def test_a_replaced_file_adds_only_its_surplus(spark, tmp_path):
    t = ing.Tables(spark, str(tmp_path / "t"), 4)
    plain, kept = json.dumps({"type": "summary", "summary": "same"}), json.dumps({"type": "user", "uuid": "u", "sessionId": "s", "message": {"content": "x"}})
    batch = lambda n, x: ing.ingest_batch(spark.createDataFrame(placed("p/s.jsonl", x), ing.LINES), t, "s", n)
    batch(0, [plain, kept, plain, "{bad"])
    batch(1, [kept, plain, plain, plain, "{bad", "{worse"])
    assert sorted(r.text for r in taken(t) if r.excluded is None) == ["same", "same", "same", "x"]
    assert sorted(r.raw for r in taken(t) if r.excluded) == ["{bad", "{worse"]
    assert [(r.reason, r.n) for r in t.counters.read().collect()] == [("bad_json", 2)] and [(r.resets, r.n_lines) for r in t.files.read().collect()] == [(1, 6)]


# Documents --------------------------------------------------------------------


def test_documents_changed_kept_and_vanished(spark, tmp_path):
    shelf = documents.Shelf(spark, str(tmp_path / "d"), 4)
    kinds = "path string, kind string, project string, sid string, content binary, mtime timestamp"

    def load(n, docs):
        made = [(p, k, "pr", "s", c.encode(), datetime.datetime(2025, 1, 1)) for p, (k, c) in docs.items()]
        documents.load_documents(spark.createDataFrame(made, kinds), shelf, "s", n, F.lit(f"2025-02-0{n + 1}").cast("timestamp"))
        return {r.path: r for r in shelf.docs.read().collect()}, {r.key: r.body for r in shelf.search.read().collect()}

    run = json.dumps({"workflowName": "w", "summary": "password=hunter22x", "result": {"a": [1]}, "phases": [], "status": "done", "agentCount": 2})
    first = {"m/a.md": ("memory", "alpha sk-" + "Zq1" * 9), "m/b.md": ("memory", "beta"), "m/c.md": ("memory", "gone soon"), "w/wf_1.json": ("wf_run", run), "s/agent-7.meta.json": ("agent_meta", '{"model": "m", "toolUseId": "t"}'), "w/bad.json": ("wf_run", "[1]")}
    docs, found = load(0, first)
    assert docs["m/a.md"].text == "alpha [REDACTED:sk_key]" and docs["w/wf_1.json"].text == 'w\npassword=[REDACTED:pw_kv]\n{"a":[1]}' and docs["w/bad.json"].text == "[1]"
    assert json.loads(docs["w/wf_1.json"].meta)["agentCount"] == 2 and json.loads(docs["s/agent-7.meta.json"].meta)["agentId"] == "7" and len(found) == 6
    second = {**first, "m/b.md": ("memory", "beta two"), "m/d.md": ("memory", "delta"), "w/bad.json": ("wf_run", "")}
    del second["m/c.md"]
    docs, found = load(1, second)
    assert (docs["m/c.md"].missing, docs["m/a.md"].updated.day, docs["m/b.md"].updated.day, docs["m/b.md"].first_seen.day) == (1, 1, 2, 1)
    assert found["d:m/b.md"] == "beta two" and found["d:m/c.md"] == "gone soon" and "d:m/d.md" in found and "d:w/bad.json" not in found
    assert load(1, first)[0] == docs  # the batch was done before
    docs, _ = load(2, first)
    assert docs["m/c.md"].missing == 0 and docs["m/c.md"].updated.day == 1 and docs["m/d.md"].missing == 1 and docs["m/b.md"].text == "beta"


def test_a_merge_writes_new_rows_once_and_marks_stored_ones(spark, tmp_path):
    """new rows are a piece of the table at once, what stays is written beside it, and no value is shuffled twice."""
    s = Store(spark, f"{tmp_path}/t", "k string, v long, m int", ["k"], 4)
    s.merge(spark.range(20).selectExpr("cast(id as string) k", "id v", "0 m"), "a", 0)
    assert len([x for x in s._names("") if x.startswith("piece=")]) == 1
    s.merge(spark.createDataFrame([("3", 33, 0), ("x", 1, 0)], "k string, v long, m int"), "a", 1, gone=spark.createDataFrame([("4",)], "k string"), marks=spark.createDataFrame([("5", 1), ("3", 1), ("none", 1)], "k string, m int"))
    want = {str(i): (i, 0) for i in range(20) if i != 4} | {"3": (33, 0), "x": (1, 0), "5": (5, 1)}
    assert {r.k: (r.v, r.m) for r in s.read().collect()} == want and s.read().count() == 20
    new = next(x for x in s._names("") if x.endswith("-new") and spark.read.parquet(f"{s.path}/{x}").count() == 2)
    assert any(new in p for p in s.state()["pieces"].values()) and not s._names("_staging")
    joined = s.placed(s.read()).join(s.placed(s.read().select("k")).hint("shuffle_hash"), ["store_bucket", "k"], "left")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_upsert_keeps_documents_without_text(spark, tmp_path):
    """a null or empty text has no search row, its document is a row of the result all the same."""
    import duckdb

    from scrollmill.plans import registry

    spark.range(80).selectExpr("id as doc_id", "case when id % 4 = 0 then '' when id % 4 = 1 then null else concat('some text of ', id) end as text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(registry.SQL["doc_upsert_two_runs"]).fetchall())
    assert sorted(tuple(r) for r in registry.QUERIES["doc_upsert_two_runs"](spark, str(tmp_path)).collect()) == expected and len(expected) > 70
