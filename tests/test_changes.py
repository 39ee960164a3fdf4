"""Listings without contents, pending, candidate and running sessions."""

import datetime
import os

from pyspark.sql import functions as F

from scrollmill.operators import changes
from scrollmill.sources import folders

NOW = datetime.datetime(2025, 3, 1, 12, 0)
ago = lambda **k: NOW - datetime.timedelta(**k)
at = lambda d: F.lit(d)
U = "01234567-89ab-cdef-0123-456789abcdef"


def test_listing_opens_no_file(spark, tmp_path):
    made = {"projects/p/s1.jsonl": 5, "projects/p/s1/subagents/agent-a.jsonl": 2, "projects/p/memory/a.md": 3, "projects/p/memory/.git/b.md": 1, "projects/p/x.txt": 1, f"sessions/2025/rollout-1-{U}.jsonl": 4, "sessions/auth.json": 9, "history.jsonl": 1}
    for name, n in made.items():
        path = tmp_path / ("c" if name.startswith(("s", "h")) else "a") / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * n)
        os.chmod(path, 0)
    first, second = folders.listing(spark, str(tmp_path / "a")), folders.listing(spark, f"file://{tmp_path}/c/", "codex/")
    assert "content" not in first._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    files = first.unionByName(second)
    got = {r.path: (r.kind, r.project, r.sid, r.how, r["size"]) for r in folders.sources(files).collect()}
    assert got == {
        "projects/p/s1.jsonl": ("session", "p", "s1", "jsonl", 5), "projects/p/s1/subagents/agent-a.jsonl": ("subagent", "p", "s1", "jsonl", 2), "projects/p/memory/a.md": ("memory", "p", None, "doc", 3),
        f"codex/sessions/2025/rollout-1-{U}.jsonl": ("session", None, U, "jsonl", 4), "codex/history.jsonl": ("history", None, None, "jsonl", 1),
    }
    assert ("project", ".txt", 1) in {tuple(r) for r in folders.unrecognised(files).collect()}


def test_pending_sessions_over_generated_files(spark):
    rows = [(f"f{i}", "p", f"s{i}", i, ago(minutes=10 * i)) for i in range(1, 12)] + [("same", "p", "same", 9, ago(minutes=5)), ("future", "p", "future", 1, ago(minutes=-5)), ("old", "p", "old", 1, ago(hours=9)), ("q1", "q", "q1", 1, ago(minutes=3)), ("ex", "q", "ex", 1, ago(minutes=3))]
    files = spark.createDataFrame(rows, "path string, project string, sid string, size long, mtime timestamp")
    known = spark.createDataFrame([("same", 9), ("f1", 99)], "path string, size long")
    out = spark.createDataFrame([("ex",)], "sid string")
    got = changes.pending(files, known, at(NOW), at(ago(minutes=95)), out).orderBy("project", "place").collect()
    assert [(r.project, r.sid, r.place, r.beyond) for r in got] == [*(("p", f"s{i}", i, 4) for i in range(1, 6)), ("q", "q1", 1, 0)]
    assert changes.pending(files, known, at(NOW), F.lit(None).cast("timestamp"), out).count() == 0


def test_candidates_and_running(spark):
    cards = "project string, sid string, ts timestamp, human_kind string, delivered int"
    c = spark.createDataFrame([("p", "new", ago(hours=1), "human", 1), ("p", "new", ago(hours=5), "human", 1), ("p", "act", ago(hours=8), "human", 1), ("p", "gone", ago(hours=9), "human", 1), ("p", "auto", ago(minutes=1), "sdk", 1), ("p", "ghost", ago(minutes=1), "human", 0), ("q", "only", ago(days=9), "human", 1), ("q", "older", ago(days=10), "human", 1)], cards)
    s = spark.createDataFrame([("p", "act", ago(minutes=9)), ("p", "gone", ago(hours=7))], "project string, sid string, last_ts timestamp")
    got = changes.candidates(c, s, at(NOW)).orderBy("project", "place").collect()
    assert [(r.project, r.sid, r.place) for r in got] == [("p", "new", 1), ("p", "act", 2), ("q", "only", 1)]
    text = lambda i: f"started. Task ID: t{i}\nsee workflows/wf_0123abc{i}"
    launches = spark.createDataFrame([("p", "s", ago(hours=3), text(1)), ("p", "s", ago(hours=5), text(2)), ("p", "s", ago(hours=6), text(3)), ("p", "s", ago(days=2), text(4)), ("p", "s", ago(hours=1), "no task")], "project string, sid string, ts timestamp, text string")
    note = lambda i, st: f"<task-notification><task-id>t{i}</task-id><status>{st}</status>"
    notes = spark.createDataFrame([("s", ago(hours=1), note(2, "failed")), ("s", ago(hours=4), note(3, "done")), ("s", ago(hours=9), note(1, "old"))], "sid string, ts timestamp, text string")
    got = {r.task: (r.run, r.status) for r in changes.running(launches, notes, at(NOW)).collect()}
    assert got == {"t1": ("wf_0123abc1", None), "t2": ("wf_0123abc2", "failed")}
