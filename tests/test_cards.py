import json

import pytest
from pyspark.sql import functions as F

from scrollmill.functions import content, reduction
from scrollmill.operators import cards, tools
from scrollmill.streaming.ingest import events

AT = "2024-01-01T00:00:%02d.000Z"


def line(i, **more):
    return {"sessionId": "s", "uuid": f"u{i}", "timestamp": AT % i, **more}


def human(i, text):
    return line(i, type="user", promptSource="typed", message={"role": "user", "content": text})


def answer(i, mid, out, *blocks, model="m1"):
    usage = {"input_tokens": 5, "output_tokens": out, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 2}
    return line(i, type="assistant", message={"id": mid, "model": model, "content": list(blocks), "usage": usage})


def use(tuid, name, **given):
    return {"type": "tool_use", "id": tuid, "name": name, "input": given}


def result(i, tuid, said, error=False, **more):
    return line(i, type="user", message={"content": [{"type": "tool_result", "tool_use_id": tuid, "content": said, "is_error": error}]}, toolUseResult={"stdout": "x" * 400, "ok": True, **more})


LINES = [
    line(0, type="user", isMeta=True, message={"content": "a note"}),
    answer(1, "m0", 3, {"type": "text", "text": "before any input"}),
    human(2, "fix it"),
    answer(3, "m1", 10, {"type": "thinking", "thinking": "hm", "signature": "abc"}, {"type": "text", "text": "I look"}),
    answer(4, "m1", 120, {"type": "text", "text": "I look"}, use("t1", "Bash", command="make all\nmore", description="build")),
    result(5, "t1", "Exit code 2\nmake: *** [all] Error 1 in /tmp/x", True),
    answer(6, "m2", 7, use("t2", "Edit", file_path="/a.py", old_string="x", new_string="y"), use("t1", "Bash", command="again")),
    result(7, "t2", [{"type": "text", "text": "done"}, {"type": "image", "source": {"data": "QUJD", "media_type": "image/png"}}], agentId="agent123"),
    answer(8, "m2", 7, use("t3", "Bash", command="make all again")),
    result(9, "t3", "Exit code 2\nmake: *** [all] Error 1 in /tmp/y", True, interrupted=True),
    human(10, "go on"),
    answer(11, "m3", 9, {"type": "text", "text": "all done"}, model="m2"),
    {"type": "queue-operation", "operation": "enqueue", "content": "never sent", "sessionId": "s", "timestamp": AT % 50},
]


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.createDataFrame([("s.jsonl", i * 100, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(LINES)], "path string, off long, raw string")
    return events(df).cache()


def test_lines_keep_their_text_and_tools(stored):
    found = {r.off // 100: r for r in stored.collect()}
    assert found[3].text == "[생각] hm\nI look" and found[4].text == "I look\n[Bash]\nbuild\nmake all\nmore"
    assert [(u.tuid, u.idx, u.name, u.fpath, u.cmd) for u in found[6].tool_uses] == [("t2", 0, "Edit", "/a.py", None), ("t1", 1, "Bash", None, "again")]
    r = found[5].tool_results[0]
    assert (r.tuid, r.is_err, r.err_line, r.denial, r.intr, r.link) == ("t1", 1, "exit: make: *** [all] Error 1 in /tmp/x", None, 0, None) and r.err_sig == found[9].tool_results[0].err_sig
    assert found[7].tool_results[0].link == "agent123" and found[9].tool_results[0].intr == 1
    assert found[7].text == "done\n[이미지 생략 base64 4바이트 image/png]"
    assert {s.reason for s in found[7].strips} == {"image_base64", "toolUseResult_copy"} and [s.reason for s in found[3].strips] == ["thinking_signature"]


def test_tools_belong_to_their_first_line(stored):
    calls, found = tools.uses(stored), tools.results(stored)
    assert {(r.tuid, r.off // 100, r.cmd) for r in calls.collect()} == {("t1", 4, "make all"), ("t2", 6, None), ("t3", 8, "make all again")}
    paired = tools.with_calls(found, calls)
    assert {(r.tuid, r.name, r.is_err) for r in paired.collect()} == {("t1", "Bash", 1), ("t2", "Edit", 0), ("t3", "Bash", 1)}
    assert [(r.name, r.cmd) for r in tools.unresolved(paired).collect()] == [("Bash", "make all again")]


def test_cards_own_their_lines(stored):
    made = {r.seq: r for r in cards.assemble(stored).collect()}
    assert [(r.human_kind, r.human, r.delivered) for _, r in sorted(made.items())] == [("no_human", "a note", 1), ("human:typed", "fix it", 1), ("human:typed", "go on", 1), ("qo_human", "never sent", 0)]
    one, two, three, four = (made[k] for k in range(4))
    assert (two.n_events, two.n_asst, two.n_tools, two.tools, two.files, two.cmds) == (8, 2, 4, {"Bash": 3, "Edit": 1}, ["/a.py"], ["make all", "again", "make all again"])
    assert (two.n_err, two.n_err_repeat, two.n_intr, two.tok_out, two.tok_in, two.model, two.dur_s) == (2, 1, 1, 127, 10, "m1", 7.0)
    assert (one.tok_out, three.model, three.last_answer, four.n_events) == (3, "m2", "all done", 1)
    files = stored.select("fid").distinct().withColumn("file_kind", F.lit("session"))
    assert cards.raw_tokens(stored, files).first().tokens == sum(r.tok_out for r in made.values())
    kinds = {r.kind: (r.stored, r.rebuilt, r.added, r.removed) for r in cards.differences(cards.assemble(stored).where("seq < 2"), cards.assemble(stored).where("seq > 0")).collect()}
    assert kinds == {"no_human": (1, 0, 0, 1), "human:typed": (1, 2, 1, 0), "qo_human": (0, 1, 1, 0)}


def test_reduced_lines(spark):
    rows = [
        ({"type": "attachment", "attachment": {"type": "invoked_skills", "skills": [{"name": "a", "content": "body"}]}, "rendered": [1, 2]}, [("dup:rendered", 1, 6), ("skill_body", 1, 4)]),
        ({"type": "user", "toolUseResult": "text", "message": {"usage": {"iterations": [1]}}}, [("dup:usage.iterations", 1, 3), ("toolUseResult_copy", 1, 6)]),
        ({"message": {"content": [{"type": "redacted_thinking", "data": "zz"}]}}, [("thinking_signature", 1, 2)]), ({"a": 1}, []),
    ]
    raw = [json.dumps(r) for r, _ in rows] + ["{broken rendered", None]
    got = [r.x for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i").select(reduction.reduce_line(F.col("raw")).alias("x")).collect()]
    assert [[tuple(s) for s in x.strips] for x in got] == [*(s for _, s in rows), [], []]
    assert json.loads(got[1].raw) == {"type": "user", "toolUseResult": {"_dropped": "str"}, "message": {"usage": {}}} and got[4].raw == raw[4] and got[5].raw is None


def test_texts_of_other_lines(spark):
    said = {
        '{"type":"attachment","attachment":{"type":"goal_status","condition":"x","met":true}}': "목표: x (met=True)",
        '{"type":"attachment","attachment":{"type":"file","filename":"f","content":{"file":{"content":"body"}}}}': "f\nbody",
        '{"type":"attachment","attachment":{"type":"date","day":3}}': '{"day":3}',
        '{"type":"attachment","attachment":{"type":"inlined_image_paths","paths":["a","b"]}}': "a\nb",
        '{"type":"system","subtype":"turn_duration","content":"x"}': "", '{"type":"ai-title","aiTitle":"T"}': "T", '{"type":"frame-link","title":"a","frameUrl":"u"}': "a  u",
        '{"type":"history","display":"typed"}': "typed", '{"type":"started","key":"k"}': '{"key":"k"}',
    }
    df = spark.createDataFrame(list(enumerate(said)), "i int, raw string").orderBy("i")
    got = [r.x for r in df.select(content.line_text(F.try_parse_json("raw"), F.lit("other")).alias("x")).collect()]
    assert got == list(said.values())
    assert df.where("i = 7").select(content.unknown_fields(F.try_parse_json("raw"), ["type"]).alias("x")).first().x == ["history.display"]


def test_background_tasks(spark):
    calls = spark.createDataFrame([("s", 1, "Task ID: a1"), ("s", 2, "Task ID: b2"), ("s", 9, "Task ID: c3"), ("s", 3, "none")], "sid string, ts long, text string")
    notes = spark.createDataFrame([("s", 5, "<task-id>a1</task-id><status>ok</status>"), ("s", 7, "<task-id>a1</task-id><status>failed</status>"), ("s", 4, "<task-id>c3</task-id>")], "sid string, ts long, text string")
    assert {(r.task, r.note_ts, r.status) for r in tools.task_states(calls, notes).collect()} == {("a1", 7, "failed"), ("b2", None, None), ("c3", None, None)}
