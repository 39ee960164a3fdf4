import json

from pyspark.sql import functions as F

from scrollmill.functions import lines


def user(content, **more):
    return {"type": "user", "message": {"content": content}, **more}


CASES = [
    (user("x", isCompactSummary=True), "compact", None), (user("x", toolUseResult={}), "tool_result", None), (user("x", toolUseResult=None, isMeta=True), "meta", None),
    (user([{"type": "tool_result", "content": "x"}]), "tool_result", None), (user("hi", isSidechain=True, promptSource="sdk"), "side_user", "sdk"),
    (user([{"type": "text", "text": "[Request interrupted by user]"}], promptSource="typed"), "interrupt", None), (user("hi", promptSource="typed"), "human", "typed"),
    (user("hi", origin={"kind": "human"}), "human", "human"), (user("hi", promptSource="sdk"), "sdk", "sdk"), (user("<task-notification>x"), "task_note", None),
    (user("x", origin={"kind": "peer"}), "peer", "peer"), (user("<teammate-message id=1>"), "peer", None), (user("<bash-input>ls</bash-input>"), "bash_in", None),
    (user("<command-name> /go </command-name><command-args> a </command-args>"), "slash", "/go"), (user("<command-name>/go</command-name><command-args> </command-args>"), "command", None),
    (user("<bash-stdout>x"), "command_out", None), (user(" /compact now "), "slash", "/compact"), (user("/compact"), "command", None), (user("/Users/a b"), "user_other", None),
    (user("/compact", origin={"kind": "x"}), "user_other", "x"), (user(None), "user_other", None), (user([]), "user_other", None),
    ({"type": "assistant", "message": {"content": [{"type": "text"}, {"type": "tool_use"}, {"type": "text"}]}}, "assistant", "text+tool_use"),
    ({"type": "assistant", "message": {"content": "x"}}, "assistant", "text"), ({"type": "assistant"}, "assistant", None), ({"type": "assistant", "isApiErrorMessage": True}, "assistant", "api_error"),
    ({"type": "system", "subtype": "s"}, "system", "s"), ({"type": "attachment", "attachment": {"type": "file"}}, "att", "file"),
    ({"type": "attachment", "attachment": {"type": "queued_command", "commandMode": "prompt", "origin": {"kind": "human"}}}, "queued", "queued_command"),
    ({"type": "queue-operation", "operation": "enqueue", "content": " do"}, "qo_human", "enqueue"), ({"type": "queue-operation", "operation": "enqueue", "content": " <x>"}, "qo", "enqueue"),
    ({"type": "summary"}, "summary", None), ({}, None, None),
]


def test_classify_line(spark):
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(CASES)]
    found = spark.createDataFrame(rows, "i int, raw string").select("i", lines.classify_line(F.try_parse_json("raw")).alias("k")).orderBy("i").collect()
    assert [(CASES[r.i][0], r.k.kind, r.k.sub) for r in found if (r.k.kind, r.k.sub) != CASES[r.i][1:]] == []
