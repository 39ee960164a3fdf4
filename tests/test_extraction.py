import json

import pytest
from pyspark.sql import functions as F

from scrollmill.functions import extraction as ex
from scrollmill.functions import text


def one(spark, made, *values):
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return frame.select(made(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "line"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("<tool_use_error>File missing</tool_use_error>\nmore", "File missing"), ("Exit code 2", "Exit code 2"),
        ("Exit code 1\n\n  grep: no\nx", "exit: grep: no"),
        ("Traceback (most recent call last)\n File x\nKeyError: 'a'\nnote", "Traceback: KeyError: 'a'"),
        ("Exit code 1\nTraceback (most recent call last):\n File x\nlast", "exit: Traceback: last"),
    ],
)
def test_error_head(spark, given, line):
    assert one(spark, ex.error_head, given) == line


@pytest.mark.parametrize(
    ("given", "line"),
    [("open '/tmp/a b' failed 12 [REDACTED:email]", "open '<q>' failed <n> <r>"), ('deadbeef1 "x y"', '<hex> "<q>"'), ("C:/x/y.py:3", "<path>:<n>")],
)
def test_error_rewrites(spark, given, line):
    assert one(spark, text.error_line, given) == line


def test_index_body(spark):
    body = lambda *v: one(spark, ex.index_body, *v)
    assert body("human", None, "x" * 30000) == "x" * 30000
    assert body("assistant", "text", "x" * 30000) == "x" * 20000
    assert body("tool_result", None, "a" * 2500 + "b" * 1000) == "a" * 2500 + "\n…\n" + "b" * 500
    assert body("system", "informational", "x" * 5000) == "x" * 4000
    assert body("system", "turn_duration", "x") is None and body("meta", None, "x") is None
    assert body("human", None, "") is None and body("human", None, None) is None and body(None, None, "x") is None


def test_queue_key(spark):
    key = lambda *v: one(spark, ex.queue_key, *v)
    assert key("bash_in", "<bash-input> ls  -l </bash-input>") == "ls -l"
    assert key("slash", "<command-name>/go</command-name> <command-args> a  b </command-args>") == "/go a b"
    assert key("slash", "<command-name>/go</command-name><command-args> </command-args>") == "/go"
    assert key("human", "! see [Image #1] this\n") == "see this"
    assert key("human", None) == "" and len(key("human", "y" * 900)) == 300


def test_summary_sections(spark):
    found = one(spark, ex.summary_sections, "intro\n## 1. First:\na\n3. not a heading\n## 2. Second\n\nb\n## 9. Out of turn\nc")
    assert [tuple(r) for r in found] == [(1, "First", "a\n3. not a heading", "md"), (2, "Second", "b\n## 9. Out of turn\nc", "md")]
    found = one(spark, ex.summary_sections, "1. Current Work (now):\nx\n2. Next Step:\n")
    assert [tuple(r) for r in found] == [(1, "Current Work", "x", "colon"), (2, "Next Step", "", "colon")]
    assert one(spark, ex.summary_sections, None) == [] and one(spark, ex.summary_sections, "plain") == []


def summary(spark, name, given):
    frame = spark.createDataFrame([(name, given)], "n string, g string").withColumn("s", ex.tool_summary(F.col("n"), F.col("g")))
    row = frame.select("s.fields", "s.todos", ex.tool_text(F.col("n"), F.col("s")).alias("text")).first()
    return row.fields, row.todos, row.text


def test_tool_summary(spark):
    fields, todos, shown = summary(spark, "Bash", json.dumps({"command": "c" * 3000, "description": "why", "run_in_background": True, "prompt": 7, "other": 1}))
    assert fields == {"command": "c" * 2000, "description": "why", "run_in_background": "true"} and todos is None
    assert shown == "[Bash]\nwhy\n" + "c" * 2000
    fields, todos, shown = summary(spark, "TodoWrite", json.dumps({"todos": [{"content": "do", "status": "pending"}]}))
    assert fields == {} and shown == "[TodoWrite]\n- [pending] do"
    assert summary(spark, "MultiEdit", json.dumps({"file_path": "f", "edits": [{}, {}]}))[0] == {"file_path": "f", "edits": "2"}
    assert summary(spark, "Workflow", json.dumps({"script": "name: 'w1' x"}))[0] == {"workflow_name": "w1", "script_head": "name: 'w1' x"}
    assert summary(spark, "Other", '{"x":1}')[2] == '[Other]\n{"x":1}'
    assert summary(spark, "Other", "[1]")[0] == {"_raw": "[1]"} and summary(spark, "Other", "{bad")[0] == {"_raw": "{bad"}
