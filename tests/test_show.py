"""Shown cards, lines and documents; sections; workflow calls; written-out values."""

import datetime

from pyspark.sql import functions as F

from scrollmill.operators import show

T = datetime.datetime(2025, 1, 1, 3, 0)
SID = "01234567-aaaa"


def test_every_form_of_a_key(spark):
    c = "key string, sid string, project string, start_ts timestamp, end_ts timestamp, dur_s double, human string, last_answer string, n_tools long, files array<string>, cmds array<string>, n_err long, human_kind string, delivered int"
    cards = spark.createDataFrame([(f"c:{SID}:abc1", SID, "-h-p", T, T, 61.0, "do it", None, 3, ["a\nb"], [], None, "human", 1), (f"c:{SID}:abd2", SID, "-h", T, T, None, "", "done", None, None, None, 2, "sdk", 1), (f"c:{SID}:zz", SID, None, T, T, 1.0, "x", "y", 1, [], ["ls"], 0, "human", 0)], c)
    events = spark.createDataFrame([("e1", "f1", "human", "typed", T, "-h-p", SID, "hello"), ("e2", "f9", "system", None, T, None, None, "")], "key string, fid string, kind string, kind_sub string, ts timestamp, project string, sid string, text string")
    files = spark.createDataFrame([("f1", "session")], "fid string, kind string")
    docs = spark.createDataFrame([("m/a.md", "memory", "-h-p", T, "body")], "path string, kind string, project string, updated timestamp, text string")
    names = ["01234567/abc", "01234567/ab", "01234567/q", f"c:{SID}:abd2", f"{SID}:zz", f"[카드 {SID}:zz]", "e1", " [e2] ", "문서 m/a.md", "m/a.md", "d:none", "nothing", "", None]
    got = {r.asked: r.text for r in show.show(spark.createDataFrame([(n,) for n in names], "asked string"), cards, events, files, docs, "Asia/Seoul", "-h").collect()}
    assert got["01234567/abc"] == f"# 카드 {SID}:abc1\n- 프로젝트 p · 세션 {SID} · 2025-01-01 12:00 ~ 2025-01-01 12:00 KST · 소요 1분 · 도구 3 · 에러 0 · 사람 입력 카드\n\n## 사람 입력\ndo it\n\n## 마지막 답\n(없음)\n\n## 파일 1개\n- a b"
    assert got["01234567/ab"] == f"# 짧은 키가 카드 2장에 걸린다: 01234567/ab\n- 카드 {SID}:abc1\n- 카드 {SID}:abd2"
    assert "자동 실행(claude -p)" in got[f"c:{SID}:abd2"] and "## 사람 입력\n(없음)" in got[f"c:{SID}:abd2"]
    assert got[f"{SID}:zz"] == got[f"[카드 {SID}:zz]"] and "전달 안 된 대기열" in got[f"{SID}:zz"] and got[f"{SID}:zz"].endswith("## 명령 1개\n- ls")
    assert got["e1"] == f"# 행 e1\n- 종류 human/typed · 2025-01-01 12:00 KST · 프로젝트 p · 세션 {SID} · 원천 session\n\nhello"
    assert got[" [e2] "].startswith("# 행 e2\n- 종류 system · ") and got[" [e2] "].endswith("프로젝트 - · 세션 - · 원천 -\n\n(본문 없음)")
    assert got["문서 m/a.md"] == got["m/a.md"] == "# 문서 m/a.md\n- 종류 memory · 프로젝트 p · 갱신 2025-01-01 12:00 KST\n\nbody"
    assert [got[n] for n in ("01234567/q", "d:none", "nothing", "", None)] == [None] * 5 and len(got) == len(set(names))


def test_sections_calls_and_values(spark):
    events = spark.createDataFrame([("k", "compact", None, "1. One:\nbody\n2. Two:\nmore"), ("x", "compact", "why", "1. A:\nb"), ("h", "human", None, "1. A:\nb")], "key string, kind string, excluded string, text string")
    assert sorted((r.ekey, r.part, r.title, r.body) for r in show.compact_sections(events).collect()) == [("k", 1, "One", "body"), ("k", 2, "Two", "more")]
    calls = [("Workflow", '{"workflow_name": " build "}', T), ("Workflow", '{"scriptPath": "/a/flow-wf_0a1-b.js"}', T), ("Workflow", "{bad", T), ("Bash", '{"workflow_name": "no"}', T), ("Workflow", '{"workflow_name": "late"}', T + datetime.timedelta(days=1))]
    uses = spark.createDataFrame([("s", *x) for x in calls], "sid string, name string, input string, ts timestamp")
    assert sorted(r.name for r in show.workflow_calls(uses, F.lit(T), F.lit(T + datetime.timedelta(hours=1))).collect()) == ["build", "flow"]
    cases = {"hunter22": True, "": False, None: False, "[REDACTED:x]": False, "$PW": False, "…cut": False, "String": False, "os.environ": False, "1000:": True, "osmosis": True}
    got = {r.v: r.l for r in spark.createDataFrame([(v,) for v in cases], "v string").select("v", show.literal_value(F.col("v"), F.lit("kv")).alias("l")).collect()}
    assert got == cases
    assert [r[0] for r in spark.createDataFrame([("1000.",), ("pw1",)], "v string").select(show.literal_value(F.col("v"), F.lit("curl_u"))).collect()] == [False, True]
