import json

import pytest

from scrollmill.functions import rollout


def response(kind, **payload):
    return {"timestamp": "2025-01-01T00:00:00.000Z", "type": "response_item", "payload": {"type": kind, **payload}}


def event(kind, **payload):
    return {"type": "event_msg", "payload": {"type": kind, **payload}}


STATE = [
    response("message", role="user", content=[{"type": "input_text", "text": "early"}]),
    {"type": "session_meta", "payload": {"cwd": "/w", "cli_version": "1.2", "source": "exec", "git": {"branch": "main"}}},
    {"type": "turn_context", "payload": {"model": "m1", "effort": "high", "cwd": 7}},
    response("message", role="user", content=[{"type": "input_text", "text": "late"}]),
    response("message", role="assistant", id="a1", content=[{"type": "output_text", "text": "x"}, {"type": "refusal", "refusal": "no"}, {"type": "other"}]),
    event("task_complete", duration_ms=12.7),
]
REASONS = [
    (None, "blank"), ("  ", "blank"), ("{x", "bad_json"), ("[1]", "not_object"), ({"type": "world_state"}, "codex:world_state"), ({"a": 1}, "codex:type:None"),
    (response("message", role="developer"), "codex:developer"), (response("message", role="x"), "codex:message:x"), (response("reasoning"), "codex:reasoning"),
    (response("tool_search_call"), "codex:tool_search"), (response("new"), "codex:response_item:new"), (event("user_message"), "codex:echo:user_message"),
    (event("agent_reasoning"), "codex:reasoning"), (event("token_count"), "codex:token_count"), (event("odd"), "codex:event:odd"),
    (event("item_completed", item={"type": "AgentMessage"}), "codex:echo:agent_message"), (event("item_completed", item={"type": "Odd"}), "codex:item:Odd"),
    (event("thread_settings_applied"), "codex:thread_settings"),
    (response("message", role="user", content=[{"type": "input_text", "text": "<image name=x>"}, {"type": "input_text", "text": "<permissions x>"}]), "codex:injected:permissions"),
    (response("message", role="user", content=[{"type": "text", "text": "# AGENTS.md instructions for"}]), "codex:injected:agents_md"),
    (response("message", role="user", content=[{"type": "text", "text": "<b> hi"}, {"type": "text", "text": "<permissions x>"}]), None),
]
CALLS = [
    (response("function_call", name="shell", namespace="ns_", call_id="c", arguments='{"command":["bash","-lc","ls"],"z":1}'), [("c", "ns__shell", {"command": ["bash", "-lc", "ls"], "z": 1})]),
    (response("function_call", name="shell", call_id="c", arguments='{"command":["/bin/bash","-lc","ls"],"z":1}'), [("c", "shell", {"command": "ls", "z": 1})]),
    (response("function_call", name="exec_command", call_id="c", arguments='{"cmd":"ls -l"}'), [("c", "exec_command", {"command": "ls -l"})]),
    (response("function_call", name="f", call_id="c", arguments="{bad"), [("c", "f", {"_raw": "{bad"})]),
    (response("local_shell_call", id="i", action={"type": "exec", "command": ["git", "log"], "n": "1"}), [("i", "local_shell", {"command": "git log", "n": "1"})]),
    (response("custom_tool_call", call_id="c", name="apply_patch", input="*** Add File: a.py\n+x\n*** Update File: b\n*** Move to: c \n*** Delete File: b"),
     [("c", "apply_patch", {"content": "*** Add File: a.py\n+x\n*** Update File: b\n*** Move to: c \n*** Delete File: b", "file_path": "a.py"}), ("c#2", "apply_patch", {"file_path": "b"}), ("c#3", "apply_patch", {"file_path": "c"})]),
    (response("custom_tool_call", call_id="c", name="apply_patch"), [("c", "apply_patch", {})]),
    (response("custom_tool_call", call_id="c", name="x", input="body"), [("c", "x", {"content": "body"})]),
    (response("web_search_call", id="w", action={"type": "search", "query": "q"}), [("w", "web_search", {"query": "q"})]),
    (event("item_completed", item={"type": "FileChange", "id": "f", "changes": {"b": 1, "a": 2}}), [("f", "file_change", {"file_path": "a"}), ("f#2", "file_change", {"file_path": "b"})]),
    (event("item_completed", item={"type": "CommandExecution", "id": "e", "command": "ls", "cwd": "/w"}), [("e", "exec_command", {"command": "ls", "workdir": "/w"})]),
]
OUTPUTS = [
    ("plain", "plain", False), ("Chunk ID: 1\nProcess exited with code 2\nOutput:\n\n bad", "Exit code 2\n bad", True), ("Exit code: 0\nWall time: 1\nOutput: x\ny", "x\ny", False),
    ("Exit code: 1\nno head\nOutput:\nx", "Exit code: 1\nno head\nOutput:\nx", False), ('{"output":"o","metadata":{"exit_code":3}}', "Exit code 3\no", True),
    ('{"output":{"a":1}}', '{"a":1}', False), ('{"other":1}', '{"other":1}', False), ([{"type": "output_text", "text": "Script failed: x"}, {"type": "input_image", "image_url": "data:image/png;base64,QUJD"}], "Script failed: x\n[이미지 생략 base64 4바이트 image/png]", True),
    ([], "", False), (None, "null", False), ({"k": 1}, '{"k":1}', False),
]
IDS = [response("function_call", name="f", arguments="{}"), response("message", role="assistant", content=[])]


@pytest.fixture(scope="module")
def read(spark):
    """Every case as a file of its own, all read by one plan."""
    files = {"state": STATE, "ids": IDS} | {f"reason{i}": [x] for i, (x, _) in enumerate(REASONS)} | {f"call{i}": [x] for i, (x, _) in enumerate(CALLS)}
    files |= {f"output{i}": [response("function_call_output", call_id="c", output=x)] for i, (x, _, _) in enumerate(OUTPUTS)}
    rows = [(path, i, x if x is None or isinstance(x, str) else json.dumps(x)) for path, lines in files.items() for i, x in enumerate(lines)]
    found = {}
    for r in rollout.normalised(spark.createDataFrame(rows, "path string, off long, raw string")).orderBy("path", "off").collect():
        found.setdefault(r.path, []).append(r)
    return found


def test_state_is_carried(read):
    found = read["state"]
    assert [(r.kind, r.sub, r.text) for r in found] == [
        ("human", "typed", "early"), ("system", "codex_session_meta", "Codex 세션 시작 (codex 1.2)"), ("system", "codex_turn_context", "model m1 · effort high"),
        ("sdk", "sdk", "late"), ("assistant", "text", "x\nno"), ("system", "turn_duration", None),
    ]
    assert [(r.cwd, r.version, r.model, r.auto) for r in found[3:5]] == [("/w", "1.2", None, True), ("/w", "1.2", "m1", True)]
    assert found[1].branch == "main" and found[4].msg_id == "a1" and found[5].duration_ms == 12 and found[0].cwd is None


def test_reasons(read):
    for i, (line, reason) in enumerate(REASONS):
        found = read[f"reason{i}"][0]
        assert found.reason == reason and (found.kind is None) == (reason is not None), line


def test_calls(read):
    for i, (line, calls) in enumerate(CALLS):
        found = read[f"call{i}"][0]
        assert (found.kind, found.sub) == ("assistant", "tool_use"), line
        assert [(b.id, b.name, json.loads(b.input)) for b in found.blocks] == calls


def test_missing_id_names_file_and_offset(read):
    found = read["ids"]
    assert found[0].blocks[0].id.startswith("cx:") and found[0].blocks[0].id.endswith(":0") and found[1].msg_id.endswith(":1")


def test_outputs(read):
    for i, (_, text, error) in enumerate(OUTPUTS):
        block = read[f"output{i}"][0].blocks[0]
        assert (block.type, block.id, block.text, block.is_error) == ("tool_result", "c", text, error)


def test_heads_and_history(spark):
    heads = spark.createDataFrame(
        [("a", 0, 0, json.dumps({"type": "turn_context", "payload": {"cwd": "/w"}})), ("a", 9, 1, json.dumps({"type": "session_meta", "payload": {"id": "s", "cwd": 3}})), ("b", 0, 0, "{}")],
        "path string, off long, line long, raw string",
    )
    assert [tuple(r) for r in rollout.session_heads(heads).collect()] == [("a", "s", "/w")]
    lines = spark.createDataFrame([("h", 0, '{"session_id":"s","ts":1,"text":"t"}'), ("h", 1, '{"text":1}'), ("h", 2, None)], "path string, off long, raw string")
    assert [(r.sid, r.text, r.reason) for r in rollout.history(lines).orderBy("off").collect()] == [("s", "t", None), (None, None, "codex:history_bad"), (None, None, "codex:history_bad")]
