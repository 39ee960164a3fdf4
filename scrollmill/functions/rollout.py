"""Lines of the second transcript dialect ({timestamp, type, payload}).

``normalised`` gives each line its kind and blocks, or the reason for leaving it
out, and carries the state that session and turn lines set to the lines after
them. Built-in functions only; a file's lines meet in one window, in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import carry
from .text import file_id

# Texts that stand in the user's role but nobody typed, and lines
# that repeat what others hold.
INJECTED_TAGS = ["environment_context", "turn_aborted", "user_instructions", "user_shell_command", "permissions"]
AGENTS_HEAD = "# AGENTS.md instructions"
IMAGE_TAG = r"^\s*(?:<image\b[^>]*>|</image>)\s*$"
ECHOES = """user_message agent_message exec_command_begin exec_command_end exec_command_output_delta patch_apply_begin patch_apply_end
mcp_tool_call_begin mcp_tool_call_end web_search_begin web_search_end item_started view_image_tool_call""".split()
REASONING = ["agent_reasoning", "agent_reasoning_raw_content", "agent_reasoning_section_break"]
SHELL_TOOLS = ["exec_command", "shell", "shell_command", "local_shell"]
INTERRUPTED = "[Request interrupted by user"

# Heads of a command's output, files in a patch, inline images.
EXIT_CODE = r"(?:Process exited with code|Exit code:?)[^\S\n]*(-?[0-9]+)"
OUTPUT_HEAD = (
    r"\A((?:(?:(?:Chunk ID|Wall time|Process exited with code|Process running with session ID|Original token count|Exit code|Total output lines)\b|"
    + EXIT_CODE.replace("(-?", "(?:-?") + r")[^\n]*\n){0,9})Output:[^\S\n]*\n*([\s\S]*)\z"
)
PATCH_FILE = r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+?)[^\S\n]*$"
DATA_URL = r"\Adata:([\w/+.-]+);base64,([\s\S]*)\z"

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,is_error:boolean>>"


def typed(whole: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` if it is a text (object, list); null otherwise."""
    found, starts = F.try_variant_get(whole, path, "variant"), {"string": "STRING", "map<string,variant>": "OBJECT", "array<variant>": "ARRAY"}[kind]
    return F.when(F.schema_of_variant(found).startswith(starts), F.try_variant_get(whole, path, kind))


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block(kind: str, text=None, ident=None, name=None, given=None, error=None) -> Column:
    parts = {"type": F.lit(kind), "text": text, "id": ident, "name": name, "input": given}
    made = [(F.lit(None) if c is None else c).cast("string").alias(k) for k, c in parts.items()]
    return F.struct(*made, (F.lit(None) if error is None else error).cast("boolean").alias("is_error"))


def _image(url: Column) -> Column:
    """What stands for an image: its size and type, never its bytes."""
    data = F.regexp_extract(url, DATA_URL, 2)
    told = F.concat(F.lit("[이미지 생략 base64 "), F.length(data).cast("string"), F.lit("바이트 "), F.regexp_extract(url, DATA_URL, 1), F.lit("]"))
    return F.when(data != "", told).otherwise("[이미지]")


def user_blocks(content: Column) -> Column:
    """Text and image blocks of array<variant>; the tags that wrap images go."""
    kind, said = (lambda x: typed(x, "$.type")), (lambda x: F.coalesce(typed(x, "$.text"), F.lit("")))
    is_text = lambda x: kind(x).isin("input_text", "text")
    kept = F.filter(content, lambda x: (is_text(x) & ~said(x).rlike(IMAGE_TAG)) | (kind(x) == "input_image"))
    return F.transform(kept, lambda x: F.when(is_text(x), _block("text", said(x))).otherwise(_block("image", _image(typed(x, "$.image_url")))))


def injected(content: Column) -> Column:
    """The reason for which the first text that wraps no image was not typed."""
    texts = F.filter(F.transform(user_blocks(content), lambda b: F.when(b["type"] == "text", b["text"])), lambda x: x.isNotNull())

    def judge(text: Column) -> Column:
        tag = F.regexp_extract(text, r"^\s*<([a-z_]+)[\s>]", 1)
        return F.when(text.startswith(AGENTS_HEAD), "codex:injected:agents_md").when(tag.isin(INJECTED_TAGS), F.concat(F.lit("codex:injected:"), tag))

    return _once(F.get(texts, F.lit(0)), judge)


def command_text(whole: Column, path: str) -> Column:
    """A command as text: ``bash -lc X`` is X, other lists are joined by spaces."""
    def words(parts: Column) -> Column:
        said = F.transform(parts, lambda x: typed(x, "$"))
        shell = (F.size(said) == 3) & F.get(said, F.lit(1)).isin("-lc", "-c") & F.get(said, F.lit(0)).rlike(r"(?:\A|/)(?:bash|sh|zsh)\z")
        return F.when(~F.exists(said, lambda x: x.isNull()), F.when(shell, F.get(said, F.lit(2))).otherwise(F.array_join(said, " ")))

    return F.coalesce(typed(whole, path), _once(typed(whole, path, "array<variant>"), words))


def patch_blocks(ident: Column, name: str, files: Column, patch: Column | None = None) -> Column:
    """One call for each file; the first carries the patch. No file: one call."""
    some = F.when(F.size(files) > 0, files).otherwise(F.array(F.lit(None).cast("string")))
    text = F.lit(None).cast("string") if patch is None else F.nullif(patch, F.lit(""))
    given = lambda f, i: F.to_json(F.struct(F.when(i == 0, text).alias("content"), f.alias("file_path")))
    named = lambda i: F.when(i == 0, ident).otherwise(F.concat(ident, F.lit("#"), (i + 1).cast("string")))
    return F.transform(some, lambda f, i: _block("tool_use", ident=named(i), name=F.lit(name), given=given(f, i)))


def output_parts(text: Column) -> Column:
    """struct<code long, body string> of a command's output; without the known
    head lines up to ``Output:`` the whole text is the body."""
    codes = F.regexp_extract_all(F.regexp_extract(text, OUTPUT_HEAD, 1), F.lit("(?m)^" + EXIT_CODE), 1)
    code = F.get(codes, F.size(codes) - 1).try_cast("long")
    return F.struct(code.alias("code"), F.when(text.rlike(OUTPUT_HEAD), F.regexp_extract(text, OUTPUT_HEAD, 2)).otherwise(text).alias("body"))


def result_block(whole: Column, ident: Column) -> Column:
    """The block of a tool's output; an exit code other than 0 heads the text."""
    def told(p: Column) -> Column:
        wrong = p["code"] != 0
        text = F.when(wrong, F.concat(F.lit("Exit code "), p["code"].cast("string"), F.lit("\n"), p["body"])).otherwise(p["body"])
        return _block("tool_result", text, ident, error=F.coalesce(wrong, F.lit(False)))

    def from_text(text: Column) -> Column:
        return _once(F.when(text.startswith("{"), F.try_parse_json(text)), lambda inner: _once(chosen(text, inner), told))

    def chosen(text: Column, inner: Column) -> Column:
        body = F.coalesce(typed(inner, "$.output"), F.try_variant_get(inner, "$.output", "string"), F.lit("null"))
        code = F.when(F.schema_of_variant(F.try_variant_get(inner, "$.metadata.exit_code", "variant")) == "BIGINT", F.try_variant_get(inner, "$.metadata.exit_code", "long"))
        has = F.array_contains(F.map_keys(F.try_variant_get(inner, "$", "map<string,variant>")), "output")
        return F.when(F.coalesce(has, F.lit(False)), F.struct(code.alias("code"), body.alias("body"))).otherwise(output_parts(text))

    def from_list(items: Column) -> Column:
        kind, texts = (lambda x: typed(x, "$.type")), ["input_text", "output_text", "text"]
        kept = F.filter(items, lambda x: kind(x).isin(*texts, "input_image", "output_image"))
        said = F.transform(kept, lambda x: F.when(kind(x).isin(texts), F.coalesce(typed(x, "$.text"), F.lit(""))).otherwise(_image(typed(x, "$.image_url"))))
        failed = F.coalesce(F.get(said, F.lit(0)).startswith("Script failed"), F.lit(False))
        return _block("tool_result", F.array_join(said, "\n"), ident, error=failed)

    text, items = typed(whole, "$.payload.output"), typed(whole, "$.payload.output", "array<variant>")
    other = _block("tool_result", F.coalesce(F.try_variant_get(whole, "$.payload.output", "string"), F.lit("null")), ident, error=F.lit(False))
    return F.when(text.isNotNull(), _once(text, from_text)).when(items.isNotNull(), _once(items, from_list)).otherwise(other)


def _given(fields: Column, without: list[str], command: Column | None = None) -> Column:
    """JSON text of an object's fields, some left out, a command put in."""
    kept = F.map_filter(fields, lambda k, _: ~k.isin(without))
    if command is not None:
        put = F.when(command.isNotNull(), F.map_from_arrays(F.array(F.lit("command")), F.array(F.try_parse_json(F.to_json(F.struct(command.alias("c")))))))
        put = F.transform_values(put, lambda _, v: F.try_variant_get(v, "$.c", "variant"))
        kept = F.coalesce(F.map_concat(F.map_filter(kept, lambda k, _: k != "command"), put), kept)
    return F.to_json(kept)


def _calls(v: Column, payload: Column, own: Column) -> Column:
    """Blocks of the lines that call a tool; null for others."""
    def ident(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(typed(v, p), F.lit("")) for p in paths], own)

    call, space = ident("$.payload.call_id"), typed(v, "$.payload.namespace")
    name = F.coalesce(typed(v, "$.payload.name"), F.lit("?"))
    name = F.when(space != "", F.concat(F.regexp_replace(space, "_+$", ""), F.lit("__"), name)).otherwise(name)
    said = typed(v, "$.payload.arguments")
    raw = F.to_json(F.struct(F.coalesce(said, F.try_variant_get(v, "$.payload.arguments", "string")).alias("_raw")))
    args = F.coalesce(F.try_parse_json(said), F.try_variant_get(v, "$.payload.arguments", "variant"))

    def function(a: Column) -> Column:
        fields = typed(a, "$", "map<string,variant>")
        key = F.when(F.array_contains(F.map_keys(fields), "cmd"), F.lit("cmd")).otherwise("command")
        command = F.when(key == "cmd", command_text(a, "$.cmd")).otherwise(command_text(a, "$.command"))
        shell = F.when(key == "cmd", _given(fields, ["cmd"], command)).otherwise(_given(fields, ["command"], command))
        return F.coalesce(F.when(name.isin(SHELL_TOOLS), shell), F.to_json(fields), raw)

    action = typed(v, "$.payload.action", "map<string,variant>")
    patch = F.coalesce(typed(v, "$.payload.input"), F.lit(""))
    custom = F.coalesce(F.to_json(F.struct(F.nullif(patch, F.lit("")).alias("content"))), F.lit("{}"))
    item = typed(v, "$.payload.item.type")
    changes = F.coalesce(
        F.array_sort(F.map_keys(typed(v, "$.payload.item.changes", "map<string,variant>"))),
        F.filter(F.transform(typed(v, "$.payload.item.changes", "array<variant>"), lambda x: typed(x, "$.path")), lambda x: x.isNotNull()),
        F.expr("cast(array() as array<string>)"),
    )
    ran = F.to_json(F.struct(command_text(v, "$.payload.item.command").alias("command"), typed(v, "$.payload.item.cwd").alias("workdir")))
    one = lambda *a, **k: F.array(_block("tool_use", *a, **k))
    return (
        F.when(payload == "function_call", one(ident=call, name=name, given=_once(args, function)))
        .when(payload == "local_shell_call", one(ident=ident("$.payload.call_id", "$.payload.id"), name=F.lit("local_shell"), given=F.coalesce(_given(action, ["type", "command"], command_text(v, "$.payload.action.command")), F.lit("{}"))))
        .when((payload == "custom_tool_call") & (name == "apply_patch"), patch_blocks(call, "apply_patch", F.array_distinct(F.regexp_extract_all(patch, F.lit(PATCH_FILE), 1)), patch))
        .when(payload == "custom_tool_call", one(ident=call, name=name, given=custom))
        .when(payload == "web_search_call", one(ident=ident("$.payload.id"), name=F.lit("web_search"), given=F.coalesce(_given(action, ["type"]), F.lit("{}"))))
        .when((payload == "item_completed") & (item == "CommandExecution"), one(ident=ident("$.payload.item.id"), name=F.lit("exec_command"), given=ran))
        .when((payload == "item_completed") & (item == "FileChange"), patch_blocks(ident("$.payload.item.id"), "file_change", changes))
    )


def _reason(v: Column, t: Column, p: Column) -> Column:
    """Why a line is left out; null if it is kept."""
    role, item = typed(v, "$.payload.role"), typed(v, "$.payload.item.type")
    tail = lambda head, c: F.concat(F.lit(f"codex:{head}:"), F.coalesce(c, F.lit("None")))
    message = (
        F.when(role == "user", injected(typed(v, "$.payload.content", "array<variant>"))).when(role == "assistant", F.lit(None))
        .when(role.isin("developer", "system"), "codex:developer").otherwise(tail("message", role))
    )
    kept = ["function_call", "local_shell_call", "custom_tool_call", "function_call_output", "custom_tool_call_output", "local_shell_call_output", "web_search_call"]
    response = (
        F.when(p == "message", message).when(p == "reasoning", "codex:reasoning").when(p.isin(kept), F.lit(None))
        .when(p.isin("tool_search_call", "tool_search_output"), "codex:tool_search").otherwise(tail("response_item", p))
    )
    completed = (
        F.when(item.isin("CommandExecution", "FileChange"), F.lit(None)).when(item == "UserMessage", "codex:echo:user_message")
        .when(item == "AgentMessage", "codex:echo:agent_message").when(item == "Reasoning", "codex:reasoning").otherwise(tail("item", item))
    )
    event = (
        F.when(p.isin(ECHOES), tail("echo", p)).when(p.isin(REASONING), "codex:reasoning").when(p.isin("token_count", "task_started"), F.concat(F.lit("codex:"), p))
        .when(p.isin("task_complete", "turn_aborted", "context_compacted"), F.lit(None)).when(p == "item_completed", completed)
        .when(p == "thread_settings_applied", "codex:thread_settings").otherwise(tail("event", p))
    )
    return (
        F.when(t.isin("session_meta", "turn_context", "compacted"), F.lit(None)).when(t == "response_item", response).when(t == "event_msg", event)
        .when(t == "world_state", "codex:world_state").otherwise(tail("type", t))
    )


#: What session and turn lines set for the lines after them.
STATE = {"sid": "string", "cwd": "string", "version": "string", "model": "string", "auto": "boolean"}


def normalised(lines: DataFrame, before: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, off, raw) to one row per line: ``reason`` why it is left out or
    null, type, sub, kind, ts, blocks, text, msg_id, duration_ms, and the state
    sid, cwd, version, model, auto. Blank, broken and non-object lines keep a reason.

    ``before`` (path and the state) is what earlier batches left of files that
    these lines go on with: it stands before a file's first line. ``also`` names
    columns of ``lines`` that stay.
    """
    v, t, p, own = F.col("v"), F.col("t"), F.col("p"), F.concat(F.lit("cx:"), F.col("fid"), F.lit(":"), F.col("off").cast("string"))
    at = lambda path: typed(v, f"$.payload.{path}")
    parsed = lines.select("path", "off", *also, file_id(F.col("path")).alias("fid"), (F.trim(F.coalesce("raw", F.lit(""))) == "").alias("blank"), F.try_parse_json("raw").alias("v"))
    parsed = parsed.withColumn("t", typed(v, "$.type")).withColumn("p", typed(v, "$.payload.type"))
    bad = F.when(F.col("blank"), "blank").when(v.isNull(), "bad_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")

    meta, turn = t == "session_meta", t == "turn_context"
    mode = F.coalesce((at("source") == "exec"), F.lit(False)) | F.coalesce((at("originator") == "codex_exec"), F.lit(False))
    held = parsed.select(
        "path", "off", *also, "fid", "v", "t", "p", F.coalesce(bad, _reason(v, t, p)).alias("reason"),
        F.when(meta | turn, at("cwd")).alias("s_cwd"), F.when(meta, at("cli_version")).alias("s_version"), F.when(turn, at("model")).alias("s_model"), F.when(meta, mode).alias("s_auto"),
        F.when(meta, at("id")).alias("s_sid"), F.lit(True).alias("read"),
    )
    if before is not None:
        kept = before.join(lines.select("path").distinct(), "path", "left_semi")
        held = held.unionByName(kept.select("path", F.lit(-1).cast("long").alias("off"), *(F.col(c).cast(kind).alias(f"s_{c}") for c, kind in STATE.items()), F.lit(False).alias("read")), allowMissingColumns=True)
    for name in STATE:
        held = carry(held, "path", ["off"], F.col(f"s_{name}"), name)
    held = held.where("read").withColumn("auto", F.coalesce("auto", F.lit(False)))

    message, role = p == "message", at("role")
    text_block = lambda c: F.array(_block("text", c))
    answer = F.transform(
        F.filter(typed(v, "$.payload.content", "array<variant>"), lambda x: typed(x, "$.type").isin("output_text", "text", "refusal")),
        lambda x: _block("text", F.coalesce(F.nullif(typed(x, "$.text"), F.lit("")), typed(x, "$.refusal"), F.lit(""))),
    )
    settings = F.concat_ws(" · ", *[F.concat(F.lit(f"{k} "), at(k)) for k in ("model", "effort", "approval_policy")])
    started = F.concat(F.lit("Codex 세션 시작 ("), F.coalesce(at("originator"), F.lit("codex")), F.lit(" "), F.coalesce(at("cli_version"), F.lit("?")), F.lit(")"))
    aborted = F.concat(F.lit(INTERRUPTED + "] codex: "), F.coalesce(F.nullif(at("reason"), F.lit("")), F.lit("aborted")))
    blocks = (
        F.when(meta, text_block(started)).when(turn, text_block(settings)).when(t == "compacted", text_block(F.coalesce(at("message"), F.lit(""))))
        .when(message & (role == "user"), user_blocks(typed(v, "$.payload.content", "array<variant>"))).when(message, answer)
        .when(p.isin("function_call_output", "custom_tool_call_output", "local_shell_call_output"), F.array(result_block(v, at("call_id"))))
        .when(p == "turn_aborted", text_block(aborted)).when(p == "context_compacted", text_block(F.lit("Conversation compacted"))).otherwise(_calls(v, p, own))
    )
    kept = F.col("reason").isNull()
    read = held.withColumn("blocks", F.when(kept, blocks).cast(BLOCKS))
    typed_text = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    answered = message & (role == "assistant")
    kind = (
        F.when(meta | turn | p.isin("task_complete", "context_compacted"), "system").when(t == "compacted", "compact").when(p.endswith("_output"), "tool_result")
        .when(p == "turn_aborted", "interrupt").when(message & (role == "user"), F.when(typed_text.startswith(INTERRUPTED), "interrupt").when(F.col("auto"), "sdk").otherwise("human")).otherwise("assistant")
    )
    sub = (
        F.when(meta, "codex_session_meta").when(turn, "codex_turn_context").when(p == "task_complete", "turn_duration").when(p == "context_compacted", "compact_boundary")
        .when(F.col("kind") == "human", "typed").when(F.col("kind") == "sdk", "sdk").when(F.col("kind") == "assistant", F.nullif(F.array_join(F.array_distinct(F.col("blocks.type")), "+"), F.lit("")))
    )
    msg_id = F.when(answered, F.coalesce(F.nullif(at("id"), F.lit("")), own))
    shown = F.array_join(F.filter(F.col("blocks.text"), lambda x: x.isNotNull() & (x != "")), "\n")
    return read.withColumn("kind", F.when(kept, kind)).select(
        "path", "off", *also, "reason", "kind", F.when(kept, sub).alias("sub"), F.try_to_timestamp(typed(v, "$.timestamp")).alias("ts"), "blocks", shown.alias("text"),
        F.when(kept, msg_id).alias("msg_id"), F.when(msg_id.isNotNull() & kept, F.col("model")).alias("model"), "sid", "cwd", "version", F.col("model").alias("state_model"), "auto",
        F.when(p == "task_complete", F.coalesce(F.try_variant_get(v, "$.payload.duration_ms", "long"), F.lit(0))).alias("duration_ms"),
        F.when(kept & meta, typed(v, "$.payload.git.branch")).alias("branch"),
    )


def session_heads(lines: DataFrame, first: int = 64) -> DataFrame:
    """path, sid, cwd of each file: the first values its first lines name."""
    head = lines.withColumn("v", F.try_parse_json("raw")).withColumn("t", typed(F.col("v"), "$.type"))
    named = head.where(F.col("t").isin("session_meta", "turn_context") & (F.col("line") < first))
    sid, cwd = F.when(F.col("t") == "session_meta", typed(F.col("v"), "$.payload.id")), typed(F.col("v"), "$.payload.cwd")
    found = named.select("path", "off", sid.alias("sid"), cwd.alias("cwd"))
    return found.groupBy("path").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("off"))).alias(c) for c in ("sid", "cwd")])


def history(lines: DataFrame) -> DataFrame:
    """path, off, sid, ts, text of prompt history lines; ``reason`` if unusable."""
    v = F.col("v")
    text = typed(v, "$.text")
    return lines.withColumn("v", F.try_parse_json("raw")).select(
        "path", "off", typed(v, "$.session_id").alias("sid"), F.timestamp_seconds(F.try_variant_get(v, "$.ts", "double")).alias("ts"), text.alias("text"),
        F.when(text.isNull(), "codex:history_bad").alias("reason"),
    )
