"""What a kept line of the first dialect says: its text, tool calls and results.

Works on the line as a variant, after redaction. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extraction, text
from .rollout import INTERRUPTED, typed

# Tools that change a file or run a command, marks of a refusal, and
# the harness' own words, which are no error of the work.
CHANGE_TOOLS, COMMAND_TOOLS = ["Write", "Edit", "MultiEdit", "NotebookEdit", "apply_patch", "file_change"], ["Bash", "exec_command", "shell", "shell_command", "local_shell"]
DENIALS = ["The user doesn't want to proceed with this tool use", "Permission for this action was denied", "Permission to use", "User rejected"]
HARNESS = (
    "(?i)Blocked: sleep|Permission (?:to use|denied)|denied by|doesn't want to proceed|user (?:rejected|denied)|Auto mode|classifier|requires approval"
    "|A hook blocked|Operation stopped by hook|tool use was rejected"
)
THOUGHT, IMAGE_HEAD, IMAGE = "[생각] ", "[이미지", "[이미지]"
LISTED, EMPTY = "array<variant>", "cast(array() as array<string>)"


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def image(b: Column) -> Column:
    data = typed(b, "$.source.data")
    return F.when(data.startswith(IMAGE_HEAD), data).otherwise(IMAGE)


def blocks(v: Column, path: str = "$.message.content") -> Column:
    """The blocks of a content; a plain text is one block of text."""
    one = F.array(F.try_parse_json(F.to_json(F.struct(F.lit("text").alias("type"), typed(v, path).alias("text")))))
    listed = F.filter(typed(v, path, LISTED), lambda b: F.schema_of_variant(b).startswith("OBJECT"))
    return F.when(typed(v, path).isNotNull(), one).otherwise(F.coalesce(listed, F.expr("cast(array() as array<variant>)")))


def user_text(v: Column, path: str = "$.message.content") -> Column:
    kind = lambda b: typed(b, "$.type")
    return _filled(F.transform(blocks(v, path), lambda b: F.when(kind(b) == "text", typed(b, "$.text")).when(kind(b) == "image", image(b))))


def result_text(b: Column) -> Column:
    """What a tool gave back: a text, or texts, images and references in order."""
    kind = lambda x: typed(x, "$.type")
    part = lambda x: (
        F.when(kind(x) == "text", F.coalesce(typed(x, "$.text"), F.lit(""))).when(kind(x) == "image", image(x))
        .when(kind(x) == "tool_reference", F.concat(F.lit("[tool_reference "), F.coalesce(typed(x, "$.tool_name"), F.lit("")), F.lit("]")))
    )
    listed = F.filter(F.transform(typed(b, "$.content", LISTED), part), lambda x: x.isNotNull())
    return F.coalesce(typed(b, "$.content"), F.array_join(listed, "\n"), F.lit(""))


def tool_uses(v: Column) -> Column:
    """array<struct<tuid, idx, name, fpath, cmd, shown, summary>> of an answer."""
    def one(b: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(typed(b, "$.name"), F.lit("")), F.lit("?"))

        def told(s: Column) -> Column:
            field = lambda k: F.element_at(s["fields"], F.lit(k))
            return F.struct(
                typed(b, "$.id").alias("tuid"), i.alias("idx"), name.alias("name"),
                F.when(name.isin(CHANGE_TOOLS), F.coalesce(field("file_path"), field("notebook_path"))).alias("fpath"),
                F.when(name.isin(COMMAND_TOOLS), text.first_line(field("command"), 160)).alias("cmd"),
                extraction.tool_text(name, s).alias("shown"), s.alias("summary"),
            )

        given = F.to_json(F.struct(F.try_variant_get(b, "$.input", "variant").alias("x")))
        return F.when(typed(b, "$.type") == "tool_use", _bound(extraction.tool_summary(name, F.regexp_extract(given, r'^\{"x":([\s\S]*)\}$', 1)), told))

    return F.filter(F.transform(blocks(v), one), lambda x: x.isNotNull())


def tool_results(v: Column) -> Column:
    """array<struct<tuid, is_err, err_line, err_sig, denial, intr, link, text>>.

    The signature is of the whole error line, the stored line its first 300
    characters; a link is the agent or run that the call started.
    """
    cut, denied = typed(v, "$.toolUseResult.agentId"), typed(v, "$.toolDenialKind")
    stopped = F.coalesce(F.try_variant_get(v, "$.toolUseResult.interrupted", "boolean"), F.lit(False))

    def one(b: Column) -> Column:
        def told(said: Column) -> Column:
            failed = F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))
            head = extraction.error_head(said)
            refused = reduce(lambda x, y: x | y, (F.substring(said, 1, 300).contains(m) for m in DENIALS))
            found = [F.nullif(F.regexp_extract(F.substring(said, 1, n), p, 1), F.lit("")) for n, p in ((600, r"agentId:\s*([0-9a-z]{8,32})"), (1200, r"\b(wf_[0-9a-f]{8}-[0-9a-f]{3})\b"))]
            return F.struct(
                typed(b, "$.tool_use_id").alias("tuid"), failed.cast("int").alias("is_err"), F.when(failed, F.substring(head, 1, 300)).alias("err_line"),
                F.when(failed, text.error_signature(head)).alias("err_sig"), F.coalesce(F.nullif(denied, F.lit("")), F.when(refused, "text")).alias("denial"),
                (stopped | F.substring(said, 1, 400).contains(f"{INTERRUPTED} for tool use]")).cast("int").alias("intr"),
                F.coalesce(F.nullif(cut, F.lit("")), F.nullif(typed(v, "$.toolUseResult.runId"), F.lit("")), *found).alias("link"), said.alias("text"),
            )

        return F.when(typed(b, "$.type") == "tool_result", _bound(result_text(b), told))

    return F.filter(F.transform(blocks(v), one), lambda x: x.isNotNull())


def _without_type(v: Column, path: str, cap: int) -> Column:
    fields = F.map_filter(typed(v, path, "map<string,variant>"), lambda k, _: k != "type")
    return F.substring(F.to_json(fields), 1, cap)


def attachment_text(v: Column) -> Column:
    kind, at = typed(v, "$.attachment.type"), lambda p: typed(v, f"$.attachment.{p}")
    of = lambda p: F.coalesce(at(p), F.lit(""))
    met = F.coalesce(F.initcap(F.try_variant_get(v, "$.attachment.met", "string")), F.lit("None"))
    names = F.transform(typed(v, "$.attachment.skills", LISTED), lambda s: F.coalesce(typed(s, "$.name"), F.lit("None")))
    return (
        F.when(kind == "queued_command", F.coalesce(at("prompt"), user_text(v, "$.attachment.prompt")))
        .when(kind == "edited_text_file", F.concat(of("filename"), F.lit("\n"), of("snippet"))).when(kind == "file", F.concat(of("filename"), F.lit("\n"), of("content.file.content")))
        .when(kind == "goal_status", F.concat(F.lit("목표: "), F.coalesce(at("condition"), F.lit("None")), F.lit(" (met="), met, F.lit(")")))
        .when(kind == "invoked_skills", F.concat(F.lit("스킬: "), F.array_join(F.coalesce(names, F.expr(EMPTY)), ", ")))
        .when(kind == "inlined_image_paths", F.array_join(F.transform(typed(v, "$.attachment.paths", LISTED), lambda p: F.try_variant_get(p, "$", "string")), "\n"))
        .when(kind == "compact_file_reference", of("filename")).otherwise(_without_type(v, "$.attachment", 2000))
    )


def line_text(v: Column, kind: Column) -> Column:
    """The text of a line of any type; never null."""
    t, of = typed(v, "$.type"), lambda p: F.coalesce(typed(v, f"$.{p}"), F.lit(""))
    part = lambda b: typed(b, "$.type")
    thought = lambda b: F.when(typed(b, "$.thinking").rlike(r"\S"), F.concat(F.lit(THOUGHT), typed(b, "$.thinking")))
    given = F.transform(blocks(v), lambda b: F.when(part(b) == "tool_result", result_text(b)).when(part(b) == "text", typed(b, "$.text")))

    def answered(uses: Column) -> Column:
        shown = lambda i: F.get(F.transform(F.filter(uses, lambda u: u["idx"] == i), lambda u: u["shown"]), F.lit(0))
        return _filled(F.transform(blocks(v), lambda b, i: F.when(part(b) == "text", typed(b, "$.text")).when(part(b) == "thinking", thought(b)).when(part(b) == "tool_use", shown(i))))

    title = F.coalesce(*(F.nullif(typed(v, f"$.{p}"), F.lit("")) for p in ("aiTitle", "customTitle", "title")), F.lit(""))
    return F.coalesce(
        F.when(kind == "unknown", F.substring(F.to_json(F.struct(v.alias("x"))), 6, 20000))
        .when((t == "user") & (kind == "tool_result"), _filled(given)).when(t == "user", user_text(v)).when(t == "assistant", _bound(tool_uses(v), answered))
        .when((t == "system") & (of("subtype") == "turn_duration"), "").when(t.isin("system", "queue-operation"), of("content")).when(t == "attachment", attachment_text(v))
        .when(t.isin("ai-title", "custom-title"), title).when(t == "history", of("display")).when(t == "summary", of("summary"))
        .when(t == "frame-link", F.trim(F.concat_ws(" ", of("title"), of("path"), of("frameUrl")))).when(t.isin("launched", "started", "result"), _without_type(v, "$", 20000))
        .when(t == "permission-mode", of("permissionMode")).when(t == "mode", of("mode")).when(t == "agent-setting", of("agentSetting")), F.lit(""),
    )


def unknown_fields(v: Column, known: list[str]) -> Column:
    """array<string>: ``type.field`` for the fields of a line that are not known."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.transform(F.filter(names, lambda k: ~k.isin(known)), lambda k: F.concat_ws(".", typed(v, "$.type"), k))
