"""What is taken out of a line: its error line, index text, queue key, summary
sections and the telling part of a tool's input. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks in tool output.
TAG = r"</?[a-z_]+(?:-[a-z_]+)*>"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]"
EXIT_LINE = r"^Exit code [0-9]+$"
EXCEPTION_LINE = r"^[A-Za-z_][\w.]*(?:Error|Exception|Exit|Interrupt|Warning)\b"
TRACEBACK = "Traceback (most recent call last)"

# How much of a text of each kind is indexed (None: all of it),
# and the subtypes of two kinds that are indexed at all.
INDEX_CAPS = {
    **dict.fromkeys(["human", "sdk", "bash_in", "slash", "queued", "qo_human", "compact", "history"]),
    "assistant": 20000, "system": 4000, "att": 3000,
    **dict.fromkeys(["interrupt", "task_note", "peer", "user_other", "command_out", "side_user"], 3000),
    **dict.fromkeys(["result", "started", "launched", "unknown"], 4000),
    **dict.fromkeys(["frame-link", "summary"], 1000),
}
INDEXED_SUBTYPES = {
    "system": ["away_summary", "informational", "local_command", "api_error", "model_refusal_fallback", "scheduled_task_fire", "compact_boundary"],
    "att": ["edited_text_file", "file", "goal_status", "structured_output", "task_reminder"],
}

# Fields of a tool's input that are kept, with their caps, and the
# order in which they are shown.
SCALAR_FIELDS = "command description file_path notebook_path subagent_type name pattern path url query skill args task_id run_in_background model to summary".split()
TEXT_FIELDS = {"prompt": 1500, "content": 1500, "old_string": 500, "new_string": 500, "message": 800, "new_source": 800}
SHOWN_FIELDS = "description command file_path notebook_path pattern path url query skill args subagent_type name workflow_name prompt content old_string new_string message summary _raw".split()

# Headings of a compacted summary.
MARKDOWN_HEADING = r"^#{1,4}\s*([0-9]{1,2})\.\s+(.+?)\s*$"
COLON_HEADING = r"^([0-9]{1,2})\.\s+([A-Z][A-Za-z0-9 &/,'-]{2,60}?)(?:\s*\([^)]{0,60}\))?\s*:\s*$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def error_head(text: Column) -> Column:
    """The line that names an error: tags go, an exit code gives way to the line
    after it, a traceback to its last exception. Null and blank texts: empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "")
    lines = F.filter(F.transform(F.split(bare, LINE_END), _strip), lambda x: x != "")

    def choose(found: Column) -> Column:
        exited = F.get(found, F.lit(0)).rlike(EXIT_LINE) & (F.size(found) > 1)
        kept = F.when(exited, F.slice(found, 2, F.size(found))).otherwise(found)
        named = F.filter(kept, lambda x: x.rlike(EXCEPTION_LINE))
        traced = F.concat(F.lit("Traceback: "), F.coalesce(F.get(named, F.size(named) - 1), F.get(kept, F.size(kept) - 1)))
        head = F.get(kept, F.lit(0))
        line = F.when(head.startswith(TRACEBACK), traced).otherwise(head)
        return F.coalesce(F.concat(F.when(exited, "exit: ").otherwise(""), line), F.lit(""))

    return _bound(lines, choose)


def index_body(kind: Column, subtype: Column, text: Column) -> Column:
    """The part of a text that is searched; null where nothing is."""
    found = F.when(kind == "tool_result", F.when(F.length(text) > 3000, F.concat(F.substring(text, 1, 2500), F.lit("\n…\n"), F.right(text, F.lit(500)))).otherwise(text))
    for name, cap in INDEX_CAPS.items():
        meant = (kind == name) & subtype.isin(INDEXED_SUBTYPES[name]) if name in INDEXED_SUBTYPES else kind == name
        found = found.when(meant, text if cap is None else F.substring(text, 1, cap))
    return F.when(text != "", found)


def queue_key(kind: Column, text: Column) -> Column:
    """The text by which a queued input and its delivery are paired."""
    text = F.coalesce(text, F.lit(""))
    inner = lambda tag: F.regexp_extract(text, rf"<{tag}>([\s\S]*?)</{tag}>", 1)
    command = F.concat_ws(" ", _strip(inner("command-name")), F.nullif(_strip(inner("command-args")), F.lit("")))
    said = (
        F.when(kind == "bash_in", F.when(text.rlike(r"<bash-input>[\s\S]*?</bash-input>"), inner("bash-input")).otherwise(text))
        .when((kind.isin("slash", "command") | text.startswith("<command-name>")) & text.rlike(r"<command-name>[\s\S]*?</command-name>"), command)
        .otherwise(text)
    )
    flat = _strip(F.regexp_replace(F.regexp_replace(said, r"\[이미지[^\]]*\]|\[Image #[0-9]+\]", " "), r"\s+", " "))
    return F.substring(F.regexp_replace(flat, r"^!\s*", ""), 1, 300)


def summary_sections(text: Column) -> Column:
    """array<struct<n, title, body, fmt>> of a compacted summary. Only headings
    whose numbers count up from 1 open a section, so lists in a body don't."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def cut(parts: Column) -> Column:
        marked = F.exists(parts, lambda x: _strip(x).rlike(MARKDOWN_HEADING))

        def group(line: Column, i: int) -> Column:
            return F.when(marked, F.regexp_extract(_strip(line), MARKDOWN_HEADING, i)).otherwise(F.regexp_extract(line, COLON_HEADING, i))

        numbers = F.transform(parts, lambda x: group(x, 1).try_cast("int"))
        at = F.sequence(F.lit(0), F.size(parts) - 1)
        heads = _bound(numbers, lambda n: F.aggregate(at, F.expr("cast(array() as array<int>)"), lambda acc, i: F.when(F.get(n, i) == F.size(acc) + 1, F.concat(acc, F.array(i))).otherwise(acc)))

        def section(h: Column) -> Column:
            def one(i: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(h, j + 1), F.size(parts))
                body = F.array_join(F.slice(parts, i + 2, stop - i - 1), "\n")
                title = F.regexp_replace(_strip(group(F.get(parts, i), 2)), ":+$", "")
                return F.struct((j + 1).alias("n"), title.alias("title"), _strip(body).alias("body"), F.when(marked, "md").otherwise("colon").alias("fmt"))

            return F.transform(h, one)

        return _bound(heads, section)

    return _bound(lines, cut)


def tool_summary(name: Column, given: Column) -> Column:
    """struct<fields map<string,string>, todos array<struct<content, status>>> of
    a tool's input as JSON text; other values than texts stand as JSON.

    Input without a known field, or that is no object, is kept under ``_raw``.
    """

    def taken(whole: Column) -> Column:
        at = lambda key: F.try_variant_get(whole, f"$.{key}", "string")
        is_text = lambda key: F.schema_of_variant(F.try_variant_get(whole, f"$.{key}", "variant")) == "STRING"
        script = F.when((name == "Workflow") & is_text("script"), at("script"))
        kept = [(k, F.when(is_text(k), F.substring(at(k), 1, 2000)).otherwise(at(k))) for k in SCALAR_FIELDS]
        kept += [(k, F.when(is_text(k), F.substring(at(k), 1, cap))) for k, cap in TEXT_FIELDS.items()]
        kept += [
            ("workflow_name", F.nullif(F.regexp_extract(script, r"name\s*:\s*['\"]([^'\"]{1,80})['\"]", 1), F.lit(""))),
            ("script_head", F.substring(script, 1, 500)),
            ("scriptPath", F.when(name == "Workflow", F.nullif(at("scriptPath"), F.lit("")))),
            ("edits", F.when(name == "MultiEdit", F.size(F.try_variant_get(whole, "$.edits", "array<variant>")).cast("string"))),
        ]
        pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kept]), lambda x: x["value"].isNotNull())
        todos = F.when(name == "TodoWrite", F.try_variant_get(whole, "$.todos", "array<struct<content:string,status:string>>"))
        todos = F.transform(todos, lambda x: F.struct(F.substring(x["content"], 1, 300).alias("content"), x["status"].alias("status")))
        raw = F.create_map(F.lit("_raw"), F.substring(F.coalesce(given, F.lit("null")), 1, 1000))

        def made(p: Column) -> Column:
            return F.when((F.size(p) == 0) & todos.isNull(), raw).otherwise(F.map_from_entries(p))

        return F.struct(_bound(pairs, made).alias("fields"), todos.alias("todos"))

    return _bound(F.try_parse_json(given), taken)


def tool_text(name: Column, summary: Column) -> Column:
    """The searched text of a tool call: name, fields in order, then its todos."""
    shown = F.filter(F.array(*[F.element_at(summary["fields"], F.lit(k)) for k in SHOWN_FIELDS]), lambda x: x.isNotNull() & (x != ""))
    todos = F.transform(summary["todos"], lambda x: F.concat(F.lit("- ["), F.coalesce(x["status"], F.lit("None")), F.lit("] "), F.coalesce(x["content"], F.lit("None"))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("["), name, F.lit("]"))), shown, F.coalesce(todos, F.expr("cast(array() as array<string>)"))), "\n")
