"""What kind of line a transcript line of the first dialect is, and its text.

Works on the line as a variant, after redaction. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rollout import INTERRUPTED, typed

# Sources and origins of prompts, and marks at the head of a text.
TYPED_SOURCES = ["typed", "queued", "suggestion_accepted"]
PEER_ORIGINS = ["peer", "coordinator"]
NOTE_HEAD, PEER_HEADS = "<task-notification>", ["Another Claude session sent a message", "<teammate-message"]
OUTPUT_HEADS = ["<local-command-", "<bash-stdout>", "<bash-stderr>"]
BARE_COMMAND = r"^(/[A-Za-z][\w:-]*)(?=\s|$)"


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _true(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False))


def _heads(text: Column, heads: list[str]) -> Column:
    found = F.lit(False)
    for head in heads:
        found = found | text.startswith(head)
    return found


def said(v: Column, path: str = "$.message.content") -> Column:
    """The text of a content that is a text or a list of blocks; never null."""
    blocks = typed(v, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: typed(b, "$.type") == "text"), lambda b: typed(b, "$.text"))
    return F.coalesce(typed(v, path), F.array_join(F.filter(texts, lambda x: x != ""), "\n"), F.lit(""))


def block_types(v: Column) -> Column:
    """Types of a message's blocks, each once, in order."""
    listed = F.transform(typed(v, "$.message.content", "array<variant>"), lambda b: typed(b, "$.type"))
    return F.coalesce(F.filter(F.array_distinct(listed), lambda x: x != ""), F.when(typed(v, "$.message.content").isNotNull(), F.array(F.lit("text"))), F.expr("cast(array() as array<string>)"))


def classify_line(v: Column) -> Column:
    """struct<kind, sub>; the order of the tests is part of the meaning."""
    kind = lambda k, sub=None: F.struct(F.lit(k).alias("kind"), (F.lit(None).cast("string") if sub is None else sub).alias("sub"))
    source, origin, side = typed(v, "$.promptSource"), typed(v, "$.origin.kind"), _true(v, "$.isSidechain")
    result = F.try_variant_get(v, "$.toolUseResult", "variant")
    whose = F.coalesce(F.nullif(source, F.lit("")), origin)

    def by_text(text: Column) -> Column:
        name = F.trim(F.regexp_extract(text, r"<command-name>([\s\S]*?)</command-name>", 1))
        wrapped = F.when(text.rlike(r"<command-args>\s*(?!\s|</command-args>)[\s\S]*?</command-args>"), kind("slash", name)).otherwise(kind("command"))
        bare = F.regexp_replace(text, r"^\s+|\s+$", "")
        command = F.regexp_extract(bare, BARE_COMMAND, 1)
        return (
            F.when(side, kind("side_user", source)).when(text.startswith(INTERRUPTED), kind("interrupt"))
            .when((origin == "human") | source.isin(TYPED_SOURCES), kind("human", whose)).when(source == "sdk", kind("sdk", source))
            .when((origin == "task-notification") | text.startswith(NOTE_HEAD), kind("task_note", origin))
            .when(origin.isin(PEER_ORIGINS) | _heads(text, PEER_HEADS), kind("peer", origin)).when(text.startswith("<bash-input>"), kind("bash_in"))
            .when(text.startswith("<command-name>"), wrapped).when(_heads(text, OUTPUT_HEADS), kind("command_out"))
            .when((F.coalesce(origin, F.lit("")) == "") & (command != ""), F.when(command != bare, kind("slash", command)).otherwise(kind("command")))
            .otherwise(kind("user_other", whose))
        )

    user = (
        F.when(_true(v, "$.isCompactSummary"), kind("compact"))
        .when((result.isNotNull() & (F.schema_of_variant(result) != "VOID")) | F.array_contains(block_types(v), "tool_result"), kind("tool_result"))
        .when(_true(v, "$.isMeta"), kind("meta")).otherwise(_bound(said(v), by_text))
    )
    t, attached, asked = typed(v, "$.type"), typed(v, "$.attachment.type"), typed(v, "$.content")
    queued = (attached == "queued_command") & (typed(v, "$.attachment.commandMode") == "prompt") & (typed(v, "$.attachment.origin.kind") == "human") & ~side
    operation = typed(v, "$.operation")
    return (
        F.when(t == "user", user)
        .when(t == "assistant", F.when(_true(v, "$.isApiErrorMessage"), kind("assistant", F.lit("api_error"))).otherwise(kind("assistant", F.nullif(F.array_join(block_types(v), "+"), F.lit("")))))
        .when(t == "system", kind("system", typed(v, "$.subtype"))).when(t == "attachment", F.when(queued, kind("queued", attached)).otherwise(kind("att", attached)))
        .when(t == "queue-operation", F.when((operation == "enqueue") & asked.rlike(r"^\s*[^\s<]"), kind("qo_human", operation)).otherwise(kind("qo", operation)))
        .otherwise(F.struct(t.alias("kind"), F.lit(None).cast("string").alias("sub")))
    )
