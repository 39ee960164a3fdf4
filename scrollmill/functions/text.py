"""Column builders for names, error lines, caps and display times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites of an error line, in order.
ERROR_REWRITES = [
    (r"\[REDACTED:[a-z_]+\]", "<r>"), (r"(?:[A-Za-z]:)?(?:~|\.{1,2})?(?:/[^\s:'\"()\[\],;]+)+/?", "<path>"), (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-f]{7,}\b", "<hex>"),
    (r"[0-9]+", "<n>"), (r'"[^"]*"', '"<q>"'), (r"'[^']*'", "'<q>'"), (r"`[^`]*`", "`<q>`"), (r"\s+", " "),
]


def file_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def project_from_cwd(cwd: Column) -> Column:
    return F.regexp_replace(cwd, r"[/\\.:\s]", "-")


def source_of(path: Column) -> Column:
    return F.when(path.startswith("codex/"), "codex").otherwise("claude")


def kind_of(path: Column) -> Column:
    """What a transcript path holds; null if it is not recognised."""
    return (
        F.when(path.rlike(r"/subagents/workflows/[^/]+/agent-[^/]*\.jsonl$"), "wf_agent").when(path.rlike(r"/journal[^/]*\.jsonl$"), "journal")
        .when(path.rlike(r"/subagents/.*agent-[^/]*\.meta\.json$"), "agent_meta").when(path.rlike(r"/subagents/(.*/)?agent-[^/]*\.jsonl$"), "subagent")
        .when(path.rlike(r"/memory/.*\.md$"), "memory").when(path.rlike(r"/workflows/scripts/[^/]+\.js$"), "wf_script").when(path.rlike(r"/workflows/wf_[^/]+\.json$"), "wf_run")
        .when(path.rlike(r"/tool-results/"), "tool_output").when(path.rlike(r"(^|/)history\.jsonl$"), "history").when(path.rlike(r"^projects/[^/]+/[^/]+\.jsonl$"), "session")
    )


def first_line(text: Column, cap: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*([^\s][^\n]*)", 1)), 1, cap)


def error_line(line: Column) -> Column:
    for pattern, mark in ERROR_REWRITES:
        line = F.regexp_replace(line, pattern, mark)
    return F.substring(F.trim(line), 1, 200)


def error_signature(line: Column) -> Column:
    """First 12 hex digits of the normalised line's sha1; null for an empty one."""
    # Bound by a lambda, the line is rewritten once a row.
    return F.get(F.transform(F.array(error_line(line)), lambda n: F.when(n != "", F.substring(F.sha1(n.cast("binary")), 1, 12))), F.lit(0))


def capped(text: Column, head: int = 2500, tail: int = 500) -> Column:
    """Long texts keep their head and tail."""
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit("\n…\n"), F.right(text, F.lit(tail)))).otherwise(text)


def project_family(name: Column) -> Column:
    return F.regexp_replace(name, r"[-_]?[0-9]{3,}$", "-*")


def shape(value: Column) -> Column:
    """Capitals as A, small letters as a, digits as 9."""
    return F.mask(value, F.lit("A"), F.lit("a"), F.lit("9"), F.lit(None).cast("string"))


def display_time(ts: Column, hours: int = 9) -> Column:
    """A UTC timestamp without zone on the display clock."""
    return ts + F.make_interval(hours=F.lit(hours))


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
