"""How keys, durations, numbers, texts and pages are shown. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders of images, short inputs, section titles of summaries.
IMAGE_CUT, IMAGE_SHOWN = r"\[이미지 생략 base64 [0-9]+바이트 [^\]]*\]", "[이미지]"
IMAGE_ANY = r"\[이미지[^\]]*\]|\[Image #[0-9]+\]"
SHORT_INPUT = 4
SUMMARY_PARTS = [("Current Work", "(?i)current work|현재 작업"), ("Next Step", "(?i)next step|다음 (?:단계|할 일)")]


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def short_project(name: Column, home: str) -> Column:
    """A project without the home folder's prefix; ``~`` for that folder."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "-").when(name == home, "~")
        .when(name.startswith(f"{home}-"), F.substr(name, F.lit(len(home) + 2))).otherwise(name)
    )


def bundle_of(human_kind: Column, delivered: Column) -> Column:
    return F.when(F.coalesce(delivered.cast("int"), F.lit(0)) == 0, "ghost").when(human_kind == "sdk", "auto").when(human_kind == "no_human", "no_human").otherwise("human")


def duration(seconds: Column) -> Column:
    """Rounded half to even, then whole minutes and hours."""
    s = F.rint(seconds).cast("long")
    hours = F.format_string("%d시간 %d분", (s / 3600).cast("long"), (s / 60).cast("long") % 60)
    return F.when(seconds.isNull(), "-").when(s < 60, F.format_string("%d초", s)).when(s < 3600, F.format_string("%d분", (s / 60).cast("long"))).otherwise(hours)


def number(x: Column, digits: int = 1) -> Column:
    """Thousands are set apart; fractions only below a thousand."""
    whole = F.format_number(x, 0)
    return F.when(x.isNull(), "-").when(F.abs(x) >= 1000, whole).otherwise(F.format_number(x, digits) if digits else whole)


def one_line(text: Column, cap: int = 80) -> Column:
    flat = _flat(F.regexp_replace(F.coalesce(text, F.lit("")), IMAGE_CUT, IMAGE_SHOWN))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)


def short_key(key: Column) -> Column:
    """``sid8/tail8`` of a card's key; other keys as they are."""
    parts = F.split(key, ":")
    return F.when((F.size(parts) >= 3) & (parts[0] == "c"), F.concat(F.substring(parts[1], 1, 8), F.lit("/"), F.substring(F.element_at(parts, -1), 1, 8))).otherwise(key)


def event_ref(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("")) == "", "-").when(key.startswith("c:"), F.substr(key, F.lit(3))).otherwise(key)


def command_head(command: Column, words: int = 3) -> Column:
    return F.array_join(F.slice(F.split(_flat(command), " "), 1, words), " ")


def quoted_lines(text: Column, chars: int = 600, lines: int = 15) -> Column:
    """array<string>: the first lines behind ``> ``, and what is missing of it."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    filled = lambda t: F.filter(F.split(t, r"\R"), lambda x: x.rlike(r"(?U)\S"))
    own = filled(F.substring(whole, 1, chars))
    shown = F.slice(own, 1, lines)
    cut = (F.length(whole) > chars) | (F.size(own) > lines)
    note = F.format_string("> …(잘림: 전체 %d자 %d줄 중 앞 %d줄)", F.length(whole), F.size(filled(whole)), F.size(shown))
    return F.concat(F.transform(shown, lambda x: F.concat(F.lit("> "), x)), F.when(cut, F.array(note)).otherwise(F.expr("cast(array() as array<string>)")))


def quoted(text: Column, cap: int = 1500) -> Column:
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    kept = F.when(F.length(whole) > cap, F.concat(F.substring(whole, 1, cap), F.lit("…(잘림)"))).otherwise(whole)
    return F.when(whole == "", "> (없음)").otherwise(F.array_join(F.transform(F.split(kept, r"\R"), lambda x: F.concat(F.lit("> "), x)), "\n"))


def summary_lines(sections: Column, cap: int = 300) -> Column:
    """array<string>: the first section on the work at hand and the first on what
    comes next, of array<struct<title, body>>."""
    def first(label: str, pattern: str) -> Column:
        found = F.filter(sections, lambda s: F.coalesce(s["title"], F.lit("")).rlike(pattern))
        return F.when(F.size(found) > 0, F.concat(F.lit(f"- {label}: "), one_line(F.get(found, F.lit(0))["body"], cap)))

    return F.filter(F.array(*(first(*x) for x in SUMMARY_PARTS)), lambda x: x.isNotNull())


def seconds_between(ts: Column, now: Column) -> Column:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (us(now) - us(ts)) / 1e6


def shifted_iso(ts: Column, seconds: int) -> Column:
    return F.date_format(ts + F.make_dt_interval(secs=F.lit(seconds)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def card_text(human: Column) -> Column:
    """What a card's input shows: a shell line behind ``!``, a command with its arguments."""
    inner = lambda tag: F.trim(F.regexp_extract(human, rf"<{tag}>([\s\S]*?)</{tag}>", 1))
    command = F.concat_ws(" ", inner("command-name"), F.nullif(inner("command-args"), F.lit("")))
    return F.when(human.startswith("<bash-input>"), F.concat(F.lit("! "), inner("bash-input"))).when(human.startswith("<command-name>"), command).otherwise(F.coalesce(human, F.lit("")))


def is_short_input(human: Column) -> Column:
    """Nothing but images, or at most four characters that are no blanks."""
    return F.length(F.regexp_replace(F.regexp_replace(card_text(human), IMAGE_ANY, " "), r"(?U)\s+", "")) <= SHORT_INPUT


def is_goal_input(kind: Column, sub: Column, text: Column) -> Column:
    return (kind == "att") & (sub == "queued_command") & F.coalesce(text, F.lit("")).rlike(r"(?U)^Goal set: [\s\S]*\S")


def card_file(key: Column) -> Column:
    parts = F.split(key, ":")
    return F.concat(F.lit("c-"), F.substring(F.coalesce(F.get(parts, F.lit(1)), F.lit("x")), 1, 8), F.lit("-"), F.substring(F.element_at(parts, -1), 1, 8))


def project_page(name: Column, home: str) -> Column:
    return F.concat(F.lit("p-"), F.replace(short_project(name, home), F.lit("/"), F.lit("-")))


def front_matter(**fields: Column) -> Column:
    """YAML lines of the fields: numbers bare, texts and lists as JSON, null as null."""
    rows = [F.concat(F.lit(f"{k}: "), F.coalesce(F.to_json(F.struct(v.alias("x"))), F.lit(""))) for k, v in fields.items()]
    bare = [F.regexp_replace(F.regexp_replace(r, r'^([^:]+: )\{"x":([\s\S]*)\}$', "$1$2"), r"^([^:]+: )\{\}$", "$1null") for r in rows]
    return F.concat_ws("\n", F.lit("---"), *bare, F.lit("---"))


def card_search_body(human: Column, answer: Column, files: Column, commands: Column, errors: Column) -> Column:
    """The searched text of a card: its input, last answer, files, commands and
    first error lines, each within its cap."""
    listed = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), "\n"))
    text = lambda c, n: F.nullif(F.substring(c, 1, n), F.lit(""))
    return F.concat_ws("\n", text(human, 2000), text(answer, 800), listed(files, 50), listed(commands, 20), listed(errors, 1 << 30))


#: How much of a document of each kind is indexed (None: all).
DOCUMENT_CAPS = {"memory": None, "wf_run": 8000, "wf_script": 6000, "tool_output": 6000, "agent_meta": 1000}


def document_body(kind: Column, text: Column) -> Column:
    body = F.when(kind == "memory", text)
    for name, cap in DOCUMENT_CAPS.items():
        if cap:
            body = body.when(kind == name, F.substring(text, 1, cap))
    return body
