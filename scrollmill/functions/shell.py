"""Whether a failed shell call just found nothing.

A command's words are cut by patterns, and what they mean is decided on arrays
of words: all of it stays in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands whose exit code 1 says "none", "false" or "differs",
# commands that only pass on what others found, and marks of a real failure.
SEEKING = "grep egrep fgrep zgrep rg ag ack find diff cmp test [ [[ pgrep which comm lsof".split()
PASSING = "head tail wc sort uniq cut tr awk sed cat column nl jq less more cd echo printf true : ls stat file du df pwd basename dirname realpath readlink ps".split()
HARD_ERROR = r"(?i)No such file or directory|Permission denied|command not found|Traceback \(most recent call|fatal:|syntax error|Operation not permitted|Is a directory|Not a directory|cannot access"
ENDS, PIPES, WRITES, OTHER_REDIRECTS = [";", "&", ";;"], ["|", "&&", "||", "|&"], [">", ">>", ">|", "&>"], [">&", "<"]


# Parts of the grammar of words. No part gives back what it took, so a quote that
# does not close costs one pass and is left alone as a piece of one character.
_LETTERS = r"[A-Za-z0-9_~./*?=\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF-]++"
_ESCAPED = r"\\[\s\S]"
_SINGLE = r"'[^']*+'"
_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_PIECE = f"{_SINGLE}|{_DOUBLE}|{_ESCAPED}|{_LETTERS}"
_RAW = f"(?:{_PIECE})++|[();<>|&]++|[^ \\t\\r\\n]"
UNCLOSED, COMMENT = ["'", '"', "\\"], "#"


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unquoted(raw: Column) -> Column:
    """What a word says without its quotes and escapes."""
    inner = lambda p: F.substr(p, F.lit(2), F.length(p) - 2)
    piece = lambda p: (
        F.when(p.startswith("'"), inner(p)).when(p.startswith('"'), F.regexp_replace(inner(p), r'\\(["\\])', "$1"))
        .when(p.startswith("\\"), F.substr(p, F.lit(2))).otherwise(p)
    )
    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(f"({_PIECE})"), F.lit(1)), piece), "")


def shell_words(command: Column) -> Column:
    """array<string>: words and operators of a command, line ends as ``;``.

    A character that is no letter, quote or operator is a word of its own; a ``#``
    between words ends the command. Null where quotes don't close, and for null.
    """
    cut = F.regexp_extract_all(F.replace(command, F.lit("\n"), F.lit(" ; ")), F.lit(f"({_RAW})"), F.lit(1))
    said = _bound(cut, lambda w: F.when(F.array_position(w, COMMENT) > 0, F.slice(w, F.lit(1), (F.array_position(w, COMMENT) - 1).cast("int"))).otherwise(w))
    word = lambda w: F.when(w.rlike(r"^[();<>|&]"), w).when(w.rlike(f"^(?:{_PIECE})"), _unquoted(w)).otherwise(w)
    return _bound(said, lambda ws: F.when(~F.exists(ws, lambda w: w.isin(UNCLOSED)), F.transform(ws, word)))


def _last_statement(words: Column) -> Column:
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    last = F.array_max(F.transform(F.filter(at, lambda x: ~x["w"].isin(ENDS)), lambda x: x["i"]))

    def cut(stop: Column) -> Column:
        before = F.array_max(F.transform(F.filter(at, lambda x: x["w"].isin(ENDS) & (x["i"] < stop)), lambda x: x["i"]))
        start = F.coalesce(before + 1, F.lit(0))
        return F.when(stop.isNotNull(), F.slice(words, start + 1, stop - start + 1))

    return _bound(last, cut)


def _only_sought(words: Column) -> Column:
    """Of one statement: some command seeks, the others only pass on."""
    writes = F.exists(F.transform(words, lambda w, i: w.isin(WRITES) & (F.coalesce(F.get(words, i + 1), F.lit("")) != "/dev/null")), lambda x: x)
    redirect = lambda w: F.coalesce(w.isin(WRITES + OTHER_REDIRECTS), F.lit(False))
    # A word carries a leading w, so that empty ones survive joining and cutting.
    marked = F.transform(words, lambda w, i: F.when(redirect(w) | (redirect(F.get(words, i - 1)) & (i > 0)), "").when(w.isin(PIPES), "\x02").otherwise(F.concat(F.lit("w"), w)))
    plain = lambda c: F.filter(F.split(c, "\x01"), lambda w: w.startswith("w") & ~w.rlike(r"^w(?:[A-Za-z_][A-Za-z0-9_]*=|[0-9]+$)"))
    commands = F.filter(F.transform(F.split(F.array_join(marked, "\x01"), "\x02"), plain), lambda c: F.size(c) > 0)
    program = lambda c: F.substring_index(F.substr(F.get(c, F.lit(0)), F.lit(2)), "/", -1)
    seeks = lambda c: program(c).isin(SEEKING) | ((program(c) == "git") & F.coalesce(F.get(c, F.lit(1)).isin("wgrep", "wdiff"), F.lit(False)))
    passes = lambda c: program(c).isin(PASSING) & ~((program(c) == "sed") & F.exists(c, lambda w: w.startswith("w-i")))
    return ~writes & _bound(commands, lambda cs: F.exists(cs, seeks) & F.forall(cs, lambda c: seeks(c) | passes(c)))


def nothing_found(text: Column, command: Column) -> Column:
    """True if the output says exit code 1 without a failure and the command's
    last statement only seeks. Null texts and commands: false."""
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    quiet = said.rlike(r"^Exit code 1[^\S\n]*(?:\n|$)") & ~said.rlike(HARD_ERROR)
    simple = (F.length(command) > 0) & (F.length(command) < 2000) & ~command.contains("<<") & ~command.rlike(r"\bset\s+-[a-z]*e")
    # Only commands whose output says that nothing was found are cut into words.
    sought = _bound(shell_words(F.when(quiet & simple, command)), lambda w: _bound(_last_statement(w), _only_sought))
    return F.coalesce(quiet & simple & sought, F.lit(False))
