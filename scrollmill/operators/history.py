"""The prompt history against the inputs that a session's lines hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What stands for pasted texts, images and masked values in a prompt.
PLACEHOLDER = r"\[(?:Pasted text #[0-9]+(?: \+[0-9]+ lines)?|Image #[0-9]+)\]|\[REDACTED:[a-z_]+\]"
WRAPPER = r"</?pasted_content(?: id=\"[^\"]*\")?>"
PROBE, LEAST = 30, 4


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def input_text(text: Column) -> Column:
    """An input without placeholders and wrappers, blanks as one."""
    return flat(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WRAPPER, " "), PLACEHOLDER, " "))


def segments(shown: Column) -> Column:
    """array<string>: the pieces of a prompt between placeholders, four characters
    or more each; a shell mark or a command's name is no part of it."""
    body = F.when(shown.startswith("!"), F.ltrim(F.substr(shown, F.lit(2)))).when(shown.rlike("^/[^ ]* "), F.regexp_replace(shown, "^[^ ]* ", "")).otherwise(F.coalesce(shown, F.lit("")))
    return F.filter(F.transform(F.split(body, PLACEHOLDER), flat), lambda x: F.length(x) >= LEAST)


def crosscheck(history: DataFrame, inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, sid, reason) for each prompt of ``history`` (id, sid, text).

    matched: an input (sid, text) of its session contains the prompt's head;
    missed: only another input-like line (sid, text) does, so an input was not
    counted; btw, history_only: the session's lines hold no trace. Sessions are
    the join key; contained texts are compared within one.
    """
    first = F.get(segments(F.col("text")), F.lit(0))
    asked = history.select("id", "sid", "text", F.trim(F.substring(first, 1, PROBE)).alias("probe"))
    short = F.coalesce(F.length("probe"), F.lit(0)) < LEAST

    def marked(rows: DataFrame, df: DataFrame, probe: str, name: str) -> DataFrame:
        texts = df.select(F.col("sid").alias("__sid"), input_text(F.col("text")).alias("__t")).where("__t <> ''").distinct()
        hit = rows.where(~short).join(texts, (F.col("sid") == F.col("__sid")) & F.col("__t").contains(F.col(probe)), "left_semi").select("id", "sid").distinct().withColumn(name, F.lit(True))
        return rows.join(hit, ["id", "sid"], "left")

    rows = marked(marked(asked, inputs, "probe", "hit"), lines, "probe", "traced")
    reason = F.when(short, "placeholder_only").when(F.col("hit"), "matched").when(F.col("traced"), "missed").when(F.col("text").rlike(r"^\s*/btw(\s|$)"), "btw").otherwise("history_only")
    return rows.select("id", "sid", reason.alias("reason"))


#: Where a bare command's line may be found, in the order in which prompts take them.
BUCKETS = ["slash_counted", "slash_uncounted", "slash_local_command"]
#: The kinds of user lines that count as input.
COUNTED = ["command", "slash", "human"]


def command_name(text: Column) -> Column:
    """The command that a line names, with its slash; null if it names none."""
    marked = F.regexp_extract(F.trim(text), r"^<command-name>\s*([^<\s]+)\s*</command-name>", 1)
    plain = F.regexp_extract(F.trim(text), r"^(/\S+)", 1)
    return F.when(marked != "", F.when(marked.startswith("/"), marked).otherwise(F.concat(F.lit("/"), marked))).when(plain != "", plain)


def slash_lines(lines: DataFrame) -> DataFrame:
    """(sid, bucket, name, n): the command lines of sessions (sid, type, kind, sub,
    side, text), side branches left out."""
    user = (F.col("type") == "user") & ~F.coalesce(F.col("side").cast("boolean"), F.lit(False))
    bucket = F.when(user, F.when(F.col("kind").isin(COUNTED), BUCKETS[0]).otherwise(BUCKETS[1])).when((F.col("type") == "system") & (F.col("sub") == "local_command"), BUCKETS[2])
    named = lines.select("sid", bucket.alias("bucket"), command_name(F.col("text")).alias("name")).where("bucket is not null and name is not null")
    return named.groupBy("sid", "bucket", "name").agg(F.count("*").alias("n"))


def pair_commands(history: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bare commands of the prompt history (id, sid, text) against a session's
    command lines: (id, sid, name, bucket) for each, and the lines that no prompt
    took (sid, bucket, name, n).

    The n-th prompt of a name takes the n-th line of that name, counted lines
    first; a prompt beyond the last line is ``slash_no_line``. Both sides are
    numbers of a name in a session: equal commands never meet pair by pair.
    """
    bare = history.select("id", "sid", flat(F.col("text")).alias("name")).where("name like '/%' and name not like '% %'")
    have = slash_lines(lines).groupBy("sid", "name").pivot("bucket", BUCKETS).agg(F.sum("n"))
    have = have.select("sid", "name", *(F.coalesce(b, F.lit(0)).alias(b) for b in BUCKETS))
    nth = bare.withColumn("nth", F.row_number().over(W.partitionBy("sid", "name").orderBy("id")))
    met, upto, found = nth.join(have, ["sid", "name"], "left"), F.lit(0), None
    for b in BUCKETS:
        upto = upto + F.coalesce(b, F.lit(0))
        found = F.when(F.col("nth") <= upto, b) if found is None else found.when(F.col("nth") <= upto, b)
    paired = met.select("id", "sid", "name", found.otherwise("slash_no_line").alias("bucket"))
    taken = paired.groupBy("sid", "name", "bucket").agg(F.count("*").alias("t"))
    left = slash_lines(lines).join(taken, ["sid", "name", "bucket"], "left").select("sid", "bucket", "name", (F.col("n") - F.coalesce("t", F.lit(0))).alias("n")).where("n > 0")
    return paired, left


def command_counts(lines: DataFrame, since: Column, until: Column) -> DataFrame:
    """(project, noarg, local): command lines without arguments, and local ones, of
    a stretch of time [since, until) by project; zeros are not listed."""
    noarg, local = F.col("kind") == "command", (F.col("kind") == "system") & (F.col("sub") == "local_command") & F.col("text").startswith("<command-name>")
    own = lines.where((F.col("ts") >= since) & (F.col("ts") < until) & (noarg | local))
    return own.groupBy("project").agg(F.count_if(noarg).alias("noarg"), F.count_if(local).alias("local"))
