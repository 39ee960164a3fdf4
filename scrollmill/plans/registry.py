"""Queries over the driver's tables, each beside its DuckDB oracle.

``conversations`` stands for ordered transcripts, ``events`` for the timestamped
log, ``documents`` for the search corpus, ``lineitem`` and ``orders`` for usage
rows repeated per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import display, extraction, lines, policy, redaction, rollout, shell, text
from ..operators import known, ordered, quantiles, search

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register f(t) under its name; t reads a table of the data folder."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        QUERIES[f.__name__].__name__ = f.__name__
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(c: Column) -> Column:
    return c.cast("long")


# Sources -----------------------------------------------------------------

_PATH = "case when doc_id % 5 = 0 then 'projects/p' || source || '/s' || doc_id || '.jsonl' when doc_id % 5 = 1 then 'projects/p' || source || '/s/subagents/agent-' || doc_id || '.jsonl' when doc_id % 5 = 2 then 'projects/p/memory/' || doc_id || '.md' when doc_id % 5 = 3 then 'codex/history.jsonl' else 'projects/x/readme.txt' end"


@query(f"with p as (select {_PATH} as path from documents) select case when path like '%/subagents/%' then 'subagent' when path like '%/memory/%' then 'memory' when path like '%history.jsonl' then 'history' when path like 'projects/%.jsonl' then 'session' end as kind, case when path like 'codex/%' then 'codex' else 'claude' end as src, count(*) as n from p group by all")
def src_discover_kinds(t) -> DataFrame:
    p = t("documents").select(F.expr(_PATH).alias("path"))
    return p.groupBy(text.kind_of(F.col("path")).alias("kind"), text.source_of(F.col("path")).alias("src")).agg(F.count("*").alias("n"))


@query("select doc_id, substr(sha1('projects/' || source || '/' || doc_id), 1, 12) as fid from documents")
def src_file_id(t) -> DataFrame:
    return t("documents").select("doc_id", text.file_id(F.concat(F.lit("projects/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).alias("fid"))


@query(r"select page_id, regexp_replace(url, '[/\\.:\s]', '-', 'g') as project from pages")
def src_project_from_cwd(t) -> DataFrame:
    return t("pages").select("page_id", text.project_from_cwd(F.col("url")).alias("project"))


@query("select doc_id, sha1(text) as sha from documents where doc_id % 7 = 0")
def src_doc_change_detect(t) -> DataFrame:
    """Documents whose digest is not in the previous snapshot (which lacks every seventh)."""
    now = t("documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha"))
    return now.join(now.where("doc_id % 7 <> 0"), ["doc_id", "sha"], "left_anti")


@query("select doc_id, 1 as missing from documents where doc_id % 5 = 0")
def src_mark_missing(t) -> DataFrame:
    known = t("documents").select("doc_id")
    return known.join(known.where("doc_id % 5 <> 0"), "doc_id", "left_anti").withColumn("missing", F.lit(1))


@query("select event_id, last_value(case when event_type = 'signup' then props end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as state from events")
def src_codex_state_fill(t) -> DataFrame:
    return ordered.carry(t("events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("props")), "state").select("event_id", "state")


_TWO_FILES = "select event_id, user_id, 0 as src from events union all select event_id, user_id, 1 from events where event_id % 3 = 0"


@query(f"with e as ({_TWO_FILES}), r as (select *, row_number() over (partition by event_id order by src) as n from e) select case when n = 1 then 'stored' else 'dup_key_other_file' end as reason, count(*) as n from r group by 1")
def src_key_dedup(t) -> DataFrame:
    e = t("events").select("event_id", F.lit(0).alias("src"))
    both = e.unionByName(e.where("event_id % 3 = 0").withColumn("src", F.lit(1)))
    first = ordered.first_by(both, ["event_id"], ["src"]).agg(F.count("*").alias("n")).select(F.lit("stored").alias("reason"), "n")
    # What is not first is the rest: no second pass over the keys.
    rest = both.groupBy("event_id").agg((F.count("*") - 1).alias("k")).agg(F.sum("k").alias("n")).select(F.lit("dup_key_other_file").alias("reason"), "n")
    return first.unionByName(rest).where("n > 0")


@query("with r as (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as nth from conversations) select conv_id, turn, role from r where nth > 1")
def src_multiset_dedup(t) -> DataFrame:
    """A re-read file: one occurrence of each (conversation, role) is stored already."""
    c = t("conversations").select("conv_id", "turn", "role")
    return ordered.multiset_new(c, c.select("conv_id", "role").distinct(), ["conv_id", "role"], ["turn"])


# Policies ----------------------------------------------------------------

_LINE = "case event_type when 'click' then 'user' when 'view' then 'file-history-snapshot' when 'error' then 'system' when 'signup' then 'attachment' else 'mystery' end"


@query("""select case when event_type = 'view' then 'file_backup' when event_type = 'error' then 'hook_summary' when event_type = 'signup' then case when event_id % 2 = 0 then 'noise:language' else 'unknown_attachment:novel' end when event_type = 'click' then null else 'unknown_type:mystery' end as reason,
    event_type not in ('view', 'error') and not (event_type = 'signup' and event_id % 2 = 0) as keep, count(*) as n from events group by all""")
def pol_line_policy(t) -> DataFrame:
    sub, att = F.when(F.col("event_type") == "error", "stop_hook_summary").otherwise(""), F.when(F.col("event_id") % 2 == 0, "language").otherwise("novel")
    judged = t("events").select(policy.line_policy(F.expr(_LINE), sub, att).alias("p"))
    return judged.groupBy("p.reason", "p.keep").agg(F.count("*").alias("n"))


@query("select event_type as reason, cast(sum(n) as bigint) as n, cast(sum(bytes) as bigint) as bytes from (select event_type, 1 as n, length(props) as bytes from events union all select event_type, 1, length(props) from events where event_id % 2 = 0) group by 1")
def pol_exclusion_counters(t) -> DataFrame:
    """Additive merge of this run's counters with the stored ones."""
    count = lambda e: e.groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"))
    e = t("events")
    return count(e).unionByName(count(e.where("event_id % 2 = 0"))).groupBy("reason").agg(big(F.sum("n")).alias("n"), big(F.sum("bytes")).alias("bytes"))


@query("select user_id, count(*) as n_lines, count(*) filter (event_type <> 'view') as stored, count(*) filter (event_type = 'view') as excluded, true as ok from events group by 1")
def pol_accounting(t) -> DataFrame:
    view = F.col("event_type") == "view"
    per = t("events").groupBy("user_id").agg(F.count("*").alias("n_lines"), F.count_if(~view).alias("stored"), F.count_if(view).alias("excluded"))
    return per.withColumn("ok", F.col("n_lines") == F.col("stored") + F.col("excluded"))


# Classification and extraction -------------------------------------------


@query("select conv_id, turn, case role when 'user' then 'human' else role end as kind from conversations")
def cls_classify_turns(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", policy.classify_turn(F.col("role"), F.col("text")).alias("kind"))


@query(r"select doc_id, substr(trim(regexp_extract(text, '(?m)^[ \t]*([^\s][^\n]*)', 1)), 1, 160) as line from documents")
def cls_first_line(t) -> DataFrame:
    return t("documents").select("doc_id", text.first_line(F.col("text")).alias("line"))


def _duck_error_line(c: str) -> str:
    for pattern, mark in text.ERROR_REWRITES:
        pattern, mark = pattern.replace("'", "''"), mark.replace("'", "''")
        c = f"regexp_replace({c}, '{pattern}', '{mark}', 'g')"
    return f"substr(trim({c}), 1, 200)"


@query(f"select doc_id, {_duck_error_line('text')} as line from documents")
def cls_error_normalize(t) -> DataFrame:
    return t("documents").select("doc_id", text.error_line(F.col("text")).alias("line"))


@query(f"select substr(sha1(line), 1, 12) as sig, count(*) as n from (select {_duck_error_line('text')} as line from documents) where line <> '' group by 1")
def cls_error_sig(t) -> DataFrame:
    # A test of the signature itself would be pushed down and work it out again.
    return t("documents").select(text.error_signature(F.col("text")).alias("sig")).groupBy("sig").agg(F.count("sig").alias("n")).where("n > 0")


@query("select doc_id, sha1(case when length(text) > 3000 then substr(text, 1, 2500) || chr(10) || '…' || chr(10) || right(text, 500) else text end) as body_sha from documents")
def cls_fts_body_caps(t) -> DataFrame:
    return t("documents").select("doc_id", F.sha1(text.capped(F.col("text")).cast("binary")).alias("body_sha"))


@query("select event_type, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def cls_tool_json(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(big(F.sum(F.get_json_object("props", "$.k").cast("long"))).alias("k"))


_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"with l as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce('Exit code 1' || chr(10) || text, ''), '{extraction.TAG}', '', 'g'), '{extraction.LINE_END}'), lambda x: {_STRIPPED.format('x')}), lambda x: x <> '') as l from documents) select doc_id, case when len(l) > 1 then 'exit: ' || l[2] else coalesce(l[1], '') end as line from l")
def cls_error_head(t) -> DataFrame:
    return t("documents").select("doc_id", extraction.error_head(F.concat(F.lit("Exit code 1\n"), "text")).alias("line"))


@query("select doc_id, sha1(nullif(case doc_id % 5 when 0 then case when length(text) > 3000 then substr(text, 1, 2500) || chr(10) || '…' || chr(10) || right(text, 500) else text end when 1 then substr(text, 1, 20000) when 3 then substr(text, 1, 3000) when 4 then text end, '')) as body_sha from documents")
def cls_index_body(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["tool_result", "assistant", "meta", "interrupt", "human"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return t("documents").select("doc_id", F.sha1(extraction.index_body(kind, F.lit(""), F.col("text")).cast("binary")).alias("body_sha"))


@query(r"with f as (select doc_id, trim(regexp_replace(regexp_replace(case when doc_id % 3 = 1 then '/go ' else '' end || coalesce(text, ''), '\[이미지[^\]]*\]|\[Image #[0-9]+\]', ' ', 'g'), '\s+', ' ', 'g')) as flat from documents) select doc_id, substr(regexp_replace(flat, '^!\s*', ''), 1, 300) as key from f")
def queue_key(t) -> DataFrame:
    """Typed behind a mark, as a command's arguments, or as a shell line."""
    body = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("doc_id") % 3 == 0, "bash_in").when(F.col("doc_id") % 3 == 1, "slash").otherwise("human")
    said = (
        F.when(kind == "bash_in", F.concat(F.lit("<bash-input>"), body, F.lit("</bash-input>")))
        .when(kind == "slash", F.concat(F.lit("<command-name>/go</command-name><command-args>"), body, F.lit("</command-args>")))
        .otherwise(body)
    )
    return t("documents").select("doc_id", extraction.queue_key(kind, said).alias("key"))


@query(rf"select doc_id, n, title, sha1({_STRIPPED.format('body')}) as body_sha from (select doc_id, 1 as n, coalesce(source, 'none') as title, coalesce(text, '') as body from documents union all select doc_id, 2, 'End', coalesce(lang, '') from documents)")
def cls_summary_sections(t) -> DataFrame:
    d, said = t("documents"), lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat(F.lit("## 1. "), F.coalesce("source", F.lit("none")), F.lit(":\n"), said("text"), F.lit("\n7. a list\n## 2. End\n"), said("lang"))
    s = d.select("doc_id", F.inline(extraction.summary_sections(whole)))
    return s.select("doc_id", "n", "title", F.sha1(F.regexp_replace("body", r"\s*7\. a list$", "").cast("binary")).alias("body_sha"))


@query("select doc_id, sha1(concat_ws(chr(10), '[Bash]', nullif(source, ''), nullif(substr(text, 1, 2000), ''))) as shown_sha from documents")
def cls_tool_text(t) -> DataFrame:
    d = t("documents")
    given = F.to_json(F.struct(F.col("text").alias("command"), F.col("source").alias("description"), F.lit(1).alias("other")))
    s = d.select("doc_id", extraction.tool_summary(F.lit("Bash"), given).alias("s"))
    return s.select("doc_id", F.sha1(extraction.tool_text(F.lit("Bash"), F.col("s")).cast("binary")).alias("shown_sha"))


_TYPED = "replace(coalesce(text, ''), chr(39), '')"


@query(rf"""with d as (select doc_id, 'grep -c ' || chr(39) || {_TYPED} || chr(39) || ' ' as cmd, 'Exit code 1' || chr(10) || coalesce(text, '') as said from documents)
    select doc_id, doc_id % 4 < 2 and length(cmd) + case doc_id % 4 when 0 then 15 else 24 end < 2000 and not contains(cmd, '<<') and not regexp_matches(cmd, '\bset\s+-[a-z]*e') and not regexp_matches(said, '{shell.HARD_ERROR}') as nothing_found from d""")
def cls_nothing_found(t) -> DataFrame:
    """The whole text as the pattern of a search and as its output: a search alone,
    one behind another command, one that writes, one that is built first."""
    seek = F.concat(F.lit("grep -c '"), F.expr(_TYPED), F.lit("' "))
    whole = F.array(F.concat(seek, F.lit("src | head -n 3")), F.concat(F.lit("make -k; "), seek, F.lit("lib/src | wc -l")), F.concat(seek, F.lit("src > out.txt")), F.concat(F.lit("make && "), seek, F.lit("src")))
    command = F.element_at(whole, (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", shell.nothing_found(F.concat(F.lit("Exit code 1\n"), F.coalesce("text", F.lit(""))), command).alias("nothing_found"))


# Lines of both dialects -----------------------------------------------------


@query(
    "select conv_id, turn, case turn % 4 when 0 then 'human' when 1 then 'assistant' when 2 then 'tool_result' end as kind, case when turn % 4 = 3 then 'codex:echo:user_message' end as reason,"
    " sha256(case turn % 4 when 2 then 'Exit code 1' || chr(10) || ltrim(coalesce(text, ''), chr(10)) when 3 then null else coalesce(text, '') end) as text_sha256 from conversations"
)
def src_rollout_lines(t) -> DataFrame:
    """Each turn as a prompt, an answer, a failed command's output or an echo."""
    said, way = F.coalesce("text", F.lit("")), F.col("turn") % 4
    part = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), said.alias("text")))
    message = lambda role, kind: F.struct(F.lit("message").alias("type"), F.lit(role).alias("role"), part(kind).alias("content"))
    output = F.struct(F.lit("function_call_output").alias("type"), F.lit("c").alias("call_id"), F.concat(F.lit("Exit code: 1\nOutput:\n"), said).alias("output"))
    line = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    raw = (
        F.when(way == 0, line("response_item", message("user", "input_text"))).when(way == 1, line("response_item", message("assistant", "output_text")))
        .when(way == 2, line("response_item", output)).otherwise(line("event_msg", F.struct(F.lit("user_message").alias("type"))))
    )
    read = rollout.normalised(t("conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("off"), raw.alias("raw")))
    return read.select(F.col("path").cast("long").alias("conv_id"), F.col("off").alias("turn"), "kind", "reason", F.sha2(F.when(F.col("reason").isNull(), F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256"))


@query(
    "select case turn % 6 when 0 then 'human' when 1 then 'assistant' when 2 then 'meta' when 3 then 'slash' when 4 then 'tool_result' else 'att' end as kind,"
    " case turn % 6 when 0 then 'typed' when 1 then 'text' when 3 then '/go' when 5 then role end as sub, count(*) as n from conversations group by 1, 2"
)
def cls_line_kinds(t) -> DataFrame:
    """Kinds of lines made of the turns, each turn with other fields."""
    way, said = F.col("turn") % 6, F.coalesce("text", F.lit(""))
    text = F.when(way == 3, F.concat(F.lit("<command-name>/go</command-name><command-args>x "), F.regexp_replace(said, "[<>]", ""), F.lit("</command-args>"))).otherwise(said)
    raw = F.to_json(F.struct(
        F.when(way == 5, "attachment").when(way == 1, "assistant").otherwise("user").alias("type"), F.when(way == 0, "typed").alias("promptSource"), F.when(way == 2, True).alias("isMeta"),
        F.when(way == 4, F.struct(said.alias("stdout"))).alias("toolUseResult"), F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")).alias("message"),
        F.struct(F.col("role").alias("type")).alias("attachment"),
    ))
    # A column of its own, so that the line is parsed once and not in every test.
    kinds = t("conversations").select(F.try_parse_json(raw).alias("v")).select(lines.classify_line(F.col("v")).alias("k"))
    return kinds.groupBy("k.kind", "k.sub").agg(F.count("*").alias("n"))


# Redaction ---------------------------------------------------------------


#: The whole text, unaltered, behind a planted secret.
_REST = "coalesce(text, '')"


def _redacted(name: str, planted: str, expected: str, kinds: list[str]):
    """A query that plants a secret before every whole text and compares all of it."""
    def run(spark, sf_dir):
        line = redaction.redact(F.expr(f"concat({planted}, ' ', {_REST})"), kinds)
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring_index(line, " ", 12).alias("head"), F.sha1(line.cast("binary")).alias("line_sha"))

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"select doc_id, array_to_string(string_split(line, ' ')[1:12], ' ') as head, sha1(line) as line_sha from (select doc_id, {expected} || ' ' || {_REST} as line from documents)"


_redacted("red_pw_kv", "'DB_PASSWORD=Zq', doc_id, 'xK9'", "'DB_PASSWORD=[REDACTED:pw_kv]'", ["pw_kv"])
_redacted("red_pw_env", "'ROOTPW=\"Aa', doc_id, '#z9\" end'", "'ROOTPW=\"[REDACTED:pw_env]\" end'", ["pw_env"])
_redacted("red_dsn", "'postgresql://app:s3c', doc_id, '@db:5432/x'", "'postgresql://app:[REDACTED:dsn]@db:5432/x'", ["dsn"])
_redacted("red_identified_by", "'ALTER USER a IDENTIFIED BY \"pw', doc_id, '\" ok'", "'ALTER USER a IDENTIFIED BY \"[REDACTED:identified_by]\" ok'", ["identified_by"])
_redacted("red_bearer", "'Authorization: Bearer ', sha1(cast(doc_id as string)), ' x'", "'Authorization: Bearer [REDACTED:bearer] x'", ["bearer"])
_redacted("red_cli_passwords", "'mysql -u r -pXyz', doc_id, 'y db; sshpass -p Zzz', doc_id, 'q ssh h; curl -u bob:Kkk', doc_id, 'w h'", "'mysql -u r -p[REDACTED:mysql_p] db; sshpass -p [REDACTED:sshpass] ssh h; curl -u bob:[REDACTED:basic_auth] h'", ["mysql_p", "sshpass", "basic_auth"])
_redacted("red_token_shapes", "'a sk-', sha1(cast(doc_id as string)), ' b ghp_', sha1(cast(doc_id as string)), ' c AKIA', upper(substring(sha1(cast(doc_id as string)), 1, 16)), ' d xoxb-', sha1(cast(doc_id as string))", "'a [REDACTED:sk_key] b [REDACTED:github_token] c [REDACTED:aws_key] d [REDACTED:slack_token]'", ["sk_key", "github_token", "aws_key", "slack_token"])
_redacted("red_phone", "'call 010-1234-', lpad(doc_id % 10000, 4, '0'), ' or 2010-1234-5678'", "'call [REDACTED:phone] or 2010-1234-5678'", ["phone"])


@query(f"""select doc_id, sha1('say "password=[REDACTED:pw_kv]" ' || {_REST}) as said_sha, doc_id as n from documents""")
def red_json_lines(t) -> DataFrame:
    """Strings inside JSON lines are redacted and the lines still parse."""
    said = F.expr(f"concat('say \"password=Zq', doc_id, 'xK9\" ', {_REST})")
    raw = redaction.redact_json(F.to_json(F.struct(F.col("doc_id").alias("n"), F.array(F.struct(said.alias("said"))).alias("parts"))), ["pw_kv"])
    made = t("documents").select("doc_id", raw.alias("raw"))
    return made.select("doc_id", F.sha1(F.get_json_object("raw", "$.parts[0].said").cast("binary")).alias("said_sha"), F.get_json_object("raw", "$.n").cast("long").alias("n"))


@query(r"select doc_id, sha1(regexp_replace(text, '(^|[^A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}', '\1[REDACTED:email]', 'g')) as sha from documents")
def red_email(t) -> DataFrame:
    return t("documents").select("doc_id", F.sha1(redaction.redact(F.col("text"), ["email"]).cast("binary")).alias("sha"))


@query("select count(*) as n, 0::bigint as changed from documents")
def red_idempotent(t) -> DataFrame:
    once = t("documents").select(redaction.redact(F.concat(F.lit("password=Zq81kLm9 "), "text")).alias("a"))
    return once.select("a", redaction.redact(F.col("a")).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("select cast(sum(len(regexp_extract_all(lower(text), 'sk-[a-z0-9_-]{20,300}'))) as bigint) as n_sk_key, cast(sum(len(regexp_extract_all(text, '(?:AKIA|ASIA)[0-9A-Z]{16}'))) as bigint) as n_aws_key from documents")
def red_counts_by_kind(t) -> DataFrame:
    return t("documents").select(*redaction.counts(F.col("text"), ["sk_key", "aws_key"])).agg(big(F.sum("n_sk_key")).alias("n_sk_key"), big(F.sum("n_aws_key")).alias("n_aws_key"))


@query("select distinct p_partkey, part from (select p_partkey, substr(p_name, i, k) as part from (select p_partkey, p_name, k, unnest(generate_series(1, length(p_name) - k + 1)) as i from (select *, unnest(generate_series(greatest(8, cast(ceil(0.7 * length(p_name)) as int)), length(p_name))) as k from part))) where regexp_matches(part, '[^A-Za-z]')")
def red_known_fragments(t) -> DataFrame:
    return t("part").select("p_partkey", F.explode(redaction.fragments(F.col("p_name"))).alias("part"))


@query("select p_partkey, substr(d, 1, n) as prefix from (select p_partkey, d, unnest(generate_series(6, length(d))) as n from (select p_partkey, unnest([sha256(p_name), sha1(p_name), md5(p_name), sha256(p_name || chr(10)), sha1(p_name || chr(10)), md5(p_name || chr(10))]) as d from part))")
def red_hash_prefix(t) -> DataFrame:
    # A part makes hundreds of rows, so a small file's rows are dealt to all cores first; generators, not arrays
    # in arrays: a digest is worked out once and cut in compiled code.
    p = t("part").select("p_partkey", "p_name")
    each = p.repartition(4 * p.sparkSession.sparkContext.defaultParallelism).select("p_partkey", F.explode(redaction.digests(F.col("p_name"))).alias("d"))
    return each.select("p_partkey", "d", F.explode(F.sequence(F.lit(6), F.length("d"))).alias("n")).select("p_partkey", F.expr("substring(d, 1, n)").alias("prefix"))


@query(r"""with v as (select v, length(v) as n, cast(regexp_matches(v, '[a-z]') as int) + cast(regexp_matches(v, '[A-Z]') as int) + cast(regexp_matches(v, '[0-9]') as int) + cast(regexp_matches(v, '[^A-Za-z0-9]') as int) as c,
    len(list_distinct(string_split(v, ''))) as u, regexp_matches(v, '[A-Za-z]') and regexp_matches(v, '[0-9]') as mixed from (select case when p_partkey % 2 = 0 then replace(p_name, ' ', '') else p_name end as v from part union all select p_brand from part union all select 'k' || p_partkey || p_type from part))
    select case when n < 4 or n > 200 or regexp_matches(v, '\s') or u <= 2 then 'none' when n >= 8 and (mixed or c >= 3) then 'strong' else 'weak' end as strength, count(*) as n from v group by 1""")
def red_value_strength(t) -> DataFrame:
    p = t("part")
    v = p.select(F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name")).alias("v")).unionAll(p.select("p_brand")).unionAll(p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), "p_type")))
    return v.groupBy(redaction.value_strength(F.col("v")).alias("strength")).agg(F.count("*").alias("n"))


@query("select doc_id, sha1(coalesce(text, '') || ' again [REDACTED:known] end') as line_sha from documents")
def red_harvest_two_pass(t) -> DataFrame:
    """Values learned in a secret context anywhere mask the same words in all whole texts."""
    d = t("documents")
    value = F.concat(F.lit("Zq8w"), F.col("doc_id").cast("string"), F.lit("xK9"))
    learned = known.learn(d.select(F.concat(F.lit("password="), value).alias("line")), "line")
    lines = d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" again "), value, F.lit(" end")).alias("line"))
    return known.mask(lines, "line", learned).select("doc_id", F.sha1(F.col("line").cast("binary")).alias("line_sha"))


# Audit -------------------------------------------------------------------


@query("select c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') as mask from customer")
def aud_mask(t) -> DataFrame:
    return t("customer").select("c_custkey", text.shape(F.col("c_name")).alias("mask"))


@query("select page_id, sha1(url_decode(url_decode(url))) as sha from pages")
def aud_normalize_layers(t) -> DataFrame:
    twice = F.try_url_decode(F.try_url_decode("url"))
    return t("pages").select("page_id", F.sha1(F.coalesce(twice, "url").cast("binary")).alias("sha"))


@query("select 'c_name' as col, count(*) filter (regexp_matches(c_name, '[0-9]{6}')) as n from customer union all select 'c_mktsegment', count(*) filter (regexp_matches(c_mktsegment, '[0-9]{6}')) from customer")
def aud_string_column_scan(t) -> DataFrame:
    """Every string column of a table, found by its schema."""
    c = t("customer")
    names = [n for n, k in c.dtypes if k == "string"]
    long = c.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (col, v)"))
    return long.groupBy("col").agg(F.count_if(F.col("v").rlike("[0-9]{6}")).alias("n"))


@query("select event_type, count(*) as changed from events where upper(event_type) <> event_type and event_id % 4 = 0 group by 1")
def aud_rederive_diff(t) -> DataFrame:
    """Stored rows whose recomputed value differs, null-safe."""
    stored = t("events").withColumn("stored", F.when(F.col("event_id") % 4 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return stored.where(~F.col("stored").eqNullSafe(F.col("event_type"))).groupBy("event_type").agg(F.count("*").alias("changed"))


# Cards -------------------------------------------------------------------

_CARDS = "with s as (select *, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as card from conversations)"


def _cards(t) -> DataFrame:
    return ordered.segment(t("conversations"), "conv_id", ["turn"], F.col("role") == "user")


@query(f"{_CARDS} select conv_id, card, count(*) as n_events, min(turn) as first_turn from s where card > 0 group by all")
def card_segment(t) -> DataFrame:
    return _cards(t).where("card > 0").groupBy("conv_id", "card").agg(F.count("*").alias("n_events"), F.min("turn").alias("first_turn"))


@query(f"{_CARDS} select conv_id, count(*) as n_events from s where card = 0 group by 1")
def card_no_human(t) -> DataFrame:
    return _cards(t).where("card = 0").groupBy("conv_id").agg(F.count("*").alias("n_events"))


@query(f"{_CARDS} select conv_id, card, max_by(text, turn) filter (role = 'assistant') as answer from s where card > 0 group by all")
def card_last_answer(t) -> DataFrame:
    return _cards(t).where("card > 0").groupBy("conv_id", "card").agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))


_RUNS = "with s as (select *, cast(sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as card from events)"


def _runs(t) -> DataFrame:
    return ordered.segment(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase")


@query(f"{_RUNS} select user_id, card, count(*) as n_events, count(*) filter (event_type = 'error') as n_err, max(ts) as end_ts from s group by all")
def card_counters(t) -> DataFrame:
    return _runs(t).groupBy("user_id", "card").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_err"), F.max("ts").alias("end_ts"))


@query(f"{_RUNS}, f as (select user_id, card, event_type, min(event_id) as first from (select * from s) group by all) select user_id, card, string_agg(event_type, ',' order by first) as kinds from f group by all")
def card_distinct_lists(t) -> DataFrame:
    """Distinct values in first-seen order."""
    first = _runs(t).groupBy("user_id", "card", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id", "card").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query(f"{_RUNS} select user_id, card, cast(sum(greatest(n - 1, 0)) as bigint) as repeats from (select user_id, card, props, count(*) as n from s where event_type = 'error' group by all) group by all")
def card_err_repeat(t) -> DataFrame:
    per = _runs(t).where("event_type = 'error'").groupBy("user_id", "card", "props").agg(F.count("*").alias("n"))
    return per.groupBy("user_id", "card").agg(big(F.sum(F.greatest(F.col("n") - 1, F.lit(0)))).alias("repeats"))


@query("select user_id, arg_max(event_type, n * 1000000000 - first) as modal from (select user_id, event_type, count(*) as n, min(event_id) as first from events group by all) group by 1")
def card_modal_model(t) -> DataFrame:
    per = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return per.groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("n"), -F.col("first"))).alias("modal"))


@query(f"{_RUNS} select user_id, card, greatest(0.0, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) as dur_s from s group by all")
def card_duration(t) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return _runs(t).groupBy("user_id", "card").agg(F.greatest(F.lit(0.0), us(F.max("ts")) - us(F.min("ts"))).alias("dur_s"))


# Tokens ------------------------------------------------------------------


@query("with b as (select * from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_suppkey) = 1) select l_suppkey, sum(l_quantity) as tokens, count(*) as n from b group by 1")
def tok_best_per_message(t) -> DataFrame:
    """Usage once a message: its row of largest output, the first on ties."""
    best = ordered.first_by(t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber"), ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber", "l_suppkey"])
    return best.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("tokens"), F.count("*").alias("n"))


@query("select l_suppkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) as owner from lineitem group by 1")
def tok_first_owner(t) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.struct("l_orderkey", "l_linenumber")).alias("owner"))


@query("with c as (select l_partkey, min(l_orderkey) as k from lineitem group by 1) select o_custkey, count(*) as claims from c join orders on k = o_orderkey group by 1")
def tok_first_claim(t) -> DataFrame:
    claim = t("lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("o_orderkey"))
    return claim.join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("claims"))


@query("select cast(sum(m) as bigint) as by_card, cast(sum(m) as bigint) as recount from (select max(l_quantity) as m from lineitem group by l_orderkey)")
def tok_conservation(t) -> DataFrame:
    per = t("lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("m"))
    return per.groupBy((F.col("l_orderkey") % 64).alias("g")).agg(F.sum("m").alias("s")).agg(big(F.sum("s")).alias("by_card")).crossJoin(F.broadcast(per.agg(big(F.sum("m")).alias("recount"))))  # one row each


# Joins and state ---------------------------------------------------------


@query("with e as (select event_id, user_id, props, ts, row_number() over (partition by user_id, props order by ts, event_id) as n from events where event_type = 'view') select a.event_id from e a where not exists (select 1 from e b where b.user_id = a.user_id and b.props = a.props and (b.n > a.n or (b.n < a.n and epoch_us(a.ts) - epoch_us(b.ts) <= 120000000)))")
def queue_pairing(t) -> DataFrame:
    views = t("events").where("event_type = 'view' and props is not null")
    return ordered.unpaired(views, ["user_id", "props"], "ts", "event_id").select("event_id")


@query("select event_id from (select *, max(case when event_type = 'purchase' then 1 end) over (partition by user_id, props order by ts, event_id rows between 1 following and unbounded following) as s from events) where event_type = 'error' and s is null")
def err_unresolved(t) -> DataFrame:
    return ordered.unresolved(t("events"), ["user_id", "props"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase").select("event_id")


@query("select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, arg_min(event_type, event_id) as first_type, arg_max(event_type, event_id) as last_type from events group by 1")
def sess_rollup(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("select a.event_id as call_id, b.event_id as card_id from (select * from events where event_type = 'signup') a join (select event_id, user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as until from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts and (b.until is null or a.ts < b.until)")
def view_day_workflow_interval(t) -> DataFrame:
    """Calls in the card open at their time. Cards of a user don't overlap, so the
    range join is an as-of join: one window carries the last card forward."""
    e = t("events").where("event_type in ('signup', 'purchase')").withColumn("order", F.when(F.col("event_type") == "purchase", 0).otherwise(1))
    card = ordered.carry(e, "user_id", ["ts", "order", "event_id"], F.when(F.col("order") == 0, F.col("event_id")), "card_id")
    return card.where("order = 1 and card_id is not null").select(F.col("event_id").alias("call_id"), "card_id")


# Views -------------------------------------------------------------------


@query("select cast(cast(ts + interval 9 hour as date) as varchar) as day, count(*) as n, count(distinct user_id) as users, count(*) filter (event_type = 'error') as n_err from events group by 1")
def view_day_cards(t) -> DataFrame:
    return t("events").groupBy(F.to_date(text.display_time(F.col("ts"))).cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("n_err"))


@query(r"with s as (select *, turn % 4 < 2 or length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) <= 4 as inside from conversations), c as (select *, case when inside = lag(inside) over (partition by conv_id order by turn) then 0 else 1 end as ch from s), i as (select *, cast(sum(ch) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as island from c) select conv_id, island, count(*) as n from i where inside group by all having count(*) >= 2")
def view_day_fold(t) -> DataFrame:
    """Runs of short inputs; of four turns two are typed as a shell line of one character."""
    said = F.coalesce("text", F.lit(""))
    human = F.when(F.col("turn") % 4 < 2, F.concat(F.lit("<bash-input>"), F.substring(said, 1, 1), F.lit("</bash-input>"))).otherwise(said)
    runs = ordered.islands(t("conversations"), "conv_id", ["turn"], display.is_short_input(human))
    return runs.where("inside").groupBy("conv_id", "island").agg(F.count("*").alias("n")).where("n >= 2")


@query("select regexp_replace('proj-' || (100 + user_id % 7) , '[-_]?[0-9]{3,}$', '-*') || event_type as family, count(*) as n from events group by 1")
def view_project_fold(t) -> DataFrame:
    name = text.project_family(F.concat(F.lit("proj-"), (F.col("user_id") % 7 + 100).cast("string")))
    return t("events").groupBy(F.concat(name, "event_type").alias("family")).agg(F.count("*").alias("n"))


_METRICS = "with c as (select o_orderkey, o_totalprice, n, q from orders join (select l_orderkey, count(*)::double as n, sum(l_quantity) as q from lineitem group by 1) on o_orderkey = l_orderkey), u as (select 'price' as metric, o_totalprice as v from c union all select 'lines', n from c union all select 'quantity', q from c)"


@query(f"{_METRICS} select metric, round(quantile_cont(v, 0.5), 4) as median, round(avg(v), 4) as mean, round(quantile_cont(v, 0.9), 4) as p90, round(sum(v), 2) as total from u group by 1")
def view_eff_metrics(t) -> DataFrame:
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    cards = t("orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey")
    long = cards.select(F.expr("stack(3, 'price', o_totalprice, 'lines', n, 'quantity', q) as (metric, v)"))
    sums = long.groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.sum("v"), 2).alias("total"))
    at = quantiles.quantiles(long, ["metric"], "v", {"median": 0.5, "p90": 0.9})
    return sums.join(at, "metric").select("metric", F.round("median", 4).alias("median"), "mean", F.round("p90", 4).alias("p90"), "total")


@query("select coalesce(o_orderpriority, 'total') as bundle, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by rollup(o_orderpriority)")
def view_eff_bundles(t) -> DataFrame:
    return t("orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")).select(F.coalesce("o_orderpriority", F.lit("total")).alias("bundle"), "n", "mean")


@query("with u as (select user_id, max(case when event_type = 'error' then 1 else 0 end) as err, max(case when event_type = 'signup' then 1 else 0 end) as sign, count(*) as n from events group by 1), f as (select 'error' as feature, err as flag, n from u union all select 'signup', sign, n from u) select feature, flag, count(*) as users, round(quantile_cont(n, 0.5), 4) as median from f group by all")
def view_eff_features(t) -> DataFrame:
    has = lambda k: F.max(F.when(F.col("event_type") == k, 1).otherwise(0))
    per = t("events").groupBy("user_id").agg(has("error").alias("err"), has("signup").alias("sign"), F.count("*").alias("n"))
    long = per.select(F.expr("stack(2, 'error', err, 'signup', sign) as (feature, flag)"), F.col("n").cast("double").alias("n"))
    at = quantiles.quantiles(long, ["feature", "flag"], "n", {"median": 0.5})
    return long.groupBy("feature", "flag").agg(F.count("*").alias("users")).join(at, ["feature", "flag"]).select("feature", "flag", "users", F.round("median", 4).alias("median"))


@query("select p_brand, count(*) as n, sum(l_quantity) as tokens from lineitem join part on l_partkey = p_partkey group by 1")
def view_eff_models(t) -> DataFrame:
    return t("lineitem").select("l_partkey", "l_quantity").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("tokens"))


@query("with n as (select o_custkey, count(*) as n from orders group by 1), r as (select *, row_number() over (order by n desc, o_custkey) as rk from n) select case when rk > 10 then 'rest' else cast(o_custkey as varchar) end as family, cast(sum(n) as bigint) as n from r group by 1")
def view_eff_top_rest(t) -> DataFrame:
    """The ten largest and one row for the others; only ten rows are sorted whole."""
    n = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "o_custkey").limit(10)
    rest = n.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_anti").agg(big(F.sum("n")).alias("n"))
    return top.select(F.col("o_custkey").cast("string").alias("family"), "n").unionByName(rest.where("n > 0").select(F.lit("rest").alias("family"), "n"))


@query("select props as sig, count(distinct user_id) as cards, count(*) as n from events where event_type = 'error' group by 1 order by n desc, sig limit 10")
def view_eff_err_top10(t) -> DataFrame:
    return t("events").where("event_type = 'error'").groupBy(F.col("props").alias("sig")).agg(F.countDistinct("user_id").alias("cards"), F.count("*").alias("n")).orderBy(F.desc("n"), "sig").limit(10)


@query("select user_id, max(ts) as last_ts from events group by 1 order by last_ts desc, user_id limit 8")
def view_resume_candidates(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "user_id").limit(8)


@query("select user_id, arg_max(props, event_id) filter (event_type = 'error') as last_error, arg_max(props, event_id) filter (event_type = 'view') as last_view from events group by 1")
def view_resume_latest(t) -> DataFrame:
    last = lambda k: F.max_by(F.when(F.col("event_type") == k, F.col("props")), F.when(F.col("event_type") == k, F.col("event_id"))).alias(f"last_{k}")
    return t("events").groupBy("user_id").agg(last("error"), last("view"))


@query("select doc_id, n_chars from documents where doc_id % 3 = 0 order by n_chars desc, doc_id limit 5")
def view_pending(t) -> DataFrame:
    """Files whose (name, size) the store does not know, the largest first."""
    now = t("documents").select("doc_id", "n_chars")
    return now.join(now.where("doc_id % 3 <> 0"), ["doc_id", "n_chars"], "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(5)


@query("select a.event_id from events a where event_type = 'signup' and not exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'purchase' and (b.ts > a.ts or (b.ts = a.ts and b.event_id > a.event_id)))")
def view_workflows(t) -> DataFrame:
    """Launches that no completion follows."""
    return ordered.unresolved(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase").select("event_id")


# Search ------------------------------------------------------------------

FORMS = ["tion", "ment"]
_SCORE = """with d as (select doc_id, source, lower(text) as b, greatest(0, length(text) - 2) as dl from documents), g as (select count(*) as n, avg(dl) as a, count(*) filter (b like '%tion%') as n0, count(*) filter (b like '%ment%') as n1 from d),
f as (select d.*, g.*, len(list_filter(generate_series(1, length(b)), lambda i: substr(b, i, 4) = 'tion')) as f0, len(list_filter(generate_series(1, length(b)), lambda i: substr(b, i, 4) = 'ment')) as f1 from d, g where b like '%tion%' or b like '%ment%'),
s as (select doc_id, source, (f0 > 0)::int + (f1 > 0)::int as matched, -(greatest(1e-6, ln((n - n0 + 0.5) / (n0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(1e-6, ln((n - n1 + 0.5) / (n1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))) as score from f)"""


def _scored(t) -> DataFrame:
    return search.bm25(t("documents").select("doc_id", "source", F.col("text").alias("body")), FORMS)


@query("select doc_id, (lower(text) like '%tion%')::int + (lower(text) like '%ment%')::int as matched from documents where lower(text) like '%tion%' or lower(text) like '%ment%'")
def search_tokens_or(t) -> DataFrame:
    b = F.lower("text")
    return t("documents").select("doc_id", (b.contains("tion").cast("int") + b.contains("ment").cast("int")).alias("matched")).where("matched > 0")


@query(f"{_SCORE} select doc_id, matched, round(score, 6) as score from s")
def search_bm25(t) -> DataFrame:
    return _scored(t).select("doc_id", "matched", F.round("score", 6).alias("score"))


@query(f"{_SCORE} select doc_id, round(score * pow(matched / 2.0, 2), 6) as ranked from s order by round(score * pow(matched / 2.0, 2), 9), doc_id limit 20")
def search_rank(t) -> DataFrame:
    return search.rank(_scored(t), 2).orderBy(F.round("ranked", 9), "doc_id").limit(20).select("doc_id", F.round("ranked", 6).alias("ranked"))


@query(f"{_SCORE}, n as (select *, row_number() over (partition by source order by round(score * pow(matched / 2.0, 2), 9), doc_id) as k from s) select doc_id, source from n order by (k > 3)::int, round(score * pow(matched / 2.0, 2), 9), doc_id limit 40")
def search_diversify(t) -> DataFrame:
    ranked = search.rank(_scored(t), 2)
    return search.diversify(ranked, "source", [F.round("ranked", 9), "doc_id"], limit=40).select("doc_id", "source")


@query("select doc_id, substr(text, greatest(1, strpos(lower(text), 'tion') - 70), 144) as snip from documents where lower(text) like '%tion%'")
def search_snippet(t) -> DataFrame:
    return t("documents").select("doc_id", search.snippet(F.col("text"), "tion").alias("snip")).where("snip is not null")


@query("select doc_id from documents where lang = 'en' and source not like 'src1%' and doc_id not in (select doc_id from labels where toxic = 1) and contains(lower(text), 'tion')")
def search_filters(t) -> DataFrame:
    d = t("documents").where((F.col("lang") == "en") & ~F.col("source").startswith("src1") & F.lower("text").contains("tion"))
    return d.select("doc_id").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("select d.doc_id, source, toxic from documents d left join labels l on d.doc_id = l.doc_id where cast(d.doc_id as varchar) like '12%'")
def show_lookup(t) -> DataFrame:
    d = t("documents").select("doc_id", "source").where(F.col("doc_id").cast("string").startswith("12"))
    return d.join(t("labels").select("doc_id", "toxic"), "doc_id", "left")


@query("with h as (select conv_id, turn, lower(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60)) as head from conversations where role = 'user') select conv_id, turn from h where turn > 2 and not exists (select 1 from h p where p.conv_id = h.conv_id and p.turn <= 2 and p.head = h.head)")
def hist_dup(t) -> DataFrame:
    h = t("conversations").where("role = 'user'").select("conv_id", "turn", F.lower(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60)).alias("head"))
    return h.where("turn > 2").join(h.where("turn <= 2"), ["conv_id", "head"], "left_anti").select("conv_id", "turn")


@query("select event_type, count(*) as n, min(ts) as first_ts, array_agg(event_id order by ts, event_id)[1] as first_key from events group by 1")
def fmt_distribution(t) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_key"))


@query("select doc_id, case when doc_id % 4 = 0 then 'created' when doc_id % 4 = 1 then 'unchanged' when doc_id % 4 = 2 then 'updated' else 'conflict' end as action from documents")
def export_actions(t) -> DataFrame:
    """Pages against the manifest and what is on disk, compared by digest."""
    sha = lambda s: F.sha1(F.concat(F.col("text"), F.lit(s)).cast("binary"))
    d = t("documents")
    pages = d.select("doc_id", sha("").alias("page"))
    manifest = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, sha("")).otherwise(sha("old")).alias("manifest"))
    disk = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, sha("")).when(F.col("doc_id") % 4 == 2, sha("old")).otherwise(sha("edited")).alias("disk"))
    three = pages.join(manifest, "doc_id", "full_outer").join(disk, "doc_id", "full_outer")
    action = F.when(F.col("disk").isNull(), "created").when(F.col("disk") != F.col("manifest"), "conflict").when(F.col("page") == F.col("disk"), "unchanged").when(F.col("page").isNull(), "removed_stale").otherwise("updated")
    return three.select("doc_id", action.alias("action"))


@query("select cast(cast(ts as date) as varchar) as day, string_agg('- ' || event_type || ' ' || n, chr(10) order by event_type) as body from (select cast(ts as date) as ts, event_type, count(*) as n from events group by all) group by 1")
def export_pages(t) -> DataFrame:
    per = t("events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return per.groupBy("day").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(F.lit("- "), x["event_type"], F.lit(" "), x["n"].cast("string"))), "\n").alias("body"))


@query("select 'union' as op, count(*) as n from (select user_id from events union select c_custkey from customer) union all select 'intersect', count(*) from (select user_id from events intersect select c_custkey from customer) union all select 'except', count(*) from (select c_custkey from customer except select user_id from events)")
def set_ops(t) -> DataFrame:
    a, b = t("events").select(F.col("user_id").cast("long").alias("id")), t("customer").select(F.col("c_custkey").cast("long").alias("id"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(b.subtract(a), "except"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0') || 'Z' as iso, strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M') as shown from events")
def tz_render(t) -> DataFrame:
    return t("events").select("event_id", text.iso_ms(F.col("ts")).alias("iso"), F.date_format(text.display_time(F.col("ts")), "yyyy-MM-dd HH:mm").alias("shown"))


from . import display as _display, lines as _lines, resume as _resume, secrets as _secrets, stored as _stored  # noqa: E402, F401  they register their own
