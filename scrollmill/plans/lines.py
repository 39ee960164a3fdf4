"""Queries of tool calls, cards, words searched and prompts cross-checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content
from ..operators import cards, history, search, tools
from .registry import _SCORE, query

_FIRST = r"substr(trim(regexp_extract({}, '(?m)^[ \t]*([^\s][^\n]*)', 1)), 1, 160)"


def _lines(t) -> DataFrame:
    """Odd turns call a tool with their text, even ones give the result of the call before."""
    said, i = F.substring(F.coalesce("text", F.lit("")), 1, 2000), F.concat_ws("_", "conv_id", F.col("turn").cast("string"))
    before = F.concat_ws("_", "conv_id", (F.col("turn") - 1).cast("string"))
    use = F.struct(F.lit("tool_use").alias("type"), i.alias("id"), F.lit("Bash").alias("name"), F.struct(said.alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), before.alias("tool_use_id"), (F.col("turn") % 4 == 0).alias("is_error"), F.coalesce("text", F.lit("")).alias("content"))
    raw = lambda kind, block: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    v = F.try_parse_json(F.when(F.col("turn") % 2 == 1, raw("assistant", use)).otherwise(raw("user", result)))
    made = t("conversations").select("conv_id", "turn", v.alias("v"))
    return made.select(
        F.concat_ws(":", "conv_id", F.col("turn").cast("string")).alias("key"), F.col("conv_id").cast("string").alias("sid"), F.col("conv_id").cast("string").alias("fid"), F.col("turn").alias("off"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.when(F.col("turn") % 2 == 1, content.tool_uses(F.col("v"))).alias("tool_uses"), F.when(F.col("turn") % 2 == 0, content.tool_results(F.col("v"))).alias("tool_results"),
    )


@query(f"select r.conv_id, r.turn, case when c.turn is not null then 'Bash' end as name, nullif({_FIRST.format('substr(c.text, 1, 2000)')}, '') as cmd, cast(r.turn % 4 = 0 as int) as is_err, sha1(coalesce(r.text, '')) as text_sha from conversations r left join conversations c on c.conv_id = r.conv_id and c.turn = r.turn - 1 where r.turn % 2 = 0")
def tool_pairs(t) -> DataFrame:
    """Results with the call that they answer."""
    lines = _lines(t)
    paired = tools.with_calls(tools.results(lines), tools.uses(lines))
    return paired.select(F.col("sid").cast("long").alias("conv_id"), F.col("off").alias("turn"), "name", F.nullif("cmd", F.lit("")).alias("cmd"), "is_err", F.sha1(F.col("text").cast("binary")).alias("text_sha"))


@query("""with s as (select *, role = 'user' as st, role = 'assistant' as wk from conversations),
    b as (select *, wk and coalesce(max(cast(st or wk as int)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 0 as nh from s),
    o as (select *, sum(cast(st or nh as int)) over (partition by conv_id order by turn rows unbounded preceding) as card from b)
    select conv_id, card - 1 as seq, case when bool_or(nh) then 'no_human' else 'human:typed' end as human_kind, count(*) as n_events, count(*) filter (wk) as n_asst, cast(coalesce(sum(length(text)) filter (wk), 0) as bigint) as tok_out,
    sha1(max_by(text, turn) filter (wk)) as answer_sha from o where card > 0 group by conv_id, card""")
def card_table(t) -> DataFrame:
    c, i = t("conversations"), F.col("conv_id").cast("string")
    none = lambda kind: F.expr(f"cast(null as {kind})")
    asst = F.col("role") == "assistant"
    lines = c.select(
        F.concat_ws(":", i, F.col("turn").cast("string")).alias("key"), i.alias("sid"), i.alias("path"), i.alias("fid"), F.col("turn").alias("off"), F.timestamp_seconds("turn").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("kind"), F.when(asst, "text").when(F.col("role") == "user", "typed").alias("kind_sub"), "text",
        F.when(asst, F.concat_ws(":", i, F.col("turn").cast("string"))).alias("msg_id"), F.when(asst, "m").alias("model"), F.lit(0).alias("u_in"), F.length("text").cast("long").alias("u_out"), F.lit(0).alias("u_cc"), F.lit(0).alias("u_cr"),
        none("array<struct<tuid:string,idx:int,name:string,fpath:string,cmd:string>>").alias("tool_uses"), none("array<struct<tuid:string,is_err:int,err_line:string,err_sig:string,denial:string,intr:int,link:string>>").alias("tool_results"),
    )
    made = cards.assemble(lines)
    return made.select(F.col("sid").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "human_kind", "n_events", "n_asst", "tok_out", F.sha1(F.col("last_answer").cast("binary")).alias("answer_sha"))


_WORDS = "tion ment an"


@query(f"""{_SCORE}, k as (select doc_id, score from s order by score, doc_id limit 3000), a as (select d.doc_id, d.source, k.score, (b like '%tion%')::int + (b like '%ment%')::int + (b like '%an%')::int as m from d left join k on d.doc_id = k.doc_id where k.doc_id is not null or b like '%an%'),
    r as (select *, round(coalesce(score, 0) * pow(m / 3.0, 2), 9) as ranked, row_number() over (partition by source order by round(coalesce(score, 0) * pow(m / 3.0, 2), 9), m desc, doc_id) as n from a)
    select doc_id, m as matched from r order by (n > 3)::int, ranked, m desc, doc_id limit 20""")
def search_words(t) -> DataFrame:
    """Long and short words, best first, at most three of a source before the rest."""
    rows = t("documents").select(F.col("doc_id").alias("key"), F.lit("doc").alias("kind"), F.lit(None).cast("timestamp").alias("ts"), F.col("source").alias("sid"), F.col("text").alias("body"))
    return search.search(rows, _WORDS).select(F.col("key").alias("doc_id"), "matched")


_HEAD = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""with c as (select conv_id, turn, {_HEAD} as t from conversations where role = 'user'), p as (select conv_id, turn, trim(substr(t, 1, 30)) as probe from c where turn % 3 = 0),
    m as (select p.*, length(probe) < 4 as short, exists (select 1 from c where c.conv_id = p.conv_id and turn % 2 = 0 and contains(c.t, p.probe)) as hit, exists (select 1 from c where c.conv_id = p.conv_id and contains(c.t, p.probe)) as seen from p)
    select conv_id, turn, case when short then 'placeholder_only' when hit then 'matched' when seen then 'missed' else 'history_only' end as reason from m""")
def hist_crosscheck(t) -> DataFrame:
    """Every third prompt against the inputs of even turns, and against all."""
    u = t("conversations").where("role = 'user'").select(F.col("conv_id").alias("sid"), "turn", "text")
    found = history.crosscheck(u.where("turn % 3 = 0").withColumnRenamed("turn", "id"), u.where("turn % 2 = 0"), u)
    return found.select(F.col("sid").alias("conv_id"), F.col("id").alias("turn"), "reason")
