"""Queries of what a session resumes with, of bare commands, names and late values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..operators import changes, history, names, rederive, resume, show
from ..streaming.store import Store, scratch
from .registry import query


@query("""
with recursive c as (
    select conv_id, turn, role, coalesce(text, '') as text, 400 + (conv_id % 10) * 200 as most, row_number() over (partition by conv_id order by turn) as nr, 2 + length(cast(conv_id as varchar)) + 1 as head from conversations),
packed(conv_id, nr, used, kept, cut) as (
    select distinct conv_id, cast(0 as bigint), cast(head + 10 as bigint), cast(0 as bigint), head + 10 + 120 > most from c
    union all
    select p.conv_id, c.nr, case when p.cut or p.used + length(c.text) + 1 + 120 > c.most then p.used else p.used + length(c.text) + 1 end,
        case when p.cut or p.used + length(c.text) + 1 + 120 > c.most then p.kept else p.kept + 1 end, p.cut or p.used + length(c.text) + 1 + 120 > c.most
    from packed p join c on c.conv_id = p.conv_id and c.nr = p.nr + 1),
last as (select conv_id, max(nr) as n, max(kept) as kept from packed group by conv_id)
select l.conv_id, sha1('# ' || l.conv_id || chr(10) || chr(10) || '## turns' || chr(10)
    || coalesce((select string_agg(text || chr(10), '' order by nr) from c where c.conv_id = l.conv_id and c.nr <= l.kept), '')
    || case when n > kept then '- (잘림: 이 절 ' || (n - kept) || '줄 생략)' || chr(10) || chr(10) || '_잘림: 상한 ' || (400 + (l.conv_id % 10) * 200) || '자 · 생략 ' || (n - kept) || '줄_' || chr(10) else '' end) as text_sha
from last l""")
def resume_packed(t) -> DataFrame:
    """Each conversation's turns as one part, packed under a limit of its own."""
    c = t("conversations")
    heads = c.select(F.col("conv_id").alias("id")).distinct().withColumn("head", F.array(F.concat(F.lit("# "), F.col("id").cast("string"))))
    lines = c.select(F.col("conv_id").alias("id"), F.lit(1).alias("part"), F.lit("turns").alias("title"), F.col("turn").alias("line_no"), F.coalesce("text", F.lit("")).alias("line"))
    made = resume.assemble(heads, lines, F.lit(400) + (F.col("id") % 10) * 200)
    return made.select(F.col("id").alias("conv_id"), F.sha1(F.concat("text", F.lit("\n")).cast("binary")).alias("text_sha"))


@query("""
with e as (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts desc nulls last, lpad(cast(event_id as varchar), 12, '0') desc) as nr from events),
s as (select *, row_number() over (partition by user_id order by nr) as k from e where nr <= 8 and event_type <> 'error')
select user_id, event_id, row_number() over (partition by user_id order by k desc) as place from s where k <= 5""")
def resume_recent_cards(t) -> DataFrame:
    e = t("events").select(F.col("user_id").alias("project"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("key"), F.col("event_type").alias("sid"), "ts", "event_id")
    found = resume.recent_cards(e, e.select("sid").where("sid = 'error'"))
    return found.select(F.col("project").alias("user_id"), "event_id", F.col("place").cast("long").alias("place"))


_NAME = "'/' || substr(md5(coalesce(text, '')), 1, 1)"


@query(f"""
with l as (select conv_id, turn, {_NAME} as name, turn % 4 as way from conversations),
p as (select conv_id, turn, name, row_number() over (partition by conv_id, name order by turn) as nth from l where way = 0 or way = 1),
h as (select conv_id, name, count(*) filter (where way = 1) as a, count(*) filter (where way = 2) as b, count(*) filter (where way = 3) as c from l group by 1, 2)
select p.conv_id, turn, p.name, case when nth <= a then 'slash_counted' when nth <= a + b then 'slash_uncounted' when nth <= a + b + c then 'slash_local_command' else 'slash_no_line' end as bucket
from p join h on p.conv_id = h.conv_id and p.name = h.name""")
def hist_bare_commands(t) -> DataFrame:
    """Turns as bare commands: half of them prompts, the rest lines of three kinds."""
    name = F.concat(F.lit("/"), F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 1))
    way = F.col("turn") % 4
    c = t("conversations").select(F.col("conv_id").alias("sid"), F.col("turn").alias("id"), name.alias("text"), way.alias("way"))
    lines = c.where("way > 0").select(
        "sid", F.when(F.col("way") == 3, "system").otherwise("user").alias("type"), F.when(F.col("way") == 1, "command").otherwise("meta").alias("kind"), F.when(F.col("way") == 3, "local_command").alias("sub"), F.lit(False).alias("side"),
        F.when(F.col("way") == 2, F.col("text")).otherwise(F.concat(F.lit("<command-name>"), "text", F.lit("</command-name>"))).alias("text"),
    )
    paired, _ = history.pair_commands(c.where("way < 2").drop("way"), lines)
    return paired.select(F.col("sid").alias("conv_id"), F.col("id").alias("turn"), "name", "bucket")


@query("""
with asked as (
    select p_partkey, case p_partkey % 6 when 0 then 'P-' || p_partkey when 1 then '/cwd/' || p_partkey || '/' when 2 then '/card/' || p_partkey when 3 then '/Made.of ' || p_partkey when 4 then 'short' || p_partkey else 'brand' || substr(p_brand, 7) end as name from part),
shorts as (select 'brand' || substr(p_brand, 7) as name, count(*) as n, min(p_partkey) as k from part where p_partkey % 6 = 5 group by 1)
select a.p_partkey, case p_partkey % 6 when 0 then 'P-' || p_partkey when 1 then 'session-' || (p_partkey + 1) when 2 then 'card-' || p_partkey when 3 then '-Made-of-' || p_partkey when 4 then '-h-short' || p_partkey else case when s.n = 1 then '-h-brand' || substr(a.name, 6) || '#' || s.k end end as project,
    case p_partkey % 6 when 0 then 'exact' when 1 then 'session_folder' when 2 then 'card_folder' when 3 then 'made_of_folder' when 4 then 'short_name' else case when s.n = 1 then 'short_name' end end as level
from asked a left join shorts s on a.name = s.name and p_partkey % 6 = 5""")
def project_resolve(t) -> DataFrame:
    """Names of all five kinds, and short names that several projects share."""
    p, way, k = t("part"), F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    tell = lambda head, tail="": F.concat(F.lit(head), k, F.lit(tail))
    brand = F.substr("p_brand", F.lit(7))
    asked = p.select("p_partkey", F.when(way == 0, tell("P-")).when(way == 1, tell("/cwd/", "/")).when(way == 2, tell("/card/")).when(way == 3, tell("/Made.of ")).when(way == 4, tell("short")).otherwise(F.concat(F.lit("brand"), brand)).alias("name"))
    projects = p.where(way.isin(0, 3, 4, 5)).select(F.when(way == 0, tell("P-")).when(way == 3, tell("-Made-of-")).when(way == 4, tell("-h-short")).otherwise(F.concat(F.lit("-h-brand"), brand, F.lit("#"), k)).alias("project"))
    at = lambda n: F.timestamp_seconds(F.lit(n))
    sessions = p.where(way == 1).select(tell("/cwd/").alias("cwd"), F.explode(F.array(F.struct(tell("session-").alias("project"), at(1).alias("ts")), F.struct(F.concat(F.lit("session-"), (F.col("p_partkey") + 1).cast("string")).alias("project"), at(2).alias("ts")))).alias("x")).select("cwd", "x.*")
    cards = p.where(way == 2).select(tell("/card/").alias("cwd"), tell("card-").alias("project"), at(1).alias("ts"))
    short = lambda c: F.regexp_replace(display.short_project(c, "-h"), "#.*$", "")
    return names.resolve(asked, projects, sessions, cards, short).select("p_partkey", "project", "level")


@query("""
with d as (select doc_id, coalesce(text, '') as body, doc_id % 11 = 0 as hit from documents)
select doc_id, sha1(body || case when hit then ' [REDACTED:known] end' else ' end' end) as text_sha, hit as changed from d""")
def red_retro(t) -> DataFrame:
    """Stored whole texts after late values were masked; every eleventh holds one."""
    d = t("documents")
    spark = d.sparkSession
    value = F.expr("concat('Kx7#', doc_id, '$Quatt9Zz')")
    store = Store(spark, scratch(spark, "retro"), "doc_id long, text string", ["doc_id"], 8)
    store.append(d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit(" "), value)).otherwise(F.lit("")), F.lit(" end")).alias("text")), "in", 0)
    learned = d.where("doc_id % 11 = 0").select(value.alias("value"), F.lit("strong").alias("strength"))
    rederive.retro(store, ["text"], learned, "late", 0)
    return store.read().select("doc_id", F.sha1(F.col("text").cast("binary")).alias("text_sha"), F.col("text").contains("[REDACTED:known] end").alias("changed"))


@query("""
with f as (
    select source as project, doc_id, n_chars as size, 1700000000 + doc_id * 97 % 20000 as moved, doc_id % 3 = 0 as same from documents),
n as (select * from f where not same and moved > 1700006000 and moved >= 1700015000 - 9000 and moved <= 1700015000 + 60),
r as (select *, row_number() over (partition by project order by moved desc, 's' || doc_id) as place, count(*) over (partition by project) as found from n)
select project, 's' || doc_id as sid, moved as changed_at, place, greatest(found - 5, 0) as beyond from r where place <= 5""")
def pending_changed_files(t) -> DataFrame:
    """Documents as session files: what changed since a collection, by project."""
    at = lambda n: F.timestamp_seconds(n if not isinstance(n, int) else F.lit(n))
    d = t("documents").select(F.col("source").alias("project"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sid"), F.col("n_chars").alias("size"), at(F.lit(1700000000) + F.col("doc_id") * 97 % 20000).alias("mtime"), "doc_id")
    known = d.where("doc_id % 3 < 2").select("path", (F.col("size") + F.col("doc_id") % 3).alias("size"))
    found = changes.pending(d.drop("doc_id"), known, at(1700015000), at(1700006000))
    return found.select("project", "sid", F.unix_seconds("mtime").alias("changed_at"), F.col("place").cast("long").alias("place"), F.col("beyond").cast("long").alias("beyond"))


@query("""
select case doc_id % 3 when 0 then 'd:m/' || doc_id when 1 then '문서 m/' || doc_id else '[m/' || doc_id || ']' end as asked,
    sha1('# 문서 m/' || doc_id || chr(10) || '- 종류 memory · 프로젝트 ' || coalesce(nullif(source, ''), '-') || ' · 갱신 1970-01-01 09:00 KST' || chr(10) || chr(10) || coalesce(nullif(text, ''), '(본문 없음)')) as shown_sha
from documents
union all
select conv_id || '/' || turn, sha1('# 행 ' || conv_id || '/' || turn || chr(10) || '- 종류 ' || role || ' · 1970-01-01 09:00 KST · 프로젝트 - · 세션 ' || conv_id || ' · 원천 ' || case when conv_id % 2 = 0 then 'session' else '-' end || chr(10) || chr(10) || coalesce(nullif(text, ''), '(본문 없음)'))
from conversations""")
def show_by_key(t) -> DataFrame:
    """Whole documents and lines, by three forms of a key."""
    d, c = t("documents"), t("conversations")
    path = F.concat(F.lit("m/"), F.col("doc_id").cast("string"))
    asked = d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("d:"), path)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("문서 "), path)).otherwise(F.concat(F.lit("["), path, F.lit("]"))).alias("asked"))
    key, sid = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("conv_id").cast("string")
    zero = F.lit(0).cast("timestamp")
    events = c.select(key.alias("key"), sid.alias("fid"), F.col("role").alias("kind"), F.lit(None).cast("string").alias("kind_sub"), zero.alias("ts"), F.lit(None).cast("string").alias("project"), sid.alias("sid"), "text")
    files = events.where("cast(fid as long) % 2 = 0").select("fid", F.lit("session").alias("kind"))
    docs = d.select(path.alias("path"), F.lit("memory").alias("kind"), F.col("source").alias("project"), zero.alias("updated"), "text")
    none = "key string, sid string, project string, start_ts timestamp, end_ts timestamp, dur_s double, human string, last_answer string, n_tools long, files array<string>, cmds array<string>, n_err long, human_kind string, delivered int"
    found = show.show(asked.unionByName(events.select(F.col("key").alias("asked"))), d.sparkSession.createDataFrame([], none), events, files, docs, "Asia/Seoul", "-h")
    return found.select("asked", F.sha1(F.col("text").cast("binary")).alias("shown_sha"))
