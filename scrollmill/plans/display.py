"""Queries of what is shown: keys, texts, clocks, pages, short inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, zones
from .registry import query

_HOME = "proj-10"
_NAME = "case when user_id % 5 = 0 then 'proj-10' when user_id % 5 = 1 then 'proj-10-' || user_id when user_id % 5 = 2 then '' else 'proj-' || user_id end"


@query(f"select event_id, case when p = '' then '-' when p = 'proj-10' then '~' when p like 'proj-10-%' then substr(p, 9) else p end as short, 'p-' || case when p = '' then '-' when p = 'proj-10' then '~' when p like 'proj-10-%' then substr(p, 9) else p end as page from (select event_id, {_NAME} as p from events)")
def show_project(t) -> DataFrame:
    p = F.expr(_NAME)
    return t("events").select("event_id", display.short_project(p, _HOME).alias("short"), display.project_page(p, _HOME).alias("page"))


@query("select event_type, case when event_id % 7 = 0 then 'ghost' when event_type = 'view' then 'auto' when event_type = 'error' then 'no_human' else 'human' end as bundle, count(*) as n from events group by all")
def show_bundle(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "sdk").when(F.col("event_type") == "error", "no_human").otherwise("typed")
    return t("events").groupBy("event_type", display.bundle_of(kind, F.col("event_id") % 7).alias("bundle")).agg(F.count("*").alias("n"))


_SECONDS = "round_even(o_totalprice, 0)::bigint"


@query(f"select o_orderkey, case when s < 60 then s || '초' when s < 3600 then s // 60 || '분' else s // 3600 || '시간 ' || s // 60 % 60 || '분' end as shown from (select o_orderkey, {_SECONDS} as s from orders)")
def show_duration(t) -> DataFrame:
    return t("orders").select("o_orderkey", display.duration(F.col("o_totalprice")).alias("shown"))


@query("select l_orderkey, l_linenumber, format('{:,}', l_orderkey) as n from lineitem")
def show_number(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", display.number(F.col("l_orderkey"), 0).alias("n"))


_FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"select doc_id, case when length(f) > 80 then substr(f, 1, 79) || '…' else f end as line, array_to_string(string_split(f, ' ')[1:3], ' ') as head from (select doc_id, {_FLAT} as f from documents)")
def show_one_line(t) -> DataFrame:
    return t("documents").select("doc_id", display.one_line(F.col("text")).alias("line"), display.command_head(F.col("text")).alias("head"))


@query("select doc_id, case when doc_id % 2 = 0 then substr(md5(cast(doc_id as varchar)), 1, 8) || '/' || substr(sha1(cast(doc_id as varchar)), 1, 8) else 's:' || doc_id end as short, case when doc_id % 2 = 0 then md5(cast(doc_id as varchar)) || ':' || sha1(cast(doc_id as varchar)) else 's:' || doc_id end as ref, case when doc_id % 2 = 0 then 'c-' || substr(md5(cast(doc_id as varchar)), 1, 8) || '-' || substr(sha1(cast(doc_id as varchar)), 1, 8) else 'c-' || substr(cast(doc_id as varchar), 1, 8) || '-' || substr(cast(doc_id as varchar), 1, 8) end as file from documents")
def show_keys(t) -> DataFrame:
    i = F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c:"), F.md5(i.cast("binary")), F.lit(":"), F.sha1(i.cast("binary")))).otherwise(F.concat(F.lit("s:"), i))
    return t("documents").select("doc_id", display.short_key(key).alias("short"), display.event_ref(key).alias("ref"), display.card_file(key).alias("file"))


_TRIMMED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(rf"""with w as (select doc_id, {_TRIMMED} as w from documents),
    l as (select doc_id, w, list_filter(string_split(substr(w, 1, 600), chr(10)), lambda x: regexp_matches(x, '\S')) as own, len(list_filter(string_split(w, chr(10)), lambda x: regexp_matches(x, '\S'))) as n from w)
    select doc_id, sha1(array_to_string(list_concat(list_transform(own[1:15], lambda x: '> ' || x), case when length(w) > 600 or len(own) > 15 then ['> …(잘림: 전체 ' || length(w) || '자 ' || n || '줄 중 앞 ' || least(15, len(own)) || '줄)'] else [] end), chr(10))) as quote_sha,
    sha1(case when w = '' then '> (없음)' else '> ' || replace(case when length(w) > 1500 then substr(w, 1, 1500) || '…(잘림)' else w end, chr(10), chr(10) || '> ') end) as page_sha from l""")
def show_quote(t) -> DataFrame:
    sha = lambda c: F.sha1(c.cast("binary"))
    return t("documents").select("doc_id", sha(F.array_join(display.quoted_lines(F.col("text")), "\n")).alias("quote_sha"), sha(display.quoted(F.col("text"))).alias("page_sha"))


@query("select doc_id, '- Current Work: ' || case when length(f) > 300 then substr(f, 1, 299) || '…' else f end as lines from (select doc_id, " + _FLAT + " as f from documents)")
def show_summary_lines(t) -> DataFrame:
    sections = F.array(F.struct(F.lit("Primary Request").alias("title"), F.lit("x").alias("body")), F.struct(F.lit("3 Current work").alias("title"), F.col("text").alias("body")), F.struct(F.lit("current work again").alias("title"), F.lit("y").alias("body")))
    return t("documents").select("doc_id", F.array_join(display.summary_lines(sections), "\n").alias("lines"))


@query("select event_id, strftime(ts + interval 90 minute, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0') || 'Z' as later, (epoch_us(timestamp '2024-06-01 00:00:00') - epoch_us(ts)) / 1e6 as age_s from events")
def show_age(t) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-06-01 00:00:00'")
    return t("events").select("event_id", display.shifted_iso(F.col("ts"), 5400).alias("later"), display.seconds_between(F.col("ts"), now).alias("age_s"))


@query(r"with c as (select conv_id, turn, case turn % 3 when 0 then '! ' || trim(substr(text, 1, 3)) when 1 then trim('/go ' || substr(text, 1, 1)) else text end as shown from (select conv_id, turn, coalesce(text, '') as text from conversations)) select conv_id, turn, sha1(shown) as text_sha, length(regexp_replace(shown, '\s+', '', 'g')) <= 4 as short from c")
def show_card_text(t) -> DataFrame:
    said, way = F.coalesce("text", F.lit("")), F.col("turn") % 3
    human = (
        F.when(way == 0, F.concat(F.lit("<bash-input>"), F.substring(said, 1, 3), F.lit("</bash-input>")))
        .when(way == 1, F.concat(F.lit("<command-name>/go</command-name><command-args>"), F.substring(said, 1, 1), F.lit("</command-args>"))).otherwise(said)
    )
    return t("conversations").select("conv_id", "turn", F.sha1(display.card_text(human).cast("binary")).alias("text_sha"), display.is_short_input(human).alias("short"))


@query("select doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || coalesce('\"' || lang || '\"', 'null') || chr(10) || 'gone: null' || chr(10) || 'tags: [' || coalesce('\"' || source || '\",', '') || '\"b\"]' || chr(10) || '---' as head from documents")
def export_front_matter(t) -> DataFrame:
    fields = {"id": F.col("doc_id"), "lang": F.col("lang"), "gone": F.lit(None).cast("string"), "tags": F.array_compact(F.array("source", F.lit("b")))}
    return t("documents").select("doc_id", display.front_matter(**fields).alias("head"))


@query("select doc_id, sha1(concat_ws(chr(10), nullif(substr(text, 1, 2000), ''), nullif(substr(text, 1, 800), ''), source, lang)) as body_sha from documents")
def card_search_text(t) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    body = display.card_search_body(F.col("text"), F.col("text"), F.array_compact(F.array("source")), F.array_compact(F.array("lang")), none)
    return t("documents").select("doc_id", F.sha1(body.cast("binary")).alias("body_sha"))


@query("select doc_id, sha1(case doc_id % 6 when 0 then text when 1 then substr(text, 1, 8000) when 2 then substr(text, 1, 6000) when 3 then substr(text, 1, 6000) when 4 then substr(text, 1, 1000) end) as body_sha from documents")
def doc_index_body(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, [*display.DOCUMENT_CAPS, "other"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return t("documents").select("doc_id", F.sha1(display.document_body(kind, F.col("text")).cast("binary")).alias("body_sha"))


# Clocks: a region with a summer time, by its rules --------------------------------

def _summer(ts: str) -> str:
    """Whether New York's clock is ahead: from the second Sunday of March, 2 am, to
    the first of November; before 2007 from April's first to October's last."""
    day = lambda m, nth: f"make_date(year({ts}), {m}, 1) + cast((7 - isodow(make_date(year({ts}), {m}, 1))) % 7 + {7 * (nth - 1)} as int)"
    last = f"make_date(year({ts}), 10, 31) - cast(isodow(make_date(year({ts}), 10, 31)) % 7 as int)"
    begin, end = (f"(case when year({ts}) < 2007 then {old} else {new} end)" for old, new in ((day(4, 1), day(3, 2)), (last, day(11, 1))))
    return f"({ts} >= {begin} + interval 7 hour and {ts} < {end} + interval 6 hour)"


_LOCAL = f"(ts - case when {_summer('ts')} then interval 4 hour else interval 5 hour end)"


@query(f"select event_id, strftime({_LOCAL}, '%Y-%m-%d %H:%M') || case when {_summer('ts')} then ' EDT' else ' EST' end as shown, cast(cast({_LOCAL} as date) as varchar) as day from events")
def tz_region(t) -> DataFrame:
    ts = F.col("ts")
    return t("events").select("event_id", zones.local_text_labelled(ts, "America/New_York").alias("shown"), zones.local_date(ts, "America/New_York").cast("string").alias("day"))


@query("select event_id, strftime(ts + interval 330 minute, '%Y-%m-%d %H:%M') || ' UTC+05:30' as shown, strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M') || ' KST' as fallback from events")
def tz_offset(t) -> DataFrame:
    ts = F.col("ts")
    return t("events").select("event_id", zones.local_text_labelled(ts, "+5:30").alias("shown"), zones.local_text_labelled(ts, "no/such").alias("fallback"))


@query(f"with d as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1), b as (select d, n, d::timestamp + interval 5 hour as lo, (d + 1)::timestamp + interval 5 hour as hi from d) select cast(d as varchar) as day, n, cast(24 + case when {_summer('lo')} then 1 else 0 end - case when {_summer('hi')} then 1 else 0 end as int) as hours from b")
def tz_day_bounds(t) -> DataFrame:
    days = t("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    b = zones.day_bounds(F.col("d"), "America/New_York")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return days.select(F.col("d").cast("string").alias("day"), "n", ((us(b["hi"]) - us(b["lo"])) / 3_600_000_000).cast("int").alias("hours"))
