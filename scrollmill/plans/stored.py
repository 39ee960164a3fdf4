"""Queries that ingest the driver's tables in batches and read what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import documents, ingest
from ..streaming.store import scratch
from .registry import query

#: Whole texts of small letters: nothing in them looks like a secret.
_PLAIN = "regexp_replace(coalesce(text, ''), '[^a-z ]', ' '{})"


@query(f"""
with d as (select doc_id, {_PLAIN.format(", 'g'")} as body, doc_id % 7 <> 1 as one, doc_id % 5 <> 2 as two, doc_id % 3 = 0 as differs from documents)
select doc_id, sha1(body || case when two and differs then ' v2' else '' end) as text_sha, cast(not two as int) as missing,
    case when two and (differs or not one) then 2 else 1 end as loaded_in_run, sha1(body || case when two and differs then ' v2' else '' end) as searched_sha
from d where one or two""")
def doc_upsert_two_runs(t) -> DataFrame:
    """Documents after two listings: some new, some changed, some gone."""
    d = t("documents")
    spark = d.sparkSession
    shelf = documents.Shelf(spark, scratch(spark, "documents"), 8)
    plain, path = F.expr(_PLAIN.format("")), F.concat(F.lit("p/memory/"), F.col("doc_id").cast("string"), F.lit(".md"))
    for run, (there, body) in enumerate(((d["doc_id"] % 7 != 1, plain), (d["doc_id"] % 5 != 2, F.concat(plain, F.when(F.col("doc_id") % 3 == 0, " v2").otherwise(""))))):
        files = d.where(there).select(path.alias("path"), F.lit("memory").alias("kind"), F.lit("p").alias("project"), F.lit(None).cast("string").alias("sid"), body.alias("content"), F.lit(0).cast("timestamp").alias("mtime"))
        documents.load_documents(files, shelf, "runs", run, F.timestamp_seconds(F.lit(run + 1)))
    found = shelf.search.read().select(F.expr("substring(key, 3)").alias("path"), F.sha1(F.col("body").cast("binary")).alias("searched_sha"))
    ident = F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("long")
    kept = shelf.docs.read().select("path", F.sha1(F.col("text").cast("binary")).alias("text_sha"), "missing", F.unix_seconds("updated").cast("int").alias("loaded_in_run"))
    # A document without text has no search row: nothing of it is searched.
    searched = F.coalesce("searched_sha", F.sha1(F.lit("").cast("binary")))
    return kept.join(found, "path", "left").select(ident.alias("doc_id"), "text_sha", "missing", "loaded_in_run", searched.alias("searched_sha"))


@query("""
with t as (
    select conv_id, turn, role, case when turn = 0 then 'meta' when turn % 3 = 1 then 'turn' else 'said' end as way from conversations),
s as (
    select *, case when way = 'meta' then '/w/' || conv_id when way = 'turn' then '/w/' || conv_id || '/' || turn end as c,
        case when way = 'turn' then 'm' || turn end as m from t)
select conv_id, turn, case when way <> 'said' then 'system' when role = 'assistant' then 'assistant' when max(turn = 0) over (partition by conv_id) and conv_id % 2 = 0 then 'sdk' else 'human' end as kind,
    last_value(c ignore nulls) over w as cwd, case when way = 'said' and role = 'assistant' then last_value(m ignore nulls) over w end as model
from s window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def ingest_rollout_batches(t) -> DataFrame:
    """Files of the second dialect in three batches: the state goes on."""
    c = t("conversations")
    spark = c.sparkSession
    ident, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    block = F.struct(F.when(F.col("role") == "assistant", "output_text").otherwise("input_text").alias("type"), F.lit("x").alias("text"))
    payload = F.struct(
        F.when((F.col("turn") != 0) & (F.col("turn") % 3 != 1), "message").alias("type"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"), F.array(block).alias("content"),
        F.when(F.col("turn") == 0, ident).alias("id"), F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "exec").alias("source"),
        F.when(F.col("turn") == 0, F.concat(F.lit("/w/"), ident)).otherwise(F.when(F.col("turn") % 3 == 1, F.concat(F.lit("/w/"), ident, F.lit("/"), turn))).alias("cwd"),
        F.when(F.col("turn") % 3 == 1, F.concat(F.lit("m"), turn)).alias("model"),
    )
    kind = F.when(F.col("turn") == 0, "session_meta").when(F.col("turn") % 3 == 1, "turn_context").otherwise("response_item")
    lines = c.select(F.concat(F.lit("codex/"), ident, F.lit(".jsonl")).alias("path"), F.col("turn").cast("long").alias("off"), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))).alias("raw"))
    tables = ingest.Tables(spark, scratch(spark, "ingest"), 8)
    for batch, part in enumerate(("off < 2", "off >= 2 and off < 4", "off >= 4")):
        ingest.ingest_batch(lines.where(part), tables, "turns", batch)
    return tables.events.read().select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("conv_id"), F.col("off").cast(c.schema["turn"].dataType).alias("turn"), "kind", "cwd", "model")
