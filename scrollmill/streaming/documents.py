"""Whole documents (notes, run records, scripts, tool outputs) as a keyed table,
and the rows by which they are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import document_body
from ..functions.redaction import redact, redact_json
from .store import BUCKET, Store

DOCUMENTS = "path string, kind string, project string, sid string, sha1 string, size long, mtime timestamp, text string, meta string, missing int, first_seen timestamp, updated timestamp"
SEARCH = "key string, body string, kind string, project string, ts timestamp, sid string"

# The fields of a record that are kept beside its text.
RECORD_FIELDS = {
    "agent_meta": ["agentType", "description", "toolUseId", "workflowPhase", "model", "spawnDepth", "requestShape"],
    "wf_run": ["runId", "workflowName", "summary", "status", "totalTokens", "totalToolCalls", "agentCount", "durationMs", "taskId", "timestamp", "defaultModel"],
}


class Shelf:
    """The two tables of documents, side by side."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.docs = Store(spark, f"{path}-docs", DOCUMENTS, ["path"], buckets)
        self.search = Store(spark, f"{path}-search", SEARCH, ["key"], buckets)


def _json(v: Column, path: str) -> Column:
    """The value at a path as JSON text; null if it is missing or null."""
    whole = F.to_json(F.struct(F.try_variant_get(v, path, "variant").alias("x")))
    return F.nullif(F.nullif(F.regexp_extract(whole, r'^\{"x":([\s\S]*)\}$', 1), F.lit("")), F.lit("null"))


def _meta(kind: Column, v: Column, path: Column) -> Column:
    """A record's kept fields as a JSON object, missing ones null."""
    listed = lambda fields: F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), F.coalesce(_json(v, f"$.{f}"), F.lit("null"))) for f in fields])
    agent = F.regexp_extract(path, r"(?:^|/)agent-([^/]*)\.meta\.json$", 1)
    made = F.when(kind == "agent_meta", F.concat(listed(RECORD_FIELDS["agent_meta"]), F.lit(',"agentId":'), F.regexp_replace(F.to_json(F.array(agent)), r"^\[|\]$", "")))
    return F.concat(F.lit("{"), F.coalesce(made.when(kind == "wf_run", listed(RECORD_FIELDS["wf_run"])), F.lit("")), F.lit("}"))


def read_documents(files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, project, sid, content, mtime) to rows of the table, redacted;
    columns ``also`` go along.

    Records are redacted string by string before anything is taken from them, and
    the text that comes out is redacted once more. Bytes that are not UTF-8 become
    replacement marks; a record that is no JSON object is an ordinary text.
    """
    text = F.decode("content", "utf-8") if files.schema["content"].dataType.simpleString() == "binary" else F.col("content")
    own = files.select(*also, "path", "kind", "project", "sid", "mtime", F.sha1(F.col("content").cast("binary")).alias("sha1"), F.octet_length("content").cast("long").alias("size"), text.alias("raw"))
    record = F.col("kind").isin(*RECORD_FIELDS)
    own = own.withColumn("clean", F.when(record, F.coalesce(redact_json(F.col("raw")), F.col("raw"))).otherwise(F.col("raw")))
    own = own.withColumn("v", F.when(record, F.try_parse_json("clean"))).withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    v = F.col("v")
    said = lambda f: F.nullif(F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")), F.lit(""))
    run = F.concat_ws("\n", said("workflowName"), said("summary"), _json(v, "$.result"), F.nullif(F.nullif(_json(v, "$.phases"), F.lit("[]")), F.lit("{}")))
    shown = F.when(v.isNotNull() & (F.col("kind") == "wf_run"), run).otherwise(F.col("clean"))
    return own.select(*also, "path", "kind", "project", "sid", "mtime", "sha1", "size", redact(shown).alias("text"), F.when(v.isNotNull(), _meta(F.col("kind"), v, F.col("path"))).otherwise("{}").alias("meta"))


def load_documents(files: DataFrame, shelf: Shelf, stream: str, batch: int, at: Column) -> None:
    """Bring both tables to the state of ``files``, a whole listing with contents.

    A document is loaded if its digest is new; what vanished is marked missing and
    keeps its text and search row; what came back unchanged loses the mark. A
    changed document's search row is replaced, or taken out if nothing of its text
    is searched. ``at`` is the time of the run. Digests are compared before any
    text is read or redacted.
    """
    stored = shelf.docs.read().select("path", F.col("sha1").alias("old_sha"), F.col("missing").alias("was_missing"), F.col("first_seen").alias("seen"))
    if not shelf.docs.done(stream, batch):
        # Contents are shuffled once, to the bucket in which they are written; digests alone tell what vanished or came back.
        sha = F.sha1(F.col("content").cast("binary"))
        beside = shelf.docs.placed(stored.select("path", "old_sha", "seen")).hint("shuffle_hash")
        new = shelf.docs.placed(files.where(F.col("content").isNotNull())).join(beside, [BUCKET, "path"], "left").where(~sha.eqNullSafe(F.col("old_sha")))
        fresh = read_documents(new, (BUCKET, "seen")).select("*", F.lit(0).alias("missing"), F.coalesce("seen", at).alias("first_seen"), at.alias("updated")).drop("seen")
        there = stored.join(files.select("path", sha.alias("now_sha")).where("now_sha is not null"), "path", "left")
        missing = F.when(F.col("now_sha").isNull() & (F.col("was_missing") == 0), 1).when((F.col("now_sha") == F.col("old_sha")) & (F.col("was_missing") == 1), 0)
        shelf.docs.merge(fresh, stream, batch, marks=there.select("path", missing.alias("missing")).where("missing is not null"))
    if not shelf.search.done(stream, batch):
        # What this batch loaded: the rows that carry its time.
        loaded = shelf.docs.read().where((F.col("updated") == at) & (F.col("missing") == 0))
        body = loaded.select(F.concat(F.lit("d:"), "path").alias("key"), document_body(F.col("kind"), F.col("text")).alias("body"), F.concat(F.lit("doc:"), "kind").alias("kind"), "project", F.col("mtime").alias("ts"), "sid")
        shown = F.coalesce(F.col("body") != "", F.lit(False))
        shelf.search.merge(body.where(shown), stream, batch, gone=body.where(~shown).select("key"))
