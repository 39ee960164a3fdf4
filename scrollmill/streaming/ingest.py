"""Incremental ingest: lines of both transcript dialects to keyed tables.

A batch changes three tables in this order, each of them once: the events, the
counters of left-out lines, and the files with the state in which they stopped. A
batch that runs again after a crash finds the tables that lack it as they were.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content, rollout
from ..functions.lines import classify_line
from ..functions.policy import line_policy
from ..functions.redaction import redact_json
from ..functions.reduction import reduce_line
from ..functions.text import file_id, source_of
from ..operators.ordered import first_by, multiset_new
from ..sources.transcripts import SPAN_BYTES, register
from .store import Store

#: Usage counters of an assistant message.
USAGE = {"u_in": "input_tokens", "u_out": "output_tokens", "u_cc": "cache_creation_input_tokens", "u_cr": "cache_read_input_tokens"}


def events(lines: DataFrame) -> DataFrame:
    """One row per line (path, off, raw): parsed, judged, redacted.

    Blank, broken and non-object lines are kept as rows with a reason, so that
    lines read always equal lines stored plus lines left out.
    """
    get = lambda p: F.get_json_object("raw", p)
    bad = F.when(F.trim("raw") == "", "blank").when(F.try_parse_json("raw").isNull(), "bad_json").when(~F.ltrim("raw").startswith("{"), "not_object")
    policy = line_policy(get("$.type"), F.coalesce(get("$.subtype"), F.lit("")), F.coalesce(get("$.attachment.type"), F.lit("")))
    sid, uuid = F.coalesce(get("$.sessionId"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)), get("$.uuid")
    key = F.when(uuid.isNotNull(), F.concat(sid, F.lit(":"), uuid)).otherwise(F.concat(sid, F.lit(":o:"), file_id(F.col("path")), F.lit(":"), F.col("off"), F.lit(":"), F.substring(F.sha1(F.col("raw").cast("binary")), 1, 8)))
    made = lines.select(
        key.alias("key"), uuid.alias("uuid"), sid.alias("sid"), file_id(F.col("path")).alias("fid"), "path", "off", get("$.type").alias("type"), get("$.subtype").alias("sub"),
        F.try_to_timestamp(get("$.timestamp")).alias("ts"), get("$.message.id").alias("msg_id"), get("$.message.model").alias("model"),
        *(get(f"$.message.usage.{p}").cast("long").alias(c) for c, p in USAGE.items()), F.when(bad.isNull(), redact_json(F.col("raw"))).otherwise(F.col("raw")).alias("raw"), F.sha1(F.col("raw").cast("binary")).alias("lsha"),
        F.coalesce(bad, F.when(~policy["keep"], policy["reason"])).alias("excluded"), F.when(bad.isNull() & policy["keep"], policy["reason"]).alias("unknown"),
    )
    # What a line is called is judged after redaction, once for each line.
    light = made.withColumn("light", reduce_line(F.when(F.col("excluded").isNull(), F.col("raw"))))
    light = light.withColumn("raw", F.coalesce("light.raw", "raw")).withColumn("strips", F.col("light.strips")).drop("light")
    judged = light.withColumn("v", F.when(F.col("excluded").isNull(), F.try_parse_json("raw"))).withColumn("k", classify_line(F.col("v")))
    strange, stored = F.col("unknown").isNotNull(), F.col("excluded").isNull()
    named = F.regexp_replace("unknown", "^unknown_", "")
    kind = F.when(stored, F.when(strange, "unknown").otherwise(F.col("k.kind")))
    called = judged.withColumn("kind", kind).withColumn("kind_sub", F.when(stored, F.when(strange, named).otherwise(F.col("k.sub"))))
    own = F.when(stored & (F.col("type") == "assistant"), content.tool_uses(F.col("v")))
    given = F.when(stored & (F.col("kind") == "tool_result"), content.tool_results(F.col("v")))
    return called.select(
        *light.columns, "kind", "kind_sub", F.when(stored, content.line_text(F.col("v"), F.col("kind"))).alias("text"),
        own.alias("tool_uses"), given.alias("tool_results"),
    )


def _shaped(blocks: Column) -> Column:
    """A line's blocks as the content of a message of the first dialect."""
    block = lambda b: F.struct(
        b["type"].alias("type"), F.when(b["type"] != "tool_result", b["text"]).alias("text"), F.when(b["type"] == "tool_use", b["id"]).alias("id"), b["name"].alias("name"),
        F.try_parse_json(b["input"]).alias("input"), F.when(b["type"] == "tool_result", b["id"]).alias("tool_use_id"), b["is_error"].alias("is_error"),
        F.when(b["type"] == "tool_result", b["text"]).alias("content"),
    )
    return F.try_parse_json(F.to_json(F.struct(F.struct(F.transform(blocks, block).alias("content")).alias("message"))))


def rollout_events(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Lines of the second dialect as rows of the same table, redacted before
    they are read. ``before`` holds the state of files that go on."""
    raw = lines.select("path", "off", F.sha1(F.col("raw").cast("binary")).alias("lsha"), F.coalesce(redact_json(F.col("raw")), F.col("raw")).alias("raw"))
    made = rollout.normalised(raw, before, ("raw", "lsha")).withColumnRenamed("sub", "kind_sub").withColumnRenamed("reason", "excluded")
    named = F.coalesce("sid", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))
    key = F.concat(named, F.lit(":o:"), file_id(F.col("path")), F.lit(":"), F.col("off"), F.lit(":"), F.substring("lsha", 1, 8))
    kind = F.when(F.col("kind").isin("human", "sdk", "interrupt", "tool_result", "compact"), "user").otherwise(F.col("kind"))
    stored = F.col("excluded").isNull()
    own = made.withColumn("v", F.when(stored, _shaped(F.col("blocks"))))
    return own.select(
        key.alias("key"), named.alias("sid"), file_id(F.col("path")).alias("fid"), "path", "off", F.when(stored, kind).alias("type"), "ts", "msg_id", "model", "raw", "lsha", "excluded",
        "kind", "kind_sub", F.when(stored, F.coalesce("text", F.lit(""))).alias("text"), F.when(stored & (F.col("kind") == "assistant"), content.tool_uses(F.col("v"))).alias("tool_uses"),
        F.when(stored & (F.col("kind") == "tool_result"), content.tool_results(F.col("v"))).alias("tool_results"), "cwd", "version", "auto", F.col("state_model"),
    )


LINES = "path string, off long, raw string"
FILES = "path string, fid string, off long, n_lines long, n_bad long, resets int, sid string, cwd string, version string, model string, auto boolean"
COUNTERS = "fid string, reason string, has_uuid boolean, n long, bytes long"


@lru_cache(maxsize=1)
def _schema() -> T.StructType:
    """The columns of both dialects' rows, planned once a process."""
    none = SparkSession.active().createDataFrame([], LINES)
    return events(none).unionByName(rollout_events(none), allowMissingColumns=True).schema


class Tables:
    """The tables of one ingest, side by side: events, files and counters."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.read_schema = spark, _schema()
        self.events = Store(spark, path, T.StructType([f for f in self.read_schema if f.name != "state_model"]), ["key"], buckets)
        self.files = Store(spark, f"{path}-files", FILES, ["path"], buckets)
        self.counters = Store(spark, f"{path}-counters", COUNTERS, ["fid", "reason", "has_uuid"], buckets)


def ingest_batch(lines: DataFrame, tables: Tables, stream: str, batch: int) -> None:
    """Take one batch of lines (path, off, raw) in.

    A file whose lines start at 0 again was replaced: of its lines without an id
    only those beyond the stored number of equal ones are new, its counters start
    anew, and no state is carried over. Else the first writer of a key wins, and a
    file of the second dialect goes on in the state in which it stopped.
    """
    if tables.files.done(stream, batch):
        return
    met = lines.groupBy("path").agg(F.min("off").alias("first_off"))
    known = met.join(tables.files.read(), "path", "left")
    goes_on, again = (F.col("first_off") > 0), F.coalesce((F.col("first_off") == 0) & (F.col("off") > 0), F.lit(False))
    second = source_of(F.col("path")) == "codex"
    before = known.where(goes_on & F.col("fid").isNotNull()).select("path", *rollout.STATE)
    # Parsed, judged and redacted once; the three tables are made of what is written here.
    staged = f"{tables.events.path}/_staging/batch"
    dialects = {r[0] for r in met.select(second).distinct().collect()}
    own = {False: lambda: events(lines.where(~second)), True: lambda: rollout_events(lines.where(second), before)}
    for i, dialect in enumerate(sorted(dialects)):
        own[dialect]().write.mode("append" if i else "overwrite").parquet(staged)
    read = tables.spark.read.schema(tables.read_schema).parquet(staged) if dialects else tables.spark.createDataFrame([], tables.read_schema)

    replaced = known.where(again).select("fid")
    if not tables.events.done(stream, batch):
        whole, loose = read.where("uuid is not null"), read.where("uuid is null")
        stored = tables.events.read().where("uuid is null").join(replaced, "fid", "left_semi")
        afresh = multiset_new(loose.join(replaced, "fid", "left_semi"), stored, ["fid", "lsha"], ["off"])
        new = whole.unionByName(loose.join(replaced, "fid", "left_anti")).unionByName(afresh.select(*loose.columns))
        tables.events.append(first_by(new, ["key"], ["path", "off"]), stream, batch)

    if not tables.counters.done(stream, batch):
        left_out = read.where("excluded is not null").groupBy("fid", F.col("excluded").alias("reason"), F.col("uuid").isNotNull().alias("has_uuid"))
        now = left_out.agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).cast("long").alias("bytes"))
        old = tables.counters.read()
        ended = old.join(replaced, "fid", "left_semi")
        sums = now.unionByName(old.join(replaced, "fid", "left_anti").join(now.select(*tables.counters.keys), tables.counters.keys, "left_semi"))
        tables.counters.merge(sums.groupBy(*tables.counters.keys).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), stream, batch, gone=ended)

    ends = lines.groupBy("path").agg(F.max(F.col("off") + F.octet_length("raw") + 1).alias("end"), F.count("*").alias("lines"))
    last = {c: F.max_by(F.col("state_model" if c == "model" else c), "off").alias(f"last_{c}") for c in rollout.STATE}
    state = read.groupBy("path").agg(F.count_if(F.col("excluded").isin("blank", "bad_json", "not_object")).alias("bad"), *last.values())
    held = known.join(ends, "path").join(state, "path")
    of = lambda c: F.when(~again, F.coalesce(c, F.lit(0))).otherwise(0)
    tables.files.merge(held.select(
        "path", file_id(F.col("path")).alias("fid"), F.col("end").alias("off"), (of("n_lines") + F.col("lines")).alias("n_lines"), (of("n_bad") + F.col("bad")).alias("n_bad"),
        (F.coalesce("resets", F.lit(0)) + again.cast("int")).alias("resets"), *(F.col(f"last_{c}").alias(c) for c in rollout.STATE),
    ), stream, batch)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, span_bytes: int = SPAN_BYTES) -> None:
    """Read what is new in ``folder`` into the tables at ``store``.

    Run it again after a crash and nothing is lost or doubled. A file is read in
    tasks of ``span_bytes`` each.
    """
    register(spark)
    tables = Tables(spark, store)

    def batch(df: DataFrame, number: int) -> None:
        ingest_batch(df, tables, checkpoint, number)
        tables.events.compact()

    spark.readStream.format("transcripts").option("spanBytes", span_bytes).load(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
