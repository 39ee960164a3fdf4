"""WARC archives of pages: written with revisits and segments, read back whole.

Records are made in tasks and written by Spark's text writer (any Hadoop file
system, committed once); the line separator is the pair of line ends that
closes a record. Long blocks are cut into continuation records. The reader
walks records by Content-Length, groups segments by their origin, orders them,
verifies the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

CHUNK_BYTES, SEGMENT_BYTES, LEAST_REVISIT_BYTES = 1 << 14, 1 << 15, 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_END = b"\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    out = [_HTTP]
    for i in range(0, len(payload), CHUNK_BYTES):
        part = payload[i : i + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(block: bytes) -> bytes:
    """The payload of an HTTP response in chunked framing."""
    i, out = block.index(_END) + 4, []
    while True:
        j = block.index(b"\r\n", i)
        n = int(block[i:j].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(block[j + 2 : j + 2 + n])
        i = j + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    origin = name()
    shared = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", safe), ("X-Page-Id", page_id)]
    whole = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record([("WARC-Type", kind), ("WARC-Record-ID", origin), *shared, *whole, profile, ("X-Refers-To-Page-Id", refers_to)], _HTTP)]  # no payload: it is the other record's
    block = chunked(payload)
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    if len(parts) == 1:
        return [_record([("WARC-Type", kind), ("WARC-Record-ID", origin), *shared, *whole], block)]
    out = [_record([("WARC-Type", kind), ("WARC-Record-ID", origin), *shared, *whole, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name()), *shared, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), total], part))
    return out


def mark_revisits(pages: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """``pages`` with payload_digest, record_type and refers_to.

    Of equal payloads of 100 bytes or more the smallest page_id is a response
    (rows that repeat it as well); the others revisit it. Rows without an id
    revisit if any other has one. Only payloads that occur twice are joined:
    broadcast up to ``broadcast_rows`` of them, else by a salted shuffle, so that
    a payload with a third of all pages fills no single task.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"))
    long = F.octet_length("html") >= LEAST_REVISIT_BYTES
    twice = known.where(long).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    twice = materialize(twice, "payloads")
    if twice.count() <= broadcast_rows:
        joined = known.join(F.broadcast(twice), "digest", "left")
    else:
        salts = 64
        salted = twice.select("digest", "least", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        joined = known.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["digest", "salt"], "left")
    first = F.col("least").isNull() | F.col("page_id").eqNullSafe(F.col("least")) | ~long
    return joined.select("page_id", "url", "html", "digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, path: str, records_per_file: int = 5_000) -> None:
    """Write one response or revisit for every row of pages (page_id, url, html)."""

    def run(batches):
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")), strict=True):
                page_id, url, html, digest, kind, refers_to = row
                yield pa.RecordBatch.from_arrays([pa.array(page_records(page_id, url, html.encode(), digest, kind, refers_to), pa.binary())], ["value"])

    made = mark_revisits(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(content: bytes):
    """(header fields, block) of every record in one archive's bytes."""
    i = 0
    while i < len(content):
        j = content.index(_END, i)
        head = content[i:j].decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {i}")
        fields = dict(line.split(": ", 1) for line in head[1:])
        n = int(fields["Content-Length"])
        yield fields, content[j + 4 : j + 4 + n]
        i = j + 4 + n + len(_END)


_PARSED = "origin string, segment int, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page in the archives: page_id, record_type, refers_to,
    payload_bytes, payload_digest and intact (lengths and digest verified).

    A revisit has the length and digest of the response that it refers to (same
    page and digest, read from the archives); without one it is not intact and
    they are null. So it is with a record whose segments lack a number or the
    stated total, or whose payload has another digest; segments without their
    first record are a row without a page. A file is read whole by
    one task; ``write`` bounds its records. Only the blocks of segmented records
    are shuffled, keyed by origin.
    """
    number = lambda x: None if x is None else int(x)
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _PARSED.split(", "))])

    def parse(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = []
                for f, block in records(gzip.decompress(content)):
                    kind, stated = f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    size, digest, segment = None, None, int(f.get("WARC-Segment-Number", 0))
                    if kind == "response" and not segment:
                        payload = dechunked(block)
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), segment, number(f.get("WARC-Segment-Total-Length")), number(f.get("X-Page-Id")), None if kind == "continuation" else kind, number(f.get("X-Refers-To-Page-Id")), size, digest, stated, block if segment else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = files.mapInArrow(parse, _PARSED)
    head = lambda c: F.max(F.when(F.col("record_type").isNotNull(), F.col(c))).alias(c)
    whole = parsed.groupBy("origin").agg(
        *(head(c) for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("segment", "block")))).alias("segments"),
    ).drop("origin")
    out = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("intact", pa.bool_())])

    def finish(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                size, digest, intact = r["payload_bytes"], r["payload_digest"], r["record_type"] is not None
                if r["record_type"] == "response" and r["segments"]:
                    block = b"".join(s["block"] for s in r["segments"])
                    intact = [s["segment"] for s in r["segments"]] == list(range(1, len(r["segments"]) + 1)) and len(block) == r["total"]
                    if intact:
                        payload = dechunked(block)
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                rows.append((r["page_id"], r["record_type"], r["refers_to"], size, digest, r["stated_digest"], intact and digest == r["stated_digest"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    rows = materialize(whole.mapInArrow(finish, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, stated_digest string, intact boolean"), "warc-rows")
    found = rows.where("record_type = 'response' and intact").select(F.col("page_id").alias("r_id"), F.col("stated_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).distinct()
    met = rows.join(found, (F.col("record_type") == "revisit") & F.col("refers_to").eqNullSafe(F.col("r_id")) & (F.col("stated_digest") == F.col("r_digest")), "left")
    seen = F.col("r_bytes").isNotNull()
    return met.select(
        "page_id", "record_type", "refers_to", F.coalesce("r_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("r_digest", "payload_digest").alias("payload_digest"), F.when(F.col("record_type") == "revisit", seen).otherwise(F.col("intact")).alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    Null html is an empty payload; very long html becomes many segments; repeated
    rows come back as often as they went in; other columns are ignored; an empty
    table gives an empty result.
    """
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
