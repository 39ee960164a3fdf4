"""Append-only JSONL transcripts as a Spark data source, batch and streaming.

``spark.read.format("transcripts").load(folder)`` yields (path, off, raw): every
newline-terminated line with its byte offset; an unfinished last line waits. The
stream's offset holds, for each file, the bytes read, its inode and a digest of
its head, so an appended file resumes and a replaced or shrunk one starts anew.
A large file is read by several tasks, ``spanBytes`` (128 MB unless given) each.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, off long, raw string"
HEAD_BYTES, READ_BYTES, SPAN_BYTES = 1 << 16, 1 << 24, 1 << 27


def listing(folder: str) -> dict[str, dict]:
    """The folder's .jsonl files, symbolic links left out."""
    found = {}
    for top, dirs, names in os.walk(folder):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for name in names:
            path = os.path.join(top, name)
            if name.endswith(".jsonl") and not os.path.islink(path):
                st = os.stat(path)
                found[os.path.relpath(path, folder)] = {"size": st.st_size, "inode": st.st_ino}
    return found


def head_digest(path: str, n: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha1(f.read(min(n, HEAD_BYTES))).hexdigest()


def complete_end(path: str, start: int, size: int) -> int:
    """The offset after the last newline in [start, size)."""
    with open(path, "rb") as f:
        end = size
        while end > start:
            begin = max(start, end - READ_BYTES)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class Span(InputPartition):
    """The lines of a file that begin in [start, end); ``base`` begins one."""

    def __init__(self, folder: str, path: str, base: int, start: int, end: int):
        self.folder, self.path, self.base, self.start, self.end = folder, path, base, start, end


def spans(folder: str, path: str, start: int, end: int, size: int) -> list[Span]:
    """Whole lines of [start, end) in tasks of about ``size`` bytes each."""
    return [Span(folder, path, start, at, min(at + size, end)) for at in range(start, end, size)]


def lines(span: Span):
    with open(os.path.join(span.folder, span.path), "rb") as f:
        off = span.start
        if off > span.base:
            # The line that holds the byte before belongs to the span before.
            f.seek(off - 1)
            off += len(f.readline()) - 1
        else:
            f.seek(off)
        while off < span.end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield span.path, off, raw[:-1].decode("utf-8", "replace")
            off += len(raw)


class BatchReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self):
        ends = {p: complete_end(os.path.join(self.folder, p), 0, x["size"]) for p, x in sorted(listing(self.folder).items())}
        return [s for p, end in ends.items() for s in spans(self.folder, p, 0, end, self.size)] or [Span(self.folder, "", 0, 0, 0)]

    def read(self, partition):
        return lines(partition) if partition.path else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.last = folder, size, {}

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        files = {}
        for p, x in listing(self.folder).items():
            full, old = os.path.join(self.folder, p), self.last.get(p)
            kept = old and old["inode"] == x["inode"] and x["size"] >= old["off"] and head_digest(full, old["head"]) == old["sha1"]
            off = complete_end(full, old["off"] if kept else 0, x["size"])
            head = min(off, HEAD_BYTES)
            files[p] = {"off": off, "inode": x["inode"], "head": head, "sha1": head_digest(full, head)}
        self.last = files
        return {"files": json.dumps(files, sort_keys=True)}

    def partitions(self, start, end):
        before, after, out = json.loads(start["files"]), json.loads(end["files"]), []
        for p, x in sorted(after.items()):
            old = before.get(p)
            same = old and old["inode"] == x["inode"] and x["off"] >= old["off"] and head_digest(os.path.join(self.folder, p), old["head"]) == old["sha1"]
            begin = old["off"] if same else 0
            out += spans(self.folder, p, begin, x["off"], self.size)
        return out

    def read(self, partition):
        return lines(partition)

    def commit(self, end):
        pass


class TranscriptSource(DataSource):
    @classmethod
    def name(cls):
        return "transcripts"

    def schema(self):
        return SCHEMA

    def _size(self) -> int:
        return max(1, int(self.options.get("spanBytes", SPAN_BYTES)))

    def reader(self, schema):
        return BatchReader(self.options["path"], self._size())

    def streamReader(self, schema):
        return StreamReader(self.options["path"], self._size())


def register(spark) -> None:
    spark.dataSource.register(TranscriptSource)
