from scrollmill.sources import transcripts
from scrollmill.streaming.ingest import Tables, ingest

TEXTS = {"a.jsonl": b'{"n":1}\n\n{"n":"\xc3\xa9"}\n' + b"x" * 50 + b"\n{}\ntail", "b.jsonl": b"one\n", "c.jsonl": b"", "d.jsonl": b"no end", "e.jsonl": b"\n\n\n", "s/f.jsonl": b"long " * 40 + b"\nshort\n"}


def whole(data):
    out, off = [], 0
    for part in data.split(b"\n")[:-1]:
        out.append((off, part.decode()))
        off += len(part) + 1
    return out


def write(folder, texts):
    for name, data in texts.items():
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)


def test_spans_of_any_size_give_each_line_once(tmp_path):
    write(tmp_path, TEXTS)
    for name, data in TEXTS.items():
        for start in sorted({0, *(off + len(raw.encode()) + 1 for off, raw in whole(data))}):
            want = [x for x in whole(data) if x[0] >= start]
            end = transcripts.complete_end(str(tmp_path / name), start, len(data))
            for size in (1, 2, 3, 7, 64, 1 << 20):
                cut = transcripts.spans(str(tmp_path), name, start, end, size)
                assert [(off, raw) for s in cut for _, off, raw in transcripts.lines(s)] == want
                assert len(cut) == -(-(end - start) // size)


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    write(tmp_path, TEXTS)
    transcripts.register(spark)
    read = spark.read.format("transcripts").option("spanBytes", 16).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, read.collect())) == sorted((n, off, raw) for n, data in TEXTS.items() for off, raw in whole(data))


def test_ingest_takes_each_line_of_a_split_file_once(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    lines = [b'{"type":"user","uuid":"u%d","sessionId":"s","message":{"content":"%s"}}\n' % (i, b"x" * (i * 7 % 90)) for i in range(40)]
    for n in (25, 40):
        (folder / "s.jsonl").write_bytes(b"".join(lines[:n]) + b'{"half')
        ingest(spark, str(folder), store, f"file://{tmp_path}/check", span_bytes=100)
        tables = Tables(spark, store)
        assert sorted(r.key for r in tables.events.read().collect()) == sorted(f"s:u{i}" for i in range(n))
        assert [r.n_lines for r in tables.files.read().collect()] == [n]
