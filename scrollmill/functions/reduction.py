"""Copies, images and signatures taken out of a line, each removal counted.

A line is rebuilt as JSON, so one Arrow-batched function walks it; lines without
any of the fields in question never reach it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that repeat others, and the longest text kept of a result's copy.
COPIES = ["wireToolInputs", "rendered", "serverClassifierRequest", "serverClassifierContext", "wireIngestContext"]
LONGEST = 300
_STRIP = T.StructType([T.StructField("reason", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bytes", T.LongType())])
RESULT = T.StructType([T.StructField("raw", T.StringType()), T.StructField("strips", T.ArrayType(_STRIP))])
_WORTH = "|".join([*COPIES, "toolUseResult", "iterations", "base64", '"image"', "signature", "redacted_thinking", "invoked_skills"])


def _size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False))


def _reduced(raw: str) -> tuple[str, list[tuple[str, int, int]]]:
    try:
        line = json.loads(raw)
    except ValueError:
        return raw, []
    if not isinstance(line, dict):
        return raw, []
    taken: dict[str, list[int]] = {}

    def count(reason: str, size: int) -> None:
        n = taken.setdefault(reason, [0, 0])
        n[0], n[1] = n[0] + 1, n[1] + size

    def without_data(block: dict) -> None:
        source = block.get("source") if isinstance(block.get("source"), dict) else {}
        data = source.get("data")
        if isinstance(data, str) and data:
            count("image_base64", len(data))
            source["data"] = f"[이미지 생략 base64 {len(data)}바이트 {source.get('media_type') or '?'}]"

    def lighter(block):
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "image":
            without_data(block)
        elif kind == "tool_result" and isinstance(block.get("content"), list):
            for inner in (x for x in block["content"] if isinstance(x, dict) and x.get("type") == "image"):
                without_data(inner)
        elif kind in ("thinking", "redacted_thinking"):
            field = "signature" if kind == "thinking" else "data"
            if isinstance(block.get(field), str) and block[field]:
                count("thinking_signature", len(block.pop(field)))
                return block if kind == "thinking" else {"type": kind}
        return block

    for name in COPIES:
        if name in line:
            count(f"dup:{name}", _size(line.pop(name)))
    result = line.get("toolUseResult")
    if isinstance(result, dict):
        small = {k: v for k, v in result.items() if v is None or isinstance(v, (bool, int, float)) or (isinstance(v, str) and len(v) <= LONGEST)}
        if (gone := _size(result) - _size(small)) > 0:
            count("toolUseResult_copy", gone)
        line["toolUseResult"] = small
    elif result is not None:
        if _size(result) > 2:
            count("toolUseResult_copy", _size(result))
        line["toolUseResult"] = {"_dropped": type(result).__name__}
    message = line.get("message")
    if isinstance(message, dict):
        if isinstance(message.get("content"), list):
            message["content"] = [lighter(b) for b in message["content"]]
        if isinstance(message.get("usage"), dict) and "iterations" in message["usage"]:
            count("dup:usage.iterations", _size(message["usage"].pop("iterations")))
    attached = line.get("attachment")
    if line.get("type") == "attachment" and isinstance(attached, dict) and attached.get("type") == "invoked_skills" and isinstance(attached.get("skills"), list):
        for skill in (s for s in attached["skills"] if isinstance(s, dict) and "content" in s):
            if isinstance(body := skill.pop("content"), str):
                count("skill_body", len(body))
        attached["skills"] = [s for s in attached["skills"] if isinstance(s, dict)]
    return json.dumps(line, ensure_ascii=False), [(k, *v) for k, v in sorted(taken.items())]


@F.pandas_udf(RESULT)
def _reduce(raw: pd.Series) -> pd.DataFrame:
    made = [(None, []) if x is None else _reduced(x) for x in raw]
    return pd.DataFrame({"raw": [m[0] for m in made], "strips": [[dict(zip(("reason", "n", "bytes"), s, strict=True)) for s in m[1]] for m in made]})


def reduce_line(raw: Column) -> Column:
    """struct<raw, strips array<struct<reason, n, bytes>>>: the line without what
    repeats other fields, and what was taken. Broken lines stay. Null: null raw."""
    worth = F.when(raw.rlike(_WORTH), raw)
    done = _reduce(worth)
    none = F.expr("cast(array() as array<struct<reason:string,n:bigint,bytes:bigint>>)")
    return F.struct(F.coalesce(done["raw"], raw).alias("raw"), F.coalesce(done["strips"], none).alias("strips"))
