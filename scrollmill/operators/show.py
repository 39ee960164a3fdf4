"""One card, line or document as text, by any form of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display, extraction, zones

# How shown texts are worded.
CARD, DOCUMENT, NO_TEXT, NONE = "카드 ", "문서 ", "(본문 없음)", "(없음)"
BUNDLES = {"human": "사람 입력 카드", "auto": "자동 실행(claude -p)", "no_human": "사람 입력 없음(팀원 세션 등)"}
NOT_DELIVERED = "전달 안 된 대기열"
SHORT = r"^([0-9a-f]{8})/([0-9A-Za-z]{1,8})$"


def plain_key(asked: Column) -> Column:
    """A key without the brackets and words under which results show it."""
    key = F.trim(F.coalesce(asked, F.lit("")))
    key = F.when(key.rlike(r"^\[[\s\S]*\]$"), F.trim(F.expr("substring({0}, 2, length({0}) - 2)".format("trim(coalesce(asked, ''))")))).otherwise(key)
    told = lambda k, head, mark: F.when(k.startswith(head), F.concat(F.lit(mark), F.trim(F.substr(k, F.lit(len(head) + 1))))).otherwise(k)
    return told(told(key, CARD, "c:"), DOCUMENT, "d:")


def card_text(zone: str | None, home: str) -> Column:
    """A card (key, sid, project, start_ts, end_ts, dur_s, human, last_answer,
    n_tools, files, cmds, n_err, human_kind, delivered) as text."""
    bundle = display.bundle_of(F.col("human_kind"), F.col("delivered"))
    named = F.lit(NOT_DELIVERED)
    for kind, shown in BUNDLES.items():
        named = F.when(bundle == kind, shown).otherwise(named)
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NONE))
    line = F.format_string(
        "- 프로젝트 %s · 세션 %s · %s ~ %s · 소요 %s · 도구 %d · 에러 %d · %s", display.short_project(F.col("project"), home), F.col("sid"), zones.local_text(F.col("start_ts"), zone),
        zones.local_text_labelled(F.col("end_ts"), zone), display.duration(F.col("dur_s")), F.coalesce("n_tools", F.lit(0)), F.coalesce("n_err", F.lit(0)), named,
    )
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n\n## {title} "), F.size(c).cast("string"), F.lit("개\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), display.one_line(x, 300))), "\n"))).otherwise("")
    return F.concat(F.lit("# " + CARD), F.regexp_replace("key", "^c:", ""), F.lit("\n"), line, F.lit("\n\n## 사람 입력\n"), text("human"), F.lit("\n\n## 마지막 답\n"), text("last_answer"), listed("파일", F.col("files")), listed("명령", F.col("cmds")))


def event_text(zone: str | None, home: str) -> Column:
    """A line (key, kind, kind_sub, ts, project, sid, text, file_kind) as text."""
    kind = F.concat(F.col("kind"), F.coalesce(F.concat(F.lit("/"), F.nullif("kind_sub", F.lit(""))), F.lit("")))
    line = F.concat(F.lit("- 종류 "), kind, F.lit(" · "), F.coalesce(F.nullif(zones.local_text_labelled(F.col("ts"), zone), F.lit("")), F.lit("-")), F.lit(" · 프로젝트 "), display.short_project(F.col("project"), home), F.lit(" · 세션 "), F.coalesce("sid", F.lit("-")), F.lit(" · 원천 "), F.coalesce("file_kind", F.lit("-")))
    return F.concat(F.lit("# 행 "), F.col("key"), F.lit("\n"), line, F.lit("\n\n"), F.coalesce(F.nullif("text", F.lit("")), F.lit(NO_TEXT)))


def document_text(zone: str | None, home: str) -> Column:
    """A document (path, kind, project, updated, text) as text."""
    line = F.concat(F.lit("- 종류 "), F.col("kind"), F.lit(" · 프로젝트 "), display.short_project(F.col("project"), home), F.lit(" · 갱신 "), zones.local_text_labelled(F.col("updated"), zone))
    return F.concat(F.lit("# " + DOCUMENT), F.col("path"), F.lit("\n"), line, F.lit("\n\n"), F.coalesce(F.nullif("text", F.lit("")), F.lit(NO_TEXT)))


def show(asked: DataFrame, cards: DataFrame, events: DataFrame, files: DataFrame, docs: DataFrame, zone: str | None = None, home: str = "") -> DataFrame:
    """(asked, text) for every distinct key of ``asked`` (asked); null if nothing
    has it.

    A short key (eight characters of a session, the head of the last part) names
    one card or lists those it fits; else a card, a line, a document in this order,
    unless the key's mark says which. Lines get the kind of their file (fid, kind).
    All keys are looked up at once, by joins on the key.
    """
    keys = asked.select("asked").distinct().withColumn("key", plain_key(F.col("asked"))).where("key <> ''")
    short = keys.where(F.col("key").rlike(SHORT)).select("asked", "key", F.regexp_extract("key", SHORT, 1).alias("head"), F.regexp_extract("key", SHORT, 2).alias("tail"))
    near = cards.select(F.col("key").alias("card"), F.substring("key", 3, 8).alias("head"), F.element_at(F.split("key", ":"), -1).alias("last"))
    hits = short.join(near, "head").where(F.col("last").startswith(F.col("tail")))
    several = hits.groupBy("asked", "key").agg(F.sort_array(F.collect_list("card")).alias("cards"))
    listed = F.concat(F.lit("# 짧은 키가 카드 "), F.size("cards").cast("string"), F.lit("장에 걸린다: "), F.col("key"), F.lit("\n"), F.array_join(F.transform("cards", lambda c: F.concat(F.lit("- " + CARD), F.substr(c, F.lit(3)))), "\n"))
    many = several.where(F.size("cards") > 1).select("asked", F.lit(0).alias("rank"), listed.alias("text"))
    one = several.where(F.size("cards") == 1).select("asked", F.get("cards", F.lit(0)).alias("key"))
    rest = keys.join(short.select("asked"), "asked", "left_anti")
    as_card = one.unionByName(rest.where("key like 'c:%'")).unionByName(rest.where("key not like 'c:%' and key not like 'd:%'").withColumn("key", F.concat(F.lit("c:"), "key")))
    plain = rest.where("key not like 'c:%' and key not like 'd:%'")
    as_doc = rest.where("key like 'd:%'").withColumn("key", F.substr("key", F.lit(3))).unionByName(plain).withColumnRenamed("key", "path")
    lines = events.join(files.select("fid", F.col("kind").alias("file_kind")).dropDuplicates(["fid"]), "fid", "left")
    found = [
        many, as_card.join(cards, "key").select("asked", F.lit(1).alias("rank"), card_text(zone, home).alias("text")),
        plain.join(lines, "key").select("asked", F.lit(2).alias("rank"), event_text(zone, home).alias("text")), as_doc.join(docs, "path").select("asked", F.lit(3).alias("rank"), document_text(zone, home).alias("text")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy(F.col("asked").alias("own")).agg(F.min_by("text", F.struct("rank", "text")).alias("text"))
    return asked.select("asked").distinct().join(best, F.col("asked") == F.col("own"), "left").select("asked", "text")


def compact_sections(events: DataFrame) -> DataFrame:
    """(ekey, part, title, body, fmt) of the lines that sum a session up: rows of a
    table whose key is (ekey, part), to be merged with the lines."""
    own = events.where((F.col("kind") == "compact") & F.col("excluded").isNull()).select(F.col("key").alias("ekey"), F.explode(extraction.summary_sections(F.col("text"))).alias("s"))
    return own.select("ekey", F.col("s.n").alias("part"), "s.title", "s.body", "s.fmt")


def workflow_calls(uses: DataFrame, since: Column, until: Column) -> DataFrame:
    """(sid, ts, name) of the workflow calls (sid, ts, name, input) in [since,
    until): the workflow's name, else its script's without ending and run mark."""
    script = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.get_json_object("input", "$.scriptPath"), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "-wf_[0-9a-f][0-9a-f-]*$", "")
    name = F.trim(F.coalesce(F.nullif(F.get_json_object("input", "$.workflow_name"), F.lit("")), script))
    own = uses.where((F.col("name") == "Workflow") & (F.col("ts") >= since) & (F.col("ts") < until))
    return own.select("sid", "ts", name.alias("name")).where("name <> ''")


# Words and heads of objects that stand where a value would.
NOT_VALUES = "true false null none nil str string int bool boolean required optional undefined number object any unknown void password secret token string; str, input hidden text prompt masked redacted empty missing notset unset".split()
OBJECTS = "os self env process config settings args req request opts options cfg conf params".split()


def literal_value(v: Column, rule: Column) -> Column:
    """Whether what stands in a secret's place is written out: no mark of masking,
    no variable, path, word of a type or field of an object, and no user id."""
    told = (F.coalesce(v, F.lit("")) == "") | v.rlike(r"^\[(?:REDAC|redac)") | v.rlike(r"^[$%{<(\[/~.`*…·-]") | F.lower(v).isin(NOT_VALUES) | v.rlike(rf"^(?:{'|'.join(OBJECTS)})\.")
    return ~(told | F.coalesce((rule == "curl_u") & v.rlike(r"^[0-9]+[.,;:)]*$"), F.lit(False)))
