"""Packing under a limit, bare commands, names of projects, late values."""

import pytest
from pyspark.sql import functions as F

from scrollmill.functions import display
from scrollmill.operators import history, names, rederive, resume, secrets
from scrollmill.streaming.store import Store


def packed(head, parts, limit):
    """The surveyed packing, plainly."""
    out, used, lost, gone = list(head), sum(len(x) + 1 for x in head), 0, []
    for title, lines in parts:
        mark = "\n## " + title
        if used + len(mark) + 1 + 120 > limit:
            gone.append(title)
            lost += len(lines)
            continue
        out.append(mark)
        used += len(mark) + 1
        fit = 0
        while fit < len(lines) and used + len(lines[fit]) + 1 + 120 <= limit:
            out.append(lines[fit])
            used += len(lines[fit]) + 1
            fit += 1
        if fit < len(lines):
            note = f"- (잘림: 이 절 {len(lines) - fit}줄 생략)"
            out.append(note)
            used += len(note) + 1
            lost += len(lines) - fit
    if lost or gone:
        out.append((f"\n_잘림: 상한 {limit}자 · 생략 {lost}줄" + (" · 빠진 절: " + ", ".join(gone) if gone else "") + "_")[:120])
    text = "\n".join(out)
    return text if len(text) <= limit else text[: limit - 12] + "\n_잘림_"


def test_packing_for_all_limits(spark):
    parts = [("마지막 요청", [f"line {i} " + "é😀" * (i % 7) for i in range(30)]), ("empty", []), ("긴 절 " + "x" * 150, ["y" * 90] * 3), ("short", ["z"]), ("day", [f"card {i}" for i in range(400)])]
    limits = [*range(200, 4001, 190), 60, 20000]
    heads = spark.createDataFrame([(n, ["# 이어하기", "두 줄"], n) for n in limits] + [(-1, ["alone"], 500)], "id long, head array<string>, most int")
    rows = [(n, p, title, i, x) for n in limits for p, (title, lines) in enumerate(parts) for i, x in enumerate(lines or [None])]
    lines = spark.createDataFrame(rows, "id long, part int, title string, line_no int, line string").repartition(5)
    got = {r.id: r.text for r in resume.assemble(heads, lines, F.col("most")).collect()}
    assert got == {**{n: packed(["# 이어하기", "두 줄"], parts, n) for n in limits}, -1: "alone"}
    assert all(len(got[n]) <= n for n in limits)


def test_latest_compaction_and_recent_cards(spark):
    sections = spark.createDataFrame([("a", 1, "x"), ("b", 2, "z"), ("b", 1, "y"), ("gone", 1, "q")], "ekey string, part int, body string")
    events = spark.createDataFrame([("a", "s", 2, "t"), ("b", "s", 3, "t"), ("c", "s", 9, "t"), ("a2", "r", 1, "t")], "key string, sid string, ts int, text string")
    got = resume.latest_compaction(sections, events).collect()
    assert [(r.sid, r.key, [tuple(x) for x in r.sections]) for r in got] == [("s", "b", [(1, "y"), (2, "z")])]
    cards = spark.createDataFrame([("p", f"k{i:02}", "odd" if i % 4 == 3 else "s", i) for i in range(12)], "project string, key string, sid string, ts int")
    got = resume.recent_cards(cards, spark.createDataFrame([("odd",)], "sid string")).orderBy("place").collect()
    assert [r.key for r in got] == ["k05", "k06", "k08", "k09", "k10"]


def test_bare_commands_pair_by_number(spark):
    h = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["/model", " /model ", "/model", "/model", "/cost", "/x y", "plain", None])] + [(9, "r", "/model")], "id int, sid string, text string")
    kinds = "sid string, type string, kind string, sub string, side boolean, text string"
    lines = spark.createDataFrame([
        ("s", "user", "command", None, False, "<command-name>model</command-name>"), ("s", "user", "meta", None, None, "/model"), ("s", "user", "human", None, True, "/model"),
        ("s", "system", "system", "local_command", None, "<command-name>/model</command-name> x"), ("s", "user", "slash", None, None, "/cost now"), ("s", "user", "command", None, None, "/cost"), ("s", "system", "system", "other", None, "/cost"),
    ], kinds)
    paired, left = history.pair_commands(h, lines)
    assert sorted(tuple(r) for r in paired.collect()) == [(0, "s", "/model", "slash_counted"), (1, "s", "/model", "slash_uncounted"), (2, "s", "/model", "slash_local_command"), (3, "s", "/model", "slash_no_line"), (4, "s", "/cost", "slash_counted"), (9, "r", "/model", "slash_no_line")]
    assert [tuple(r) for r in left.collect()] == [("s", "slash_counted", "/cost", 1)]


def test_names_of_projects(spark):
    projects = spark.createDataFrame([(p,) for p in ("-home-u-a", "-home-u-b", "-w-x", "-w-a", "a", None)], "project string")
    places = "project string, cwd string, ts timestamp"
    sessions = spark.createDataFrame([("-old", "/d", None), ("-new", "/d", None)], places).withColumn("ts", F.when(F.col("project") == "-new", F.lit("2025-01-02").cast("timestamp")).otherwise(F.lit("2025-01-01").cast("timestamp")))
    cards = spark.createDataFrame([("-card", "/c", None), ("-no", "/d", None)], places)
    asked = spark.createDataFrame([(n,) for n in ("a", "/d/", "/c", "/w.x", "b", "none", "", None, "-w-a")], "name string")
    got = {r.name: (r.project, r.level) for r in names.resolve(asked, projects, sessions, cards, lambda p: display.short_project(p, "-home-u")).collect()}
    assert got == {"a": ("a", "exact"), "/d/": ("-new", "session_folder"), "/c": ("-card", "card_folder"), "/w.x": ("-w-x", "made_of_folder"), "b": ("-home-u-b", "short_name"), "none": (None, None), "": (None, None), None: (None, None), "-w-a": ("-w-a", "exact")}
    twice = names.resolve(spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([("-home-u-x",), ("-home-u-x2",)], "project string"), sessions, cards, lambda p: F.lit("x"))
    assert twice.first().project is None


def test_late_values_rewrite_only_their_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), "key string, raw string, text string", ["key"], 16)
    value = "Kx7#Quatt9Zz!"
    rows = [(f"k{i}", f"row {i}", None) for i in range(40)] + [("hit", f"saw {value}", "x"), ("coded", "saw " + value.replace("#", "%23"), None), ("part", f"{value[:11]} cut", value), ("ctx", "clean", f"password={value}")]
    s.append(spark.createDataFrame(rows, "key string, raw string, text string"), "in", 0)
    learned = rederive.harvest_stored(s.read(), ["raw", "text"])
    assert [tuple(r) for r in learned.collect()] == [(value, "strong")]
    before = s.state()
    assert {r.key for r in rederive.retro(s, ["raw", "text"], learned, "retro", 0, dry_run=True).collect()} == {"hit", "coded", "part", "ctx"} and s.state() == before
    assert {r.key for r in rederive.retro(s, ["raw", "text"], learned, "retro", 0).collect()} == {"hit", "coded", "part", "ctx"}
    got = {r.key: (r.raw, r.text) for r in s.read().collect()}
    assert got["hit"] == ("saw [REDACTED:known]", "x") and got["part"] == ("[REDACTED:known_part] cut", "[REDACTED:known]") and got["k3"] == ("row 3", None) and len(got) == 44
    touched = sum(1 for b, p in s.state()["pieces"].items() if p != before["pieces"].get(b))
    assert 0 < touched <= 4 and rederive.retro(s, ["raw", "text"], learned, "retro", 1, dry_run=True).count() == 0


@pytest.mark.parametrize(("value", "found"), [("abcdefgh12", ["cdef", "gh"]), ("!!!!aa!!!!", []), ("short1", ["sho", "rt1"])])
def test_anchors(value, found):
    got = rederive.anchors(value)
    assert "".join(got) in value and bool(got) == bool(found)


def test_late_values_of_any_number_go_before_fragments(spark):
    """a stored whole value is not masked as a fragment of a longer one of another block."""
    value = "concat('Kx7#', id * 11, '$Quatt9Zz')"
    rows = spark.range(1, 300).selectExpr("cast(id as string) as key", f"concat('body ', {value}, ' end') as text", "if(id = 1, null, 'same') as other")
    learned = spark.range(1, 300).selectExpr(f"{value} as value", "'strong' as strength")
    got = rederive.changed_rows(rows, "key", ["text", "other"], learned, 20)
    assert got.columns == ["key", "text", "other"] and [r.text for r in got.collect()] == ["body [REDACTED:known] end"] * 299


def test_late_values_bring_no_keys_to_the_driver(spark, tmp_path, monkeypatch):
    """the changed rows' keys stay with the tasks, and tables of all values are not broadcast."""
    store = Store(spark, f"file://{tmp_path}/t", "k long, t string", ["k"], 2)
    value = "concat('Kx7#', lpad(id, 6, '0'), '$Quatt9Zz')"
    store.append(spark.range(3000).selectExpr("id as k", f"concat('a ', {value}) as t"), "in", 0)
    learned = spark.range(2500).selectExpr(f"{value} as value", "'strong' as strength")
    brought = []
    collect = type(learned).collect
    monkeypatch.setattr(type(learned), "collect", lambda df: brought.append(collect(df)) or brought[-1])
    keys = rederive.retro(store, ["t"], learned, "late", 0)
    assert max(map(len, brought)) <= 2001
    assert keys.count() == 2500 and rederive.retro(store, ["t"], learned, "late", 0).count() == 0
    assert store.read().where("t = 'a [REDACTED:known]'").count() == 2500
    known = secrets.prepared(learned.select("value"), 10)
    plan = known.met(spark.range(50).selectExpr("id as row", f"concat('a ', {value}) as t"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
