"""Code problems and influence by hand-worked scores."""

import math

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import problems as p

CTX = "run_set string, screen string, flow string, step string, "


def sat(v, pivot):
    return min(8.0, math.log1p(v) / math.log1p(pivot) * 3) if v else 0.0


@pytest.fixture(scope="module")
def inputs(spark):
    at = ("c", "Feed", "open", "s1")
    windows = [(*at, "x.Main.load", "main_thread_stall", 2, 3, 9000, 8000), (*at, "x.Main.load", "ui_jank", 4, 19, 4000, 90), (*at, "x.Net.get", "http_slow_or_failed", 1, 1, 800, 700), (*at, "x.Main.load", "retained_object", 1, 50, 0, 99999),
               (*at, "x.Main.load", "log_spam", 1, 50, 0, 0), ("c", "unknown", "", "s2", "x.Gc.run", "gc_pressure", 1, 4, 10, 5), (*at, "unknown", "ui_jank", 1, 1, 1, 1)]
    leaks = [(*at, "x.Row", "x.Holder", 3, 60000, 5000, "time_only", "medium", 12.5), (*at, "x.Row", "unknown", 1, 10, 100, "confirmed_path", "high", 20.0)]
    spam = [(*at, "x.Log.write", "Net", 3, 999), (*at, "x.Log.write", "Db", 3, 1)]
    calls = [(*at, "x.Main.load", "x.Db.read", 10, 4000, 700), (*at, "x.Db.read", "x.Db.open", 5, 10, 3), ("c", "List", "scroll", "s1", "x.Main.load", "x.Db.read", 1, 100, 100)]
    make = lambda rows, schema: spark.createDataFrame(rows, CTX + schema)
    return {"windows": make(windows, "owner string, kind string, windows bigint, count bigint, window_ms bigint, max_ms bigint"),
            "leaks": make(leaks, "class string, holder string, count bigint, max_age_ms bigint, retained_kb bigint, evidence string, severity string, score double"),
            "spam": make(spam, "owner string, log_source string, level int, count bigint"), "calls": make(calls, "caller string, callee string, count bigint, total_ms bigint, max_ms bigint")}


def test_registry(inputs):
    got = {(r["class"], r["method"]): r for r in p.registry(p.signals(**inputs)).collect()}
    assert set(got) == {("x.Main", "load"), ("x.Net", "get"), ("x.Gc", "run"), ("x.Holder", ""), ("x.Row", ""), ("x.Log", "write"), ("x.Db", "read"), ("x.Db", "open")}
    main = got["x.Main", "load"]
    stall, jank = sat(3, 8) + sat(8000, 500), sat(19, 8) + sat(90, 500)
    started = 0.45 * (sat(10, 160) + sat(4000, 2200) + sat(700, 500) + sat(1, 160) + sat(100, 2200) + sat(100, 500))
    assert main["score"] == round(stall + jank + started, 1) and main["severity"] == "high"
    assert main["categories"] == "anr_risk|main_thread|runtime|ui" and main["problems"] == "call_initiator|main_thread_stall|ui_jank"
    assert (main["problem_count"], main["calls"], main["call_ms"], main["max_ms"], main["screens"], main["flows"]) == (22, 11, 4100, 8000, "Feed|List", "open|scroll")
    assert (got["x.Gc", "run"]["categories"], got["x.Gc", "run"]["severity"], got["x.Gc", "run"]["screens"]) == ("gc_pressure|oom_risk|runtime", "medium", "")
    assert (got["x.Holder", ""]["categories"], got["x.Holder", ""]["score"], got["x.Holder", ""]["severity"], got["x.Holder", ""]["memory_kb"]) == ("lifecycle_leak|memory|oom_risk", 12.5, "medium", 5000)
    assert (got["x.Row", ""]["categories"], got["x.Row", ""]["severity"], got["x.Row", ""]["problems"]) == ("lifecycle_leak|memory", "high", "confirmed_retention_path")
    assert got["x.Log", "write"]["severity"] == "medium" and got["x.Log", "write"]["score"] == round(sat(999, 160) + sat(1, 160), 1)
    assert got["x.Net", "get"]["severity"] == "medium" and got["x.Db", "open"]["severity"] == "ok"  # 700 ms is medium; nothing of note
    assert [r["rank"] for r in p.registry(p.signals(**inputs), 3).collect()] == [1, 2, 3]


def test_merged_signals_take_the_worst(inputs):
    got = {(r["class"], r["name"]): r for r in p.merged_signals(p.signals(**inputs)).collect()}
    assert (got["x.Log", "log_spam"]["severity"], got["x.Log", "log_spam"]["count"]) == ("medium", 1000)
    assert (got["x.Main", "main_thread_stall"]["severity"], got["x.Main", "ui_jank"]["severity"]) == ("high", "ok")


def test_influence(spark, inputs):
    static = spark.createDataFrame([("c", "x.Main", "x.Net", 4), ("c", "x.Net", "x.Disk", 2), ("c", "x.Disk", "x.Deep", 1)], "run_set string, from_class string, to_class string, count bigint")
    nodes = p.influence(**inputs, static=static)
    got = {r["class"]: r for r in nodes.collect()}
    main = sat(3, 8) + sat(8000, 500) + sat(19, 8) + sat(90, 500) + 0.45 * (sat(10, 220) + sat(1, 220)) + 0.35 * 4
    assert abs(got["x.Main"]["raw"] - main) < 1e-9 and (got["x.Main"]["contexts"], got["x.Main"]["main_ms"], got["x.Main"]["runtime_ms"]) == (4, 9000, 1025)
    db = sat(10, 160) + sat(4000, 2200) + sat(700, 500) + sat(1, 160) + sat(100, 2200) + sat(100, 500) + 0.35 * 4
    assert abs(got["x.Db"]["raw"] - db) < 1e-9  # the call inside the class counts for nothing
    assert abs(got["x.Holder"]["raw"] - (12.5 * 0.45 + 0.7)) < 1e-9 and abs(got["x.Gc"]["raw"] - (sat(4, 8) + sat(5, 500))) < 1e-9
    assert (got["x.Disk"]["status"], got["x.Disk"]["score"], got["x.Disk"]["severity"], got["x.Main"]["status"]) == ("static_only", 0.0, "ok", "runtime")
    one = spark.createDataFrame([("c", "x.Db")], "run_set string, class string")
    edges = {(r["from_class"], r["to_class"]): r for r in p.influence_edges(static, inputs["calls"], nodes, one).collect()}
    assert set(edges) == {("x.Main", "x.Net"), ("x.Main", "x.Db")}  # into a class with symptoms, and the call at the selected one
    assert edges["x.Main", "x.Db"]["influence"] == 11 + 4100 / 25 + 800 / 5 and edges["x.Main", "x.Db"]["reason"] == "called_in_run"
    assert edges["x.Main", "x.Net"]["influence"] == round(4 * max(got["x.Net"]["raw"], 0.35 * got["x.Main"]["raw"]), 4) and edges["x.Main", "x.Net"]["reason"] == "calls_symptoms"
    shown = p.shown_nodes(nodes, p.influence_edges(static, inputs["calls"], nodes, p.top_nodes(nodes, 2))).orderBy("place").collect()
    assert [r["class"] for r in shown][:2] == [r["class"] for r in p.top_nodes(nodes, 2).orderBy("rank").collect()] and len({r["class"] for r in shown}) == len(shown)


def test_hotspots(spark, inputs):
    methods = spark.createDataFrame([("c", "x.Main", "load", "x.Db", "read", 11), ("c", "x.A", "go", "x.B", "do", 9), ("c", "x.Main", "", "x.B", "do", 1)], "run_set string, from_class string, from_method string, to_class string, to_method string, count bigint")
    nodes = p.influence(**inputs)
    raw = {r["class"]: r["raw"] for r in nodes.collect()}
    got = [(r["class"], r["method"], r["role"], r["calls"], r["heat"]) for r in p.method_hotspots(methods, nodes).orderBy(F.desc("heat"), "class").collect()]
    assert sorted(got) == sorted([("x.Main", "load", "caller", 11, round(math.log1p(11) * (1 + raw["x.Main"]), 1)), ("x.Db", "read", "callee", 11, round(math.log1p(11) * (1 + raw["x.Db"]), 1)), ("x.B", "do", "callee", 1, round(math.log1p(1), 1))])
