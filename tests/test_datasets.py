"""Problem datasets written and read again, scans of diagnostics and thresholds, exported events, snapshots."""

import json

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut
from fleetpulse.operators import compare, resolve, sidedata
from fleetpulse.operators import problems as prob
from fleetpulse.plans import evidence_queries as ev
from fleetpulse.sources import datasets, scans
from fleetpulse.streaming.incremental import follow_snapshots, snapshot_table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    reg = prob.registry(ev.signals(spark, DIR))
    nodes, edges = ev.graph(spark, DIR)
    h = ev.src.of_type(spark, DIR, "http").select("run_set", F.regexp_extract("owner", "^(.*)[.]", 1).alias("class"), F.lit("run").alias("method"), "flow", "screen", "step", "route")
    sections = spark.createDataFrame([("integrals", "high", 2, 'a "quoted", name\nof two lines')], "section string, status string, findings bigint, top string")
    out = {"code-problems": datasets.code_problem_table(reg, sidedata.drill_down(h), sidedata.impacts(reg)), "leaks": datasets.leak_table(ev.leaks(spark, DIR)),
            "influence": datasets.influence_table(prob.top_nodes(nodes), edges, prob.method_hotspots(sidedata.method_graph(ev.src.calls(spark, DIR)), nodes)), "math-findings": datasets.finding_table(sections)}
    return {name: cut(df, "dataset") for name, df in out.items()}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["csv", "json"])
@pytest.mark.parametrize("name", list(datasets.HEADERS))
def test_datasets_come_back(spark, tables, tmp_path, name, kind):
    df = tables[name].repartition(3)
    assert df.columns == datasets.HEADERS[name]
    want = rows(df)
    assert want
    datasets.write_dataset(df, str(tmp_path / "d"), kind)
    back = datasets.read_dataset(spark, str(tmp_path / "d"))
    assert back.columns == df.columns and rows(back) == want
    datasets.write_dataset(df.limit(1), str(tmp_path / "d"), kind, "append")
    assert datasets.read_dataset(spark, str(tmp_path / "d")).count() == len(want) + 1
    datasets.write_dataset(df, str(tmp_path / "d"), kind)
    assert rows(datasets.read_dataset(spark, f"file://{tmp_path}/d", ", ".join(f"`{c}` string" for c in df.columns))) == want
    assert not [p for p in (tmp_path / "d").iterdir() if p.name.startswith("_") and p.name != datasets.MANIFEST]


def test_nested_rows(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, array('x', 'y') AS l, named_struct('p', true, 'q', named_struct('r', cast(null as int))) AS s, array(named_struct('flow', 'f', 'a', 9), named_struct('flow', 'g', 'a', 8)) AS drill_down")
    datasets.write_dataset(df.drop("drill_down"), str(tmp_path / "c"))
    assert [r.asDict() for r in datasets.read_dataset(spark, str(tmp_path / "c")).collect()] == [{"a": "1", "l": "x | y", "s.p": "true", "s.q.r": ""}]
    datasets.write_dataset(df, str(tmp_path / "j"), "json")
    assert [r.asDict() for r in datasets.read_dataset(spark, str(tmp_path / "j")).collect()] == [{"a": a, "l": "x | y", "s.p": "true", "s.q.r": "", "flow": f} for f, a in (("f", "9"), ("g", "8"))]


def test_foreign_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"top_nodes": [{"class": "A", "n": {"m": 1}}], "top_edges": [{"from": "A", "to": "B"}], "other": 1}))
    got = datasets.read_dataset(spark, str(tmp_path / "i.json")).collect()
    assert [r.asDict() for r in got] == [{"record_type": "node", "class": "A", "n.m": "1", "from": "", "to": ""}, {"record_type": "edge", "class": "", "n.m": "", "from": "A", "to": "B"}]
    (tmp_path / "o.json").write_text(json.dumps({"a": [1, None], "b": {"c": "d"}}))
    assert [r.asDict() for r in datasets.read_dataset(spark, str(tmp_path / "o.json")).collect()] == [{"a": "1 | ", "b.c": "d"}]
    (tmp_path / "p.csv").write_text('a,b\n"x, ""y""\nz",\nshort\n')
    assert [tuple(r) for r in datasets.read_dataset(spark, str(tmp_path / "p.csv")).collect()] == [('x, "y"\nz', ""), ("short", "")]


def test_failed_write_leaves_no_parts(spark, tmp_path):
    bad = spark.range(40).repartition(2).select(F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception):
        datasets.write_dataset(bad, str(tmp_path / "d"))
    assert not (tmp_path / "d" / datasets.MANIFEST).exists() and not [p for p in (tmp_path / "d").glob("part-*")]


def test_diagnostics(spark, tmp_path):
    record = {"format": 1, "class": "x.A", "methods": 3, "ignoredMethods": 1, "annotatedMethods": 1, "skippedMethods": [{"reason": "native", "count": 2}], "hooks": [{"intent": "http", "signature": "s", "bridge": "b", "method": "m", "line": 4, "count": 5}], "annotations": [{"owner": "o", "count": 1}]}
    p = tmp_path / "d.json"
    p.write_text(json.dumps(record) + "\n\n" + json.dumps({"format": 1, "class": "x.B", "methods": 1, "later": 1}))
    d = scans.read_diagnostics(spark, str(p))
    assert [(r["class"], r["methods"]) for r in d.collect()] == [("x.A", 3), ("x.B", 1)]
    assert sorted((r["dimension"], r["count"], r["reason"], r["intent"]) for r in scans.diagnostic_records(d).collect()) == [("annotation", 1, None, None), ("hook", 5, None, "http"), ("skipped", 2, "native", None)]
    with pytest.raises(Exception, match="unknown keys in diagnostics: later"):
        scans.read_diagnostics(spark, str(p), strict=True).collect()
    p.write_text(json.dumps(record | {"format": 2}))
    with pytest.raises(Exception, match="unknown diagnostics format"):
        scans.read_diagnostics(spark, str(p)).collect()


def test_thresholds(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"max_severity": "medium", "require_clean_cohorts": True, "metrics": {"m": {"max_regression_abs": 4}}, "leaks": {"max_new": 2, "fail_on_worse": True}}, indent=1))
    t = scans.read_thresholds(spark, str(p), strict=True)
    assert t.first()["require_clean_cohorts"] and scans.leak_limits(t) == {"new": 2, "fail_on_worse": 1}
    deltas = spark.createDataFrame([("m", "high", 5.0, 10.0, 9), ("n", "ok", 0.0, 0.0, 9)], "metric string, severity string, regression_abs double, regression_pct double, sample_size bigint")
    assert sorted((r["metric"], r["rule"]) for r in compare.gate(deltas, scans.metric_limits(t)).collect()) == [("m", "regression_abs"), ("m", "severity")]
    assert compare.gate(deltas, scans.metric_limits(scans.read_thresholds(spark, None))).count() == 0
    p.write_text('{"max_severty": "high"}')
    with pytest.raises(Exception, match="max_severty"):
        scans.read_thresholds(spark, str(p), strict=True).collect()


def test_exported_events_come_back(spark, tmp_path):
    rows_ = [(2, 1500, 0, 7, 0, 0, 1000, ("A", "o", "f", "s"), "p"), (3, -5, 1, None, 0, 1, 1000, None, None)]
    events = spark.createDataFrame(rows_, scans.EVENT)
    scans.write_events(events, str(tmp_path / "e"))
    back = scans.read_events(spark, str(tmp_path / "e"))
    assert sorted(map(str, back.drop("source").collect())) == sorted(map(str, events.collect()))
    assert [r[0] for r in scans.event_lines(events.limit(1)).collect()] == ['{"type":2,"delta_us":1500,"flags":0,"thread_id":7,"chunk_seq":0,"rec_ix":0,"segment_start_us":1000,"context":{"screen":"A","owner":"o","flow":"f","step":"s"},"payload":"p"}']


def test_plain_heap_names(spark):
    path = [("GC root: a", "", "gc_root"), ("a.b", "x", "field"), ("a.c$d", "y", "static")]
    raw = spark.createDataFrame([("r", "a.b", "a.c$d", "", "JNI global", "", "old", 0, 5, 1, path, "dump"), ("r", "z", "", "", "", "", "", 0, 1, 0, [], "dump")],
                                "run_set string, class string, holder string, field string, root string, category string, fingerprint string, bytes bigint, kb bigint, objects bigint, path array<struct<class:string,field:string,kind:string>>, source string")
    got = {r["class"]: r for r in resolve.plain_heap_evidence(raw, spark.createDataFrame([("a.b", "x.Feed"), ("a.c", "x.Cache")], "obfuscated string, original string")).collect()}
    assert (got["x.Feed"]["holder"], [s["class"] for s in got["x.Feed"]["path"]]) == ("x.Cache$d", ["GC root: a", "x.Feed", "x.Cache$d"])
    assert got["x.Feed"]["fingerprint"] == "x.feed|x.cache.d||jni|a..gc_root|x.feed.x.field|x.cache.d.y.static" and got["z"]["path"] == []


def test_snapshots_supersede_open_rows(spark, tmp_path):
    schema, src, path = "source string, sequence bigint, bytes bigint, sealed boolean", str(tmp_path / "src"), f"file://{tmp_path}/table"
    reads = [[("a", 1, 100, False), ("b", 1, 50, True)], [("a", 1, 180, False)], [("a", 2, 10, False), ("a", 1, 200, True)], [("c", 1, 1, False)]]
    want = [{("a", 1, 100, False), ("b", 1, 50, True)}, {("a", 1, 180, False), ("b", 1, 50, True)}, {("a", 2, 10, False), ("b", 1, 50, True)}, {("a", 2, 10, False), ("b", 1, 50, True), ("c", 1, 1, False)}]
    for read, known in zip(reads, want):
        spark.createDataFrame(read, schema).coalesce(1).write.mode("append").parquet(src)
        q = follow_snapshots(spark.readStream.schema(schema).parquet(src), path, 2).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert set(map(tuple, snapshot_table(spark, path).read().collect())) == known
    table = snapshot_table(spark, path)
    table.add(3, spark.createDataFrame(reads[3], schema))  # the batch again
    assert set(map(tuple, table.read().collect())) == want[3]
