"""Hand-worked constants."""

import math

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import numbers, text
from fleetpulse.operators import compare, evidence, inspect, iterate, periodic, resolve, robust, timeline


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_nearest_rank(spark):
    df = spark.createDataFrame([(100,), (1000,)], "x bigint")
    assert df.agg(numbers.nearest_rank("x", 0.95).alias("p")).first()["p"] == 1000
    big = spark.range(1, 20026).select(F.col("id").alias("x"))
    assert big.agg(numbers.nearest_rank("x", 0.95).alias("p")).first()["p"] == 19024


def test_number_helpers(spark):
    df = spark.createDataFrame([(7, 2, 5), (1, 0, 9)], "a bigint, b bigint, c bigint")
    got = df.select(numbers.int_div(F.col("a"), F.col("b")).alias("d"), numbers.counter_delta(F.col("a"), F.col("c")).alias("r"), numbers.share(F.col("a"), F.col("b")).alias("s"),
                    numbers.saturating_sum(F.lit(2 ** 63 - 1), F.col("a")).alias("x"), numbers.saturating_score(F.lit(0), 5).alias("z")).collect()
    assert [tuple(r) for r in got] == [(3, 2, 350.0, 2 ** 63 - 1, 0.0), (None, 1, 0.0, 2 ** 63 - 1, 0.0)]


def test_gauges(spark):
    m = [("a", "average", 100, 2, 1), ("a", "average", 200, 4, 2), ("s", "state", 2, 1, 1), ("s", "state", 5, 1, 2), ("b", "boolean", 1, 1, 1), ("b", "boolean", 0, 0, 2)]
    df = spark.createDataFrame([("r", *x) for x in m], "run_set string, name string, mode string, v bigint, n bigint, ord bigint")
    assert rows(inspect.gauges(df), "name", "value", "samples") == [("a", 166, 6), ("b", 50, 2), ("s", 5, 2)]


def samples(spark, sides):
    return spark.createDataFrame([(s, "Route", "r", "ms", float(v), 1) for s, vs in sides.items() for v in vs], "run_set string, dimension string, name string, metric string, value double, weight int")


def test_distribution(spark):
    r = robust.distributions(samples(spark, {"baseline": range(1, 101)})).first()
    assert (r["median"], r["p90"], r["p95"], r["p99"], r["mad"], r["trimmed"]) == (50.5, 90, 95, 99, 25, 50.5)


@pytest.mark.parametrize("sides, delta, severity", [
    ({"baseline": [1, 2, 3], "candidate": [2, 3, 4]}, round(5 / 9, 6), "ok"),
    ({"baseline": [100 + i % 5 for i in range(80)], "candidate": [180 + i % 5 for i in range(80)]}, 1.0, "high"),
    ({"baseline": [100, 101, 102], "candidate": [220, 221, 222]}, 1.0, "medium"),
])
def test_robust_compare(spark, sides, delta, severity):
    s = samples(spark, sides)
    r = robust.robust_compare(robust.distributions(s), robust.cliffs_delta(s)).first()
    assert (r["cliff"], r["severity"]) == (delta, severity)


def test_bootstrap_covers_p95_and_ignores_partitions(spark):
    s = samples(spark, {"baseline": range(1000)})
    a, b = (robust.bootstrap_p95(s.repartition(n)).first() for n in (1, 5))
    assert a == b and a["low"] <= 949 <= a["high"] and a["high"] - a["low"] < 80


BUCKET = "run_set string, bucket bigint, size bigint, http bigint, http_failed bigint, http_avg_ms bigint, http_p95_ms bigint, frames bigint, jank bigint, stalls bigint, stall_max_ms bigint, pss_kb bigint, ram_kb bigint, rx bigint, tx bigint"


def buckets(spark, values):
    zero = dict.fromkeys([c.split()[0] for c in BUCKET.split(", ")], 0)
    return spark.createDataFrame([tuple((zero | {"run_set": "r", "bucket": i, "size": 1000} | v).values()) for i, v in enumerate(values)], BUCKET)


def test_change_point(spark):
    b = buckets(spark, [{"http": 3, "http_p95_ms": v} for v in (100, 100, 100, 520, 540, 530)])
    p = timeline.change_points(timeline.change_candidates(timeline.signal_points(b))).collect()
    assert [(r["signal"], r["bucket"], r["before"], r["after"], r["score"]) for r in p] == [("http_p95_ms", 3, 100.0, 530.0, 8.6)]


def test_load_scores(spark):
    b = buckets(spark, [{"http": 1, "http_failed": 1, "http_p95_ms": 500, "frames": 100, "jank": 10, "pss_kb": 102400, "ram_kb": 307200},
                        {"http": 1, "http_p95_ms": 700, "frames": 100, "jank": 20, "pss_kb": 135168, "ram_kb": 204800}, {"frames": 100, "pss_kb": 102400, "ram_kb": 307200}])
    got = dict(rows(timeline.integrals(timeline.states(b)), "score", "value"))
    assert (got["jank_pressure_area"], got["latency_pain_area"], got["memory_pressure_area"], got["recovery_debt"]) == (30, 600, 88, 3)


def test_states(spark):
    b = buckets(spark, [{}, {"frames": 100, "jank": 10}, {"frames": 100, "jank": 20}, {"frames": 100}, {}, {"http": 1, "http_p95_ms": 650}])
    s = timeline.states(b)
    assert [r["state"] for r in s.orderBy("bucket").collect()] == ["healthy", "janky", "janky", "recovering", "healthy", "network_slow"]
    t = timeline.transition_summary(timeline.transitions(s)).first()
    assert (t["healthy_to_bad"], t["recovery_probability"]) == (2, 0.5)
    e = timeline.episodes(s).first()
    assert (e["recovery_windows"], e["recovery_ms"]) == (2, 2000)


def test_timeline(spark):
    cols = "run_set string, source string, ord bigint, time_ms bigint, type string, failed boolean, dur bigint, frames bigint, jank bigint, stall_ms bigint, pss_kb bigint, ram_kb bigint, rx bigint, tx bigint"
    e = [(100, "http", False, 100), (1200, "http", False, 200), (1500, "http", True, 300)]
    data = [("r", "l", i, t, k, f, v, None, None, None, None, None, None, None) for i, (t, k, f, v) in enumerate(e)]
    data += [("r", "l", 4, 1600, "ui", False, 0, 60, 6, None, None, None, None, None), ("r", "l", 5, 2400, "memory", False, 0, None, None, None, 123000, 0, None, None),
             ("r", "l", 6, 2500, "memory", False, 0, None, None, None, None, 1000, 1000, 200), ("r", "l", 7, 3500, "memory", False, 0, None, None, None, None, 900, 1600, 260)]
    got = timeline.timeline(timeline.relative(spark.createDataFrame(data, cols))).orderBy("bucket").collect()
    assert [(r["http"], r["http_failed"], r["http_avg_ms"], r["http_p95_ms"], r["frames"]) for r in got] == [(1, 0, 100, 100, 0), (2, 1, 250, 300, 60), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    assert [(r["pss_kb"], r["rx"], r["tx"]) for r in got][2:] == [(123000, 0, 0), (0, 600, 60)]


def test_autocorrelation_and_spectrum(spark):
    s = spark.createDataFrame([("r", "four", i, 1.0 if i % 4 == 0 else 0.0) for i in range(32)] + [("r", "sine", i, math.sin(2 * math.pi * i / 8)) for i in range(64)], "run_set string, signal string, ix bigint, value double")
    four = periodic.lag_summary(periodic.autocorrelation(s)).filter("signal = 'four'").first()
    assert (four["first_significant"], four["top_lag"]) == (4, 4)
    power = periodic.spectrum(s)
    top = periodic.peaks(power).filter("signal = 'sine'").orderBy(F.desc("ratio")).first()
    assert 7.5 <= top["period"] <= 8.5
    assert periodic.entropy(power).filter("signal = 'sine'").first()["entropy"] <= 0.5


def test_bursts(spark):
    s = spark.createDataFrame([("r", "x", i, 5.0 if i % 4 == 0 else 0.0) for i in range(24)], "run_set string, signal string, ix bigint, value double")
    r = periodic.regularity(periodic.bursts(s)).first()
    assert (r["bursts"], r["period"], r["regularity"]) == (6, 4.0, 1.0)


def test_names(spark):
    owners = ["com.a.Feed.load", "owner.com.a.Feed.load", "com.a.Feed.load#12", "com/a/Feed", "Lcom/a/Feed;", "feed.load", "unknown", "com.a.Feed$1.run"]
    got = spark.createDataFrame([(o,) for o in owners], "o string").select(text.class_of_owner(F.col("o")).alias("c"), text.method_of_owner(F.col("o")).alias("m")).collect()
    assert [r["c"] for r in got] == ["com.a.Feed", "com.a.Feed", "com.a.Feed", "com.a.Feed", "com.a.Feed", None, None, "com.a.Feed$1"]
    assert [r["m"] for r in got][:3] == ["load", "load", "load"]
    r = spark.createDataFrame([("GET /u/123/x/a@b.cc/0123456789abcdef0/123e4567-e89b-12d3-a456-426614174000",)], "r string").select(text.redact_route(F.col("r")).alias("r")).first()
    assert r["r"] == "GET /u/{id}/x/{email}/{hex}/{uuid}"
    k = spark.createDataFrame([("com.a.FeedActivity",), ("com.a.RowViewHolder",), ("android.os.Looper",), ("com.a.Plain",)], "c string").select(text.object_kind(F.col("c")).alias("k")).collect()
    assert [x["k"] for x in k] == ["activity", "viewholder", "system", "user"]


def test_deobfuscation(spark):
    m = spark.createDataFrame([("a.b", "com.x.FeedPresenter"), ("c", "com.x.FeedActivity"), ("a", "no")], "obfuscated string, original string")
    v = spark.createDataFrame([("a.b.render",), ("c",), ("cd",), ("a.b",)], "value string")
    assert rows(resolve.deobfuscate(v, "value", m), "value", "plain") == [("a.b", "com.x.FeedPresenter"), ("a.b.render", "com.x.FeedPresenter.render"), ("c", "com.x.FeedActivity"), ("cd", "cd")]


def test_symbols_as_of(spark):
    d = spark.createDataFrame([("f", 1, 7, "old"), ("f", 5, 7, "new")], "source string, ord bigint, id bigint, value string")
    r = spark.createDataFrame([("f", 0, 7), ("f", 3, 7), ("f", 5, 7), ("g", 9, 7)], "source string, ord bigint, id bigint")
    assert rows(resolve.symbols_as_of(r, d), "source", "ord", "symbol") == [("f", 0, "id:7"), ("f", 3, "old"), ("f", 5, "new"), ("g", 9, "id:7")]


def test_class_edges(spark):
    c = spark.createDataFrame([("r", "x.A.f", "x.B.g", 2), ("r", "x.A.h", "x.B.g", 3), ("r", "x.B.g", "x.A.f", 4), ("r", "x.A.f", "x.A.h", 1)], "run_set string, caller string, callee string, n bigint")
    assert rows(evidence.class_edges(c), "from_class", "to_class", "count") == [("x.A", "x.B", 5), ("x.B", "x.A", 4)]


def test_strong_components(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4), ("h", 1, 2)], "g string, src bigint, dst bigint")
    assert rows(iterate.strong_components(e), "g", "node", "component") == [("g", 1, 1), ("g", 2, 1), ("g", 3, 1), ("g", 4, 4), ("h", 1, 1), ("h", 2, 2)]


def test_heap(spark):
    e = spark.createDataFrame([("h", 1, 2, "holder"), ("h", 2, 3, "child"), ("h", 1, 4, "other"), ("h", 3, 4, "x")], "g string, src bigint, dst bigint, label string")
    roots, target = (spark.createDataFrame([("h", n)], "g string, node bigint") for n in (1, 2))
    sizes = spark.createDataFrame([("h", n, 32) for n in (1, 2, 3, 4)], "g string, node bigint, size bigint")
    reached = iterate.reachable(e, roots)
    assert rows(reached, "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert rows(iterate.retained(e, roots, target, sizes), "target", "objects", "bytes") == [(2, 2, 64)]
    assert iterate.reference_paths(reached, spark.createDataFrame([("h", 3)], "g string, node bigint")).first()["path"] == [1, 2, 3]


def test_shortest_paths_match_brute_force(spark):
    import heapq
    import random

    rnd = random.Random(4)
    edges = [("g", a, b, rnd.choice([0.5, 1.0, 2.0])) for a in range(12) for b in rnd.sample(range(12), 3) if a != b]
    got = {r["node"]: (r["cost"], r["path"]) for r in iterate.shortest_paths(spark.createDataFrame(edges, "g string, src bigint, dst bigint, weight double"), spark.createDataFrame([("g", 0)], "g string, node bigint")).collect()}
    best, todo = {}, [(0.0, [0])]
    while todo:
        cost, path = heapq.heappop(todo)
        if path[-1] in best:
            continue
        best[path[-1]] = (cost, path)
        for _, a, b, w in edges:
            if a == path[-1] and b not in path:
                heapq.heappush(todo, (cost + w, [*path, b]))
    assert got == best


def test_gate(spark):
    deltas = spark.createDataFrame([("m", "high", 5.0, 10.0, 9), ("n", "ok", 0.0, 0.0, 9)], "metric string, severity string, regression_abs double, regression_pct double, sample_size bigint")
    limits = spark.createDataFrame([("*", "medium", None, None), ("m", None, 4.0, 0.0)], "metric string, max_severity string, max_abs double, max_pct double")
    assert rows(compare.gate(deltas, limits), "metric", "rule") == [("m", "regression_abs"), ("m", "severity")]


def test_failures_burn_with_phases_and_loops(spark):
    b = buckets(spark, [{"http": 1, "http_failed": 2}, {"stalls": 1}, {}]).withColumn("dns", F.lit(4)).withColumn("connect", F.lit(2)).withColumn("dns_ms", F.lit(0)).withColumn("connect_ms", F.lit(0))
    loops = spark.createDataFrame([("r", 2000, 2000, 0.8, 7.5), ("r", 0, 0, 0.2, 1.0)], "run_set string, first_ms bigint, last_ms bigint, confidence double, burn double")
    s = timeline.states(b, loops)
    assert [r["state"] for r in s.orderBy("bucket").collect()] == ["network_slow", "stalled", "network_loop"]  # the weak loop names no state
    got = dict(rows(timeline.integrals(s, loops), "score", "value"))
    assert got["network_failure_burn"] == 2 + 3 * 1.5 + 8.5 and got["recovery_debt"] == 1  # stalls and loops owe nothing
    assert dict(rows(timeline.integrals(s), "score", "value"))["network_failure_burn"] == 6.5
