"""Loops, explanation paths, owner ids and scopes against brute force and worked cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import causal, loops, sidedata, timeline
from fleetpulse.streaming import windows

CALL = "run_set string, ord bigint, bucket bigint, route string, owner string, dns_ms int, connect_ms int, failed boolean, server_error boolean"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALL)


@pytest.fixture(scope="module")
def polling(spark):
    """A look-up every fifth second of a minute, behind one ordinary call each second."""
    rows = [("a", i, i, "GET /x", "A.b", 40 if i % 5 == 0 else 0, 0, False, False) for i in range(60)]
    return loops.loops(loops.contributions(calls(spark, rows)), spark.createDataFrame([("a", 1000)], "run_set string, size bigint")).collect()


def test_a_periodic_lookup_is_a_loop(polling):
    dns = {r["signal"]: r for r in polling}["dns:global"]
    assert dns["period_ms"] == 5000 and dns["first_ms"] == 0 and dns["last_ms"] == 55000
    assert dns["motif"].split("|")[0] == "dns_high" and dns["route"] == "GET /x" and dns["owner"] == "A.b"
    assert dns["path"].startswith("symptom:network_loop > owner:A.b > route:GET /x > phase:dns")
    assert dns["burn"] == pytest.approx(12 * (1 + dns["confidence"]))


def brute_periodic(x):
    n, c = len(x), [v - sum(x) / len(x) for v in x]
    total = sum(v * v for v in c)
    r = [sum(c[i] * c[i + k] for i in range(n - k)) / total for k in range(1, min(60, n // 2) + 1)]
    h = [v * 0.5 * (1 - math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(c)]
    power = [abs(sum(v * np.exp(-2j * math.pi * k * i / n) for i, v in enumerate(h))) ** 2 for k in range(1, n // 2 + 1)]
    back = float(np.median(power)) or sum(power) / len(power) or 1
    share = [p / sum(power) for p in power]
    entropy = -sum(p * math.log2(p) for p in share if p > 0) / math.log2(len(power))
    trust = [0.65 * min(1, max(0, (p / back - 2) / 8)) + 0.35 * min(1, max(0, 1 - entropy)) for p in power]
    return next((k + 1 for k, v in enumerate(r) if v >= 0.55), None), sorted(((-v, k + 1) for k, v in enumerate(r) if v > 0))[:3], max(trust)


def test_periods_match_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, step in ((40, 4), (61, 7), (100, 9)):
        x = np.where(np.arange(n) % step == 0, 5.0, 0.0) + rng.integers(0, 2, n)
        x[0], x[-1] = 5, max(1, x[-1])
        rows = [("a", "s", i, float(v), n) for i, v in enumerate(x) if v > 0]
        got = loops.periodic(spark.createDataFrame(rows, "run_set string, signal string, bucket bigint, value double, n bigint")).first()
        first, best, trust = brute_periodic(x.tolist())
        assert got["first_lag"] == first and [int(k) for k in got["lags"]] == [k for _, k in best]
        assert got["peak_confidence"] == pytest.approx(trust, abs=1e-9)


def test_loops_are_compared(spark):
    schema = "run_set string, key string, period_ms bigint, confidence double, burn double, severity string"
    rows = [("baseline", "gone", 5000, .6, 9., "medium"), ("candidate", "new", 5000, .8, 9., "high"), ("baseline", "same", 5000, .5, 5., "medium"), ("candidate", "same", 5100, .5, 5.5, "medium"),
            ("baseline", "more", 5000, .5, 5., "medium"), ("candidate", "more", 5000, .75, 20., "high"), ("baseline", "less", 5000, .7, 20., "high"), ("candidate", "less", 5000, .5, 5., "medium")]
    got = {r["key"]: (r["status"], r["severity"]) for r in loops.compare(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"gone": ("disappeared", "ok"), "new": ("appeared", "high"), "more": ("strengthened", "high"), "less": ("weakened", "ok")}


EDGE = "run_set string, `from` string, `to` string, kind string, count bigint, confidence double, weight double"


def test_explanation_paths_match_brute_force(spark):
    links = {("symptom:jank", "state:janky"): 1., ("state:janky", "owner:A"): 3., ("state:janky", "route:R"): 1., ("route:R", "owner:A"): 1., ("owner:A", "screen:S"): 2.}
    links |= {(b, a): w for (a, b), w in links.items()}
    e = spark.createDataFrame([("x", a, b, "k", 1, 1 / w, w) for (a, b), w in links.items()], EDGE)
    nodes = sorted({a for a, _ in links})

    def best(a, b):
        found = []
        for n in range(len(nodes)):
            for mid in itertools.permutations([x for x in nodes if x not in (a, b)], n):
                way = [a, *mid, b]
                if all(p in links for p in zip(way, way[1:])):
                    found.append((sum(links[p] for p in zip(way, way[1:])), "->".join(way)))
        return min(found)

    got = {(r["source"], r["target"]): (r["cost"], r["path"]) for r in causal.explanation_paths(e).collect()}
    assert got == {("symptom:jank", t): best("symptom:jank", t) for t in ("owner:A", "route:R")}
    want = sorted(best(a, b) for a in nodes for b in nodes if a.split(":")[0] != b.split(":")[0])[:6]
    assert [(r["cost"], r["path"]) for r in causal.all_paths(e).orderBy("rank").collect()] == want


def test_graphs_are_compared(spark):
    e = spark.createDataFrame([("candidate", "a", "b", "k", 1, .5, 2.), ("baseline", "c", "d", "k", 1, .1, 10.), ("candidate", "c", "d", "k", 1, .9, 1.), ("candidate", "e", "f", "k", 1, .2, 5.)], EDGE)
    paths = spark.createDataFrame([("baseline", 1, "x->y", 2.), ("candidate", 1, "x->z", 1.)], "run_set string, rank int, path string, cost double")
    owners = spark.createDataFrame([("baseline", "o", 1.), ("candidate", "o", 2.5), ("candidate", "p", .5)], "run_set string, owner string, score double")
    got = {(r["change"], r["name"], r["severity"]) for r in causal.graph_compare(e, paths, owners).collect()}
    assert got == {("new_edge", "a->b->k", "medium"), ("stronger_edge", "c->d->k", "high"), ("path_changed", "x->z", "medium"), ("owner_grew", "o", "high")}


def test_stable_ids(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2 ** 64
        return f"stable:0x{h:016x}"

    rows = [("a.B", "run", "()V"), ("a.B", "run", "(I)V"), ("ä.C", "größe", "")]
    got = {r["id"]: r["symbol"] for r in sidedata.owner_map(spark.createDataFrame(rows, "class string, method string, descriptor string")).collect()}
    assert got == {fnv("\0".join(r)): f"{r[0]}.{r[1]}" for r in rows}


def test_flow_scopes_and_kept_samples(spark):
    ops = [(1, 1, 0, "start", "a"), (1, 1, 1, "step", "s"), (1, 1, 2, "start", "b"), (1, 1, 3, "end", ""), (1, 1, 4, "end", ""), (1, 1, 5, "end", "")]
    got = windows.flow_scopes(spark.createDataFrame(ops, "process_id bigint, thread_id bigint, ms bigint, op string, name string")).orderBy("ms").collect()
    assert [(r["flow"], r["step"]) for r in got] == [("a", ""), ("a", "s"), ("b", ""), ("a", "s"), ("", ""), ("", "")]
    rows = spark.createDataFrame([(1, 0, 10), (1, 5, 13), (1, 9, 14), (1, 70000, 14), (2, 1, 1)], "process_id bigint, ms bigint, v bigint")
    assert sorted(r["ms"] for r in windows.kept_samples(rows, {"v": 4}).collect()) == [0, 1, 9, 70000]


def test_loops_make_states(spark):
    b = spark.createDataFrame([("a", i, 1000, 0, 0, 0, 0, 0, 0, 0, 0) for i in range(6)], "run_set string, bucket bigint, size bigint, http int, http_failed int, http_p95_ms int, frames int, jank int, stalls int, stall_max_ms int, pss_kb int").withColumn("ram_kb", F.lit(0))
    around = spark.createDataFrame([("a", 1000, 2000, .5), ("a", 2000, 3000, .9), ("a", 5000, 5000, .2)], "run_set string, first_ms bigint, last_ms bigint, confidence double")
    got = [(r["state"], r["weight"]) for r in timeline.states(b, around).orderBy("bucket").collect()]
    assert got == [("healthy", 0), ("network_loop", .5), ("network_loop", .9), ("network_loop", .9), ("recovering", 0), ("healthy", 0)]
