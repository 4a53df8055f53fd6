"""Queries over whole tables, against brute force where no SQL says it."""

from fleetpulse import catalog
from fleetpulse.sources import adapter as src

DIR = "/root/testdata/sf0.001"


def test_shortest_paths_use_all_calls(spark):
    calls = [tuple(r) for r in src.of_type(spark, DIR, "call").select("run_set", "user_id", "k").collect()]
    ids = src.events(spark, DIR).agg({"user_id": "max"}).first()[0] + 1
    n = {}
    for g, u, k in calls:
        e = g, u, (u + 7 * k) % ids
        n[e] = n.get(e, 0) + 1
    cost = {(g, s, s): 0.0 for g, s, _ in n if s < 3}
    changed = True
    while changed:
        changed = False
        for (g, s, at), c in list(cost.items()):
            for (h, a, b), m in n.items():
                if (h, a) == (g, at) and c + 1 / (1 + m) < cost.get((g, s, b), 1e9) - 1e-12:
                    cost[g, s, b], changed = c + 1 / (1 + m), True
    got = {(r["g"], r["source"], r["node"]): r["cost"] for r in catalog.QUERIES["g05_shortest_paths"](spark, DIR).collect()}
    assert set(got) == set(cost)
    assert all(abs(got[x] - cost[x]) < 1e-5 for x in cost)


def test_peaks_cover_signals_and_buckets(spark):
    got = catalog.QUERIES["d05_spectral_peaks"](spark, DIR).collect()
    signals = {r["signal"] for r in got}
    assert {"jank_pct", "http", "http_failed"} <= signals and sum(s.startswith("route:") for s in signals) >= 3


def test_chain_gaps_of_all_run_sets(spark):
    found = catalog.QUERIES["q02_chain_gaps"](spark, DIR)
    assert {r["run_set"] for r in found.select("run_set").distinct().collect()} == {"baseline", "candidate"}


def test_stalls_below_an_hour_are_found(spark):
    found = catalog.QUERIES["w09_stall_episodes"](spark, "/root/testdata/sf0.1")
    assert found.filter("duration_ms < 3600000").count() > 0
