"""Searches by blocks of nodes: the same results over many small blocks, and rounds that follow blocks instead of steps."""

import glob
import random

import pytest

from fleetpulse.functions.staging import run_folder, staging_root
from fleetpulse.operators import blocks, iterate
from pyspark.sql import functions as F


@pytest.fixture
def small(monkeypatch):
    for name in ("EDGES", "CHAIN_EDGES", "PATH_EDGES"):
        monkeypatch.setattr(blocks, name, 12)


def graph(spark, edges, roots, g="h"):
    df = spark.createDataFrame([(g, a, b, "f", 1.0 + (a + b) % 3) for a, b in edges], "g string, src bigint, dst bigint, label string, weight double")
    return df, spark.createDataFrame([(g, r) for r in roots], "g string, node bigint")


def reach(edges, starts, without=None):
    seen, todo = set(starts) - {without}, [s for s in starts if s != without]
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def cyclic():
    rnd = random.Random(11)
    edges = sorted({(a, b) for _ in range(46) for a, b in [(rnd.randrange(24), rnd.randrange(24))] if a != b})
    return edges, sorted({n for e in edges for n in e})


def test_cheapest_paths_may_be_long(spark):
    """100 steps, which 60 rounds didn't reach."""
    df, roots = graph(spark, [(n, n + 1) for n in range(100)] + [(0, 2), (2, 1)], [0])
    got = {r["node"]: (r["cost"], r["path"]) for r in iterate.shortest_paths(df.withColumn("weight", F.lit(0.5)), roots).collect()}
    assert got[100] == (49.5, [0, *range(2, 101)]) and got[1] == (0.5, [0, 1])


def test_equal_costs_take_the_lesser_path_over_blocks(spark, small):
    edges, _ = cyclic()
    df, roots = graph(spark, edges, [edges[0][0]])
    best, open_ = {}, [(0.0, [edges[0][0]])]
    while open_:
        open_.sort()
        cost, path = open_.pop(0)
        if path[-1] not in best:
            best[path[-1]] = cost, path
            open_ += [(cost + 1.0 + (a + b) % 3, [*path, b]) for a, b in edges if a == path[-1] and b not in path]
    assert {r["node"]: (r["cost"], r["path"]) for r in iterate.shortest_paths(df, roots).collect()} == best


def test_components_over_blocks(spark, small):
    """cycles through several blocks, and what lies between and beside them."""
    edges, nodes = cyclic()
    got = {r["node"]: r["component"] for r in iterate.strong_components(graph(spark, edges, [])[0]).collect()}
    assert got == {n: min(m for m in nodes if m in reach(edges, [n]) and n in reach(edges, [m])) for n in nodes}


def test_reach_over_blocks(spark, small):
    """depths, least roots and parents."""
    edges, nodes = cyclic()
    df, roots = graph(spark, edges, nodes[:2])
    want, depth = {n: (0, n, None) for n in nodes[:2]}, 0
    while True:
        depth += 1
        new = {}
        for a, b in edges:
            if b not in want and a in want:
                new[b] = min(new.get(b, (9, 99, 99)), (depth, want[a][1], a))
        if not new:
            break
        want |= new
    assert {r["node"]: (r["depth"], r["root"], r["parent"]) for r in iterate.reachable(df, roots).collect()} == want


def test_rounds_follow_blocks(spark):
    """300 steps end in one round."""
    df, roots = graph(spark, [(n, n + 1) for n in range(300)], [0])
    for search in (iterate.reachable, iterate.dominators):
        with run_folder(spark):
            assert search(df, roots).count() == 301
            assert len(glob.glob(f"{staging_root(spark).removeprefix('file://')}/run-*/blocks-*/round*")) == 1


@pytest.mark.parametrize("most", [1, 5, 48])
def test_reference_paths_of_any_length(spark, most):
    """F6."""
    df, roots = graph(spark, [(n, n + 1) for n in range(60)], [0])
    targets = spark.createDataFrame([("h", n) for n in (0, 3, 47, 48, 49, 60)], "g string, node bigint")
    got = {r["target"]: r["path"] for r in iterate.reference_paths(iterate.reachable(df, roots), targets, most).collect()}
    assert got == {n: list(range(max(0, n - most), n + 1)) for n in (0, 3, 47, 48, 49, 60)}


def test_alternative_paths_past_many_dead_ends(spark):
    """over 6000 lesser ways back end at no root; the only path was lost among them."""
    dead = [(10 * layer + a, 10 * layer + 10 + b) for layer in range(1, 6) for a in range(6) for b in range(6)] + [(60 + a, 1000) for a in range(6)]
    path = [0, *range(101, 109), 1000]
    df, roots = graph(spark, dead + list(zip(path, path[1:])), [0])
    got = iterate.alternative_paths(df, roots, spark.createDataFrame([("h", 1000)], "g string, node bigint")).collect()
    assert [r["path"] for r in got] == [path]


def test_alternative_paths_over_blocks(spark, small):
    edges, nodes = cyclic()
    root = next(n for n in nodes if len(reach(edges, [n])) > 12)
    df, roots = graph(spark, edges, [root])
    paths, open_ = {}, [[root]]
    while open_:
        p = open_.pop()
        paths.setdefault(p[-1], []).append(p)
        open_ += [[*p, b] for a, b in edges if a == p[-1] and b not in p and b != root]
    got = {}
    for r in iterate.alternative_paths(df, roots, spark.createDataFrame([("h", n) for n in nodes], "g string, node bigint")).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["path"])
    assert got == {n: sorted(p, key=lambda x: (len(x), x))[:3] for n, p in paths.items()}


def test_dominators_and_retained_over_blocks(spark, small):
    """Chains that cross blocks, and targets that no root reaches."""
    edges, nodes = cyclic()
    df, roots = graph(spark, edges, nodes[:1])
    found = reach(edges, nodes[:1])
    doms = {v: {d for d in found if d == v or v not in reach(edges, nodes[:1], d)} for v in found}
    got = {r["node"]: r["chain"] for r in iterate.dominators(df, roots).collect()}
    assert got == {v: sorted(d, key=lambda x: len(doms[x])) for v, d in doms.items()}
    sizes = spark.createDataFrame([("h", n, 1) for n in nodes], "g string, node bigint, size bigint")
    kept = {r["target"]: r["objects"] for r in iterate.retained(df, roots, sizes.select("g", "node"), sizes).collect()}
    assert kept == {t: len(reach(edges, [t]) - reach(edges, [r for r in nodes[:1] if r != t], t)) for t in nodes}
