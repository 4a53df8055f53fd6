"""Heap searches against brute force on a small graph."""

import random

import pytest

from fleetpulse.operators import iterate, leaks
from fleetpulse.functions import text
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(4)
    edges = sorted({(a, b) for _ in range(40) for a, b in [(rnd.randrange(14), rnd.randrange(14))] if a != b})
    return edges, spark.createDataFrame([("h", a, b, "f") for a, b in edges], "g string, src bigint, dst bigint, label string")


def reach(edges, starts, without=None):
    seen, todo = set(starts) - {without}, [s for s in starts if s != without]
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def kept_alive(edges, roots, nodes, t):
    kept = reach(edges, [t]) - reach(edges, [r for r in roots if r != t], t)
    classes = {}
    for n in kept:
        classes[f"c{n % 3}"] = classes.get(f"c{n % 3}", 0) + 1
    return len(kept), sum(10 + n for n in kept), [f"{c} x {n}" for c, n in sorted(classes.items(), key=lambda x: (-x[1], x[0]))[:2]], True


def tables(spark, edges, roots, targets):
    nodes = sorted({n for e in edges for n in e})
    ids = lambda ns: spark.createDataFrame([("h", n) for n in ns], "g string, node bigint")
    return (spark.createDataFrame([("h", a, b, "f") for a, b in edges], "g string, src bigint, dst bigint, label string"), ids(roots), ids(targets),
            spark.createDataFrame([("h", n, 10 + n, f"c{n % 3}") for n in nodes], "g string, node bigint, size bigint, class string"))


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_retained_sets(spark, seed):
    """All nodes as targets: a root, nodes that no root reaches, and loops among them."""
    rnd = random.Random(seed)
    edges = sorted({(a, b) for _ in range(26) for a, b in [(rnd.randrange(16), rnd.randrange(16))] if a != b} | {(14, 15), (15, 14)})
    nodes = {n for e in edges for n in e}
    df, roots, targets, sizes = tables(spark, edges, [0, 1], nodes)
    got = {r["target"]: (r["objects"], r["bytes"], r["classes"], r["exact"]) for r in iterate.retained(df, roots, targets, sizes, most=2).collect()}
    assert got == {t: kept_alive(edges, [0, 1], nodes, t) for t in nodes}


def test_dominators(spark):
    edges = [(0, 2), (0, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 4), (5, 7), (1, 8), (8, 9), (9, 1)]
    df, roots, _, _ = tables(spark, edges, [0, 1], [])
    got = {r["node"]: (r["chain"], r["exact"]) for r in iterate.dominators(df, roots).collect()}
    assert got == {n: (c, True) for n, c in {0: [0], 1: [1], 2: [0, 2], 3: [0, 3], 4: [0, 4], 5: [0, 4, 5], 6: [0, 4, 5, 6], 7: [0, 4, 5, 7], 8: [1, 8], 9: [1, 8, 9]}.items()}


def test_budget_of_retained_sets(spark):
    """A list of ten nodes with chains of six at most: what hangs below falls back to the object alone."""
    edges = [(n, n + 1) for n in range(9)] + [(0, 20), (20, 21)]
    df, roots, targets, sizes = tables(spark, edges, [0], [2, 8, 20])
    got = {r["target"]: (r["objects"], r["bytes"], r["exact"]) for r in iterate.retained(df, roots, targets, sizes, depth=6).collect()}
    assert got == {2: (1, 12, False), 8: (1, 18, False), 20: (2, 61, True)}
    settled = iterate.dominators(df, roots, rounds=2)
    assert settled.filter("not exact").count() > 0


def test_searches_fail_instead_of_ending_early(spark):
    edges = [(n, n + 1) for n in range(6)]
    df, roots, _, _ = tables(spark, edges, [0], [])
    with pytest.raises(RuntimeError):
        iterate.reachable(df, roots, 2)
    with pytest.raises(RuntimeError):
        iterate.shortest_paths(df.withColumn("weight", F.lit(1.0)), roots, 2)
    assert iterate.bounded(df, roots, roots.limit(0), 2).count() == 3


def test_evidence_confidence(spark):
    rows = [(True, [], False), (False, ["a", "b"], False), (True, ["a"], True), (False, [], True)]
    df = spark.createDataFrame(rows, "exact boolean, m array<string>, partial boolean")
    assert [r[0] for r in df.select(leaks.evidence_confidence(F.col("exact"), F.col("m"), F.col("partial"))).collect()] == ["high", "medium_plus;bounded_size;matchers=a,b", "medium;matchers=a;partial_dump", "low_plus;bounded_size;partial_dump"]


def test_paths_from_roots(spark, graph):
    edges, df = graph
    roots = spark.createDataFrame([("h", 0), ("h", 1)], "g string, node bigint")
    targets = spark.createDataFrame([("h", n) for n in (6, 9, 12)], "g string, node bigint")

    def back(path):
        if path[0] in (0, 1):
            yield path
            return
        for a, b in edges:
            if b == path[0] and a not in path:
                yield from back([a, *path])

    got = {}
    for r in iterate.alternative_paths(df, roots, targets).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append(r["path"])
    want = {t: sorted(back([t]), key=lambda p: (len(p), p))[:3] for t in (6, 9, 12)}
    assert got == {t: p for t, p in want.items() if p}
    reached = iterate.reachable(df, roots)
    for r in iterate.reference_paths(reached, targets).collect():
        assert r["path"][0] in (0, 1) and r["path"][-1] == r["target"] and all(p in edges for p in zip(r["path"], r["path"][1:]))


def test_leak_rules(spark):
    path = [("GC root: sticky class", "", "gc_root"), ("androidx.lifecycle.ViewModelStore", "map", "field"), ("com.app.Cache", "listener", "static"), ("com.app.Main$Row", "mContext", "field")]
    df = spark.createDataFrame([("com.app.Main$Row", path)], "name string, path array<struct<class:string,field:string,kind:string>>")
    r = df.select(leaks.path_root(F.col("path")).alias("root"), leaks.path_holder(F.col("path"), F.col("name")).alias("holder"), leaks.path_field(F.col("path"), F.col("name")).alias("field"),
                  leaks.path_matchers(F.col("path")).alias("matchers"), leaks.token(F.col("name")).alias("token")).first()
    assert (r["root"], r["holder"], r["field"], r["token"]) == ("sticky class", "com.app.Cache", "com.app.Cache.mContext", "com.app.main.row")
    assert r["matchers"] == ["androidx.viewmodel_store", "listener_or_callback", "context_reference"]
    kinds = spark.createDataFrame([(x,) for x in ("sticky class", "JNI local", "Java frame", "monitor", "finalizing", "VM internal", "", "other")], "r string")
    assert [x[0] for x in kinds.select(leaks.root_category(F.col("r"))).collect()] == ["class/static", "jni", "thread", "monitor", "reference", "vm/internal", "", "unknown"]
    assert kinds.select(text.class_of_owner(F.lit("owner.Lcom/app/Feed;.load#3"))).first()[0] is not None
