"""Iterative graph operators: reachability, paths, components.

All graphs are searched at once, keyed by ``g`` (a run set, a heap), by blocks of nodes (``blocks``): a round settles the
blocks that got news, its result is written and read back, and only names of blocks come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut
from fleetpulse.operators import blocks


def _plain(edges: DataFrame, w: str = "0") -> DataFrame:
    """Edges as blocks take them, each pair of nodes once."""
    return cut(edges.filter("src is not null and dst is not null").groupBy("g", "src", "dst").agg(F.expr(w).cast("bigint").alias("w")), "edges")


def _levels(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(g, node, depth, root): fewest steps from a root, and the least root among those."""
    start = roots.select("g", "node").distinct().select("g", "node", F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("root"))
    return blocks.settle(_plain(edges), start, "depth bigint, root bigint", blocks.levels(rounds))


def reachable(edges: DataFrame, roots: DataFrame, rounds: int | None = None, bounded: bool = False) -> DataFrame:
    """(g, node, root, parent, label, depth) of all nodes that roots (g, node) reach over edges (g, src, dst, label).

    The parent is the least (root, node, label) among those with the fewest steps.  With ``rounds``, a search that hasn't
    ended after so many steps fails, unless it is to be ``bounded`` by them.
    """
    found = _levels(edges, roots, rounds)
    if rounds is not None and not bounded and not found.filter(F.col("depth") >= rounds).isEmpty():
        raise RuntimeError(f"the search didn't end in {rounds} rounds")
    into = edges.select("g", "src", "dst", "label").join(found.select("g", F.col("node").alias("src"), "depth", "root"), ["g", "src"])
    best = into.groupBy("g", F.col("dst").alias("node")).agg(F.min(F.struct("depth", "root", "src", "label")).alias("b"))
    inner = F.col("depth") > 0
    return found.join(best, ["g", "node"], "left").select("g", "node", "root", F.when(inner, F.col("b.src")).alias("parent"), F.when(inner, F.col("b.label")).alias("label"), F.col("depth").cast("int").alias("depth"))


def reachable_targets(reached: DataFrame, nodes: DataFrame, most: int = 2000) -> DataFrame:
    """Reached nodes of each class (nodes has g, node, class), the first ``most`` by node."""
    w = Window.partitionBy("g", "class").orderBy("node")
    return nodes.join(reached.select("g", "node"), ["g", "node"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("g", "class", "node", "rank")


def bounded(edges: DataFrame, roots: DataFrame, blocked: DataFrame, rounds: int) -> DataFrame:
    """(g, node, depth) reached in ``rounds`` steps without the blocked nodes."""
    b = blocked.select("g", "node").distinct()
    open_ = edges.join(b.withColumnRenamed("node", "src"), ["g", "src"], "left_anti").join(b.withColumnRenamed("node", "dst"), ["g", "dst"], "left_anti")
    return reachable(open_, roots.join(b, ["g", "node"], "left_anti"), rounds, True).select("g", "node", "depth")


def dominators(edges: DataFrame, roots: DataFrame, depth: int = 256, rounds: int | None = None) -> DataFrame:
    """(g, node, chain, exact): the nodes on every way from the roots to a node, outermost first, itself last.

    A node's chain is what its reached predecessors' chains have in common, and itself.  A round looks again only at
    blocks before which a chain changed, so work follows the edges.  The budget bounds chains to ``depth`` nodes: deeper
    nodes keep their outermost dominators and are not exact.  With ``rounds``, a change leads to so many others at most,
    one after the other; nodes that the last of them changed are not exact.
    """
    fixed = roots.select("g", "node").distinct()
    e = edges.filter("src <> dst").join(fixed.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")  # nothing dominates a root
    zero = F.lit(0).cast("bigint")
    start = blocks.encoded(fixed.select("g", "node", F.array("node").alias("chain"), (zero - 1).alias("step"), zero.alias("outer")), "chain")
    found = blocks.decoded(blocks.settle(_plain(e), start, "chain binary, step bigint, outer bigint", blocks.chains(depth, rounds), blocks.CHAIN_EDGES, True).filter("outer = 0"), "chain")
    open_ = F.lit(False) if rounds is None else F.col("step") >= rounds
    return found.select("g", "node", "chain", (~open_ & (F.element_at("chain", -1) == F.col("node"))).alias("exact"))


def retained(edges: DataFrame, roots: DataFrame, targets: DataFrame, nodes: DataFrame, depth: int = 256, rounds: int | None = None, most: int = 8) -> DataFrame:
    """What a target (g, node) alone keeps alive: the nodes it dominates, itself included; nodes has (g, node, size) and,
    where it is known, class.

    One dominator tree answers for all targets: a node counts for the targets in its chain.  A target beyond the budget,
    or with a node below it that is, falls back to itself alone and is not exact.  Targets that no root reaches keep what
    they reach and no root does.  ``classes`` has the ``most`` most frequent classes, the least name first among equals.
    """
    nodes = nodes if "class" in nodes.columns else nodes.withColumn("class", F.lit(""))
    t = targets.select("g", F.col("node").alias("target")).distinct()
    tree = cut(dominators(edges, roots, depth, rounds), "dominators")
    under = tree.select("g", "node", "exact", F.explode("chain").alias("target")).join(t, ["g", "target"])
    dead = t.join(tree.select("g", F.col("node").alias("target")), ["g", "target"], "left_anti")
    open_ = edges.join(tree.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")
    under = under.unionByName(_reached(open_, dead).withColumn("exact", F.lit(True)))
    below = t.join(under, ["g", "target"], "left").select("g", "target", F.coalesce("node", "target").alias("node"), F.coalesce("exact", F.lit(False)).alias("exact"))
    whole = below.groupBy("g", "target").agg(F.bool_and("exact").alias("whole"))
    kept = below.join(whole, ["g", "target"]).filter(F.col("whole")).select("g", "target", "node", "whole").unionByName(whole.filter(~F.col("whole")).select("g", "target", F.col("target").alias("node"), "whole"))
    by_class = kept.join(nodes.select("g", "node", "size", "class"), ["g", "node"]).groupBy("g", "target", "whole", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    w = Window.partitionBy("g", "target").orderBy(F.desc("n"), "class")
    top = by_class.withColumn("rank", F.row_number().over(w))
    named = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "class", "n")))), lambda x: F.concat(x["class"], F.lit(" x "), x["n"].cast("string")))
    out = top.groupBy("g", "target", "whole").agg(F.sum("n").alias("objects"), F.sum("bytes").alias("bytes"), named.alias("classes"))
    return out.select(F.col("g").cast("string").alias("graph"), "target", "objects", "bytes", "classes", F.col("whole").alias("exact"))


def _reached(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(g, target, node) that each of the targets reaches, itself included."""
    start = targets.select("g", F.col("target").alias("node"), "target").distinct()
    return blocks.settle(_plain(edges), start, "target bigint", blocks.pairs)


def alternative_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame, most: int = 3, steps: int = 48) -> DataFrame:
    """Up to ``most`` paths from roots to each target, the shortest first, then the least, of ``steps`` nodes at most.

    Every node keeps the paths that a longer one may need (``blocks.first_paths``), so the choice is exact.  Without
    cycles these are ``most`` a node; inside a strong component they may be many more.
    """
    start = roots.select("g", "node").distinct()
    e = edges.filter("src <> dst").join(start.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_anti")  # paths begin at their only root
    e = _plain(e)
    core = _core(e)
    if not core.isEmpty():
        parts = cut(strong_components(core), "components")
        end = lambda c: parts.select("g", F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        e = e.drop("w").join(end("src"), ["g", "src"], "left").join(end("dst"), ["g", "dst"], "left")
        e = cut(e.select("g", "src", "dst", F.coalesce(F.col("src_in") == F.col("dst_in"), F.lit(False)).cast("bigint").alias("w")), "edges")
    one = F.lit(1).cast("bigint")
    start = blocks.encoded(start.select("g", "node", one.alias("size"), F.array("node").alias("path"), one.alias("inside")), "path")
    found = blocks.settle(e, start, "size bigint, path binary, inside bigint", blocks.first_paths(most, steps), blocks.PATH_EDGES)
    wanted = found.join(targets.select("g", "node").distinct(), ["g", "node"])
    rank = F.row_number().over(Window.partitionBy("g", "node").orderBy("size", "path"))
    kept = wanted.withColumn("rank", rank).filter(F.col("rank") <= most).select("g", F.col("node").alias("target"), "path", "rank")
    return blocks.decoded(kept, "path")


def reference_paths(reached: DataFrame, targets: DataFrame, most: int = 48) -> DataFrame:
    """(g, target, path) from root to target by parent pointers, ``most`` steps at most.

    Nodes' next ``size`` ancestors come from two halves, so joins are as many as the steps' logarithm and three.
    """
    up, size = cut(reached.select("g", F.col("node").alias("at"), F.when(F.col("parent").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("parent")).alias("up"), F.col("parent").alias("next")), "up"), 1
    p = targets.join(reached, ["g", "node"]).select("g", F.col("node").alias("target"), F.array("node").alias("path"), F.col("node").alias("at"))

    def grown(rows: DataFrame, path: str) -> DataFrame:
        more = up.select("g", "at", F.col("up").alias("more"), F.col("next").alias("then"))
        keep = [c for c in rows.columns if c not in ("g", "at", "next", path)]
        return rows.join(more, ["g", "at"], "left").select("g", *keep, F.concat(path, F.coalesce("more", F.array().cast("array<bigint>"))).alias(path), F.col("then").alias("at"))

    while 3 * size < most:
        size, two = 2 * size, grown(up.select("g", F.col("at").alias("node"), "up", F.col("next").alias("at")), "up")
        up = cut(two.select("g", F.col("node").alias("at"), "up", F.col("at").alias("next")), "up")
    for _ in range(0, most, size):
        p = grown(p, "path")
    return p.select("g", "target", F.reverse(F.slice("path", 1, most + 1)).alias("path"))


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(g, source, node, cost, path) over edges (g, src, dst, weight), weights not below 0; equal costs take the lesser path.

    Costs are whole billionths, so that sums don't depend on their order.  With ``rounds``, paths of that many steps or
    more fail.
    """
    e = _plain(edges.filter("weight is not null"), "min(round(weight, 9)) * 1000000000 + 0.5")
    start = blocks.encoded(sources.select("g", "node").distinct().select("g", "node", F.lit(0).cast("bigint").alias("cost"), F.array("node").alias("path")), "path")
    found = blocks.decoded(blocks.settle(e, start, "cost bigint, path binary", blocks.cheapest, blocks.PATH_EDGES), "path")
    if rounds is not None and not found.filter(F.size("path") > rounds).isEmpty():
        raise RuntimeError(f"costs still improve after {rounds} rounds")
    return found.select("g", F.element_at("path", 1).alias("source"), "node", (F.col("cost") / 1000000000).alias("cost"), "path")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node (g, node, label) along the edges."""
    return blocks.settle(edges, labels, "label bigint", blocks.spread)


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that begin and end at these nodes."""
    both = edges.join(nodes.select("g", F.col("node").alias("src")), ["g", "src"], "left_semi").join(nodes.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_semi")
    return cut(both.select("g", "src", "dst", "w"), "edges")


def _core(edges: DataFrame) -> DataFrame:
    """Edges on cycles and between them: first nodes that nothing leads to are taken off, then those that lead nowhere."""
    for a, b in (("src", "dst"), ("dst", "src")):
        e = edges.select("g", F.col(a).alias("src"), F.col(b).alias("dst"), "w")
        into = e.select("g", F.col("dst").alias("node"), F.lit(-1).cast("bigint").alias("left")).unionByName(e.select("g", F.col("src").alias("node"), F.lit(0).cast("bigint").alias("left")))
        left = blocks.settle(e, into.groupBy("g", "node").agg(F.sum("left").alias("left")), "left bigint", blocks.peel)
        edges = _between(edges, left.filter("left > 0"))
    return edges


def strong_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(g, node, component), the component named by its least node.

    What lies on no cycle's way is taken off; then colours spread forward, and inside a colour what reaches the colour's own
    node backwards is one component; the rest goes into the next round.
    """
    nodes = edges.select("g", F.col("src").alias("node")).unionByName(edges.select("g", F.col("dst").alias("node"))).distinct()
    left, done, k = _core(_plain(edges.filter("src <> dst"))), [], 0
    while not left.isEmpty():
        if k == rounds:
            raise RuntimeError(f"components are left after {rounds} rounds")
        own = left.select("g", F.col("src").alias("node")).unionByName(left.select("g", F.col("dst").alias("node"))).distinct()
        colour = _spread(left, own.select("g", "node", F.col("node").alias("label"))).withColumnRenamed("label", "colour")
        end = lambda c, colour=colour: colour.select("g", F.col("node").alias(c), F.col("colour").alias(f"{c}_in"))
        back = left.join(end("src"), ["g", "src"]).join(end("dst"), ["g", "dst"]).filter("src_in = dst_in").select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        reached = _levels(back, colour.filter("node = colour"))
        done.append(cut(reached.select("g", "node", F.col("root").alias("component")), "found"))
        rest = own.join(done[-1], ["g", "node"], "left_anti")
        left, k = _core(_between(left, rest)), k + 1
    if not done:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(reduce(DataFrame.unionByName, done), ["g", "node"], "left").select("g", "node", F.coalesce("component", "node").alias("component"))
