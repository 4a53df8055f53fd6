"""Explanation graph of a timeline: weighted edges between states, symptoms, screens, owners, routes, phases (G family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut

#: Nodes of an all-pairs search, paths, owners and deltas kept.
MOST_NODES, PATHS, OWNERS, DELTAS = 60, 6, 8, 12
#: The symptom of a state.
SYMPTOMS = {"network_loop": "network_loop", "network_slow": "network_slow", "janky": "jank", "stalled": "stall", "memory_pressure": "memory_pressure"}


def node(kind: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(f"{kind}:"), c))


def contributions(buckets: DataFrame) -> DataFrame:
    """(run_set, from, to, kind, strength) of each bucket; buckets has state, screen, owner, route, network (empty
    where unknown), http, http_failed, dns, connect.  Both directions are added later."""
    bad = ~F.col("state").isin("healthy", "recovering")
    s = F.when(bad, 2.0).when(F.col("state") == "recovering", 1.0).otherwise(0.5)
    symptom = F.lit(None).cast("string")
    for state, name in SYMPTOMS.items():
        symptom = F.when(F.col("state") == state, F.lit(f"symptom:{name}")).otherwise(symptom)
    state, screen, owner, route, network = (node(k, F.col(k)) for k in ("state", "screen", "owner", "route", "network"))
    slow, dns, connect = F.lit("symptom:network_slow"), F.lit("phase:DNS"), F.lit("phase:connect")
    n = lambda c: F.col(c) > 0
    edge = lambda a, b, kind, strength, when=F.lit(True): F.when(when & a.isNotNull() & b.isNotNull(), F.struct(a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), strength.alias("strength")))
    on_route = route.isNotNull()
    edges = [edge(state, symptom, "state-symptom", s), edge(screen, state, "screen-state", s), edge(owner, state, "owner-state", s), edge(screen, owner, "screen-owner", s * 0.8), edge(route, state, "route-state", s),
             edge(owner, route, "owner-route", s + 0.5), edge(route, F.lit("phase:HTTP"), "route-phase", s, n("http")), edge(route, dns, "route-phase", s + F.col("dns") * 0.3, n("dns")),
             edge(dns, slow, "phase-symptom", s + 0.5, n("dns") & on_route), edge(route, connect, "route-phase", s + F.col("connect") * 0.3, n("connect")), edge(connect, slow, "phase-symptom", s + 0.5, n("connect") & on_route),
             edge(route, slow, "route-symptom", s + F.col("http_failed"), n("http_failed")), edge(network, state, "network-state", s * 0.7)]
    return buckets.select("run_set", F.inline(F.array_compact(F.array(*edges))))


def loop_contributions(loops: DataFrame) -> DataFrame:
    """Edges of loops (run_set, owner, route, motif, confidence, burn) to their symptom, parties and phases."""
    s = 1 + F.col("confidence") * 3 + F.least(F.lit(3.0), F.col("burn") / 10)
    symptom, owner, route = F.lit("symptom:network_loop"), node("owner", F.col("owner")), node("route", F.col("route"))
    tokens = F.split("motif", "[|]")
    edge = lambda a, b, kind, when=F.lit(True): F.when(when & a.isNotNull() & b.isNotNull(), F.struct(a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), s.alias("strength")))
    connect = [edge(symptom, F.lit("phase:connect"), "loop-phase", F.array_contains(tokens, t)) for t in ("connect_high", "reconnect_high", "websocket_reconnect")]
    edges = [edge(symptom, owner, "loop-owner"), edge(symptom, route, "loop-route"), edge(owner, route, "owner-route"), edge(symptom, F.lit("phase:DNS"), "loop-phase", F.array_contains(tokens, "dns_high")), *connect]
    return loops.select("run_set", F.inline(F.array_compact(F.array(*edges))))


def edges(rows: DataFrame) -> DataFrame:
    """Both directions; count, confidence min(1, strength / 6) and weight 1 / confidence.  Summed before turning."""
    one = rows.groupBy("run_set", "from", "to", "kind").agg(F.count(F.lit(1)).alias("count"), F.sum(F.greatest(F.lit(0.1), "strength")).alias("strength"))
    both = one.unionByName(one.select("run_set", F.col("to").alias("from"), F.col("from").alias("to"), "kind", "count", "strength")).filter(F.col("from") != F.col("to"))
    out = both.groupBy("run_set", "from", "to", "kind").agg(F.sum("count").alias("count"), F.least(F.lit(1.0), F.sum("strength") / 6).alias("confidence"))
    return out.withColumn("weight", 1 / F.col("confidence"))


def nodes(e: DataFrame) -> DataFrame:
    """G04."""
    return e.select("run_set", F.col("from").alias("node")).distinct().withColumn("kind", F.substring_index("node", ":", 1))


def _best_edges(e: DataFrame) -> DataFrame:
    return e.groupBy("run_set", "from", "to").agg(F.min("weight").alias("weight"))


def _relaxed(e: DataFrame, sources: DataFrame) -> DataFrame:
    """Cheapest path from each source to every node (run_set, source, node, cost, path); the lesser path on ties."""
    step = cut(_best_edges(e), "steps")
    best = cut(sources.select("run_set", F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"), F.array("node").alias("path"), F.lit(True).alias("better")), "paths")
    while not best.filter("better").isEmpty():
        front = best.filter("better")
        grown = front.join(step, (front["run_set"] == step["run_set"]) & (front["node"] == step["from"])).filter(~F.array_contains("path", F.col("to"))).select(
            front["run_set"], "source", F.col("to").alias("node"), F.round(F.col("cost") + F.col("weight"), 9).alias("cost"), F.concat("path", F.array("to")).alias("path"), F.lit(False).alias("old"))
        every = best.select("run_set", "source", "node", "cost", "path", F.lit(True).alias("old")).unionByName(grown)
        entry = F.struct("cost", "path")
        new = every.groupBy("run_set", "source", "node").agg(F.min(entry).alias("b"), F.min(F.when(F.col("old"), entry)).alias("o"))
        best = cut(new.select("run_set", "source", "node", "b.cost", "b.path", (~F.col("b").eqNullSafe(F.col("o"))).alias("better")), "paths")
    return best.filter("source <> node").drop("better")


def _first(paths: DataFrame) -> DataFrame:
    text = paths.withColumn("path", F.array_join("path", "->"))
    w = Window.partitionBy("run_set").orderBy("cost", "path")
    out = text.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PATHS)
    return out.select("run_set", "rank", "source", F.col("node").alias("target"), "path", "cost", (1 / (1 + F.col("cost"))).alias("confidence"))


def explanation_paths(e: DataFrame) -> DataFrame:
    """Cheapest paths from symptoms to owners and routes, the six best of each run set."""
    found = _relaxed(e, nodes(e).filter("kind = 'symptom'"))
    return _first(found.filter(F.substring_index("node", ":", 1).isin("owner", "route")))


def all_paths(e: DataFrame) -> DataFrame:
    """Cheapest paths between all nodes of different kinds, the six best, of run sets of at most MOST_NODES nodes."""
    n = nodes(e)
    small = n.groupBy("run_set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MOST_NODES).select("run_set")
    found = _relaxed(e.join(small, "run_set", "left_semi"), n.join(small, "run_set", "left_semi"))
    return _first(found.filter(F.substring_index("node", ":", 1) != F.substring_index("source", ":", 1)))


def owner_scores(e: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Confidence of an owner's edges plus what its loops burn, the eight largest of each run set."""
    rows = e.filter(F.startswith("from", F.lit("owner:"))).select("run_set", F.substr("from", F.lit(7)).alias("owner"), F.col("confidence").alias("score"))
    if loops is not None:
        rows = rows.unionByName(loops.filter("owner <> ''").select("run_set", "owner", (F.col("confidence") * 2 + F.least(F.lit(3.0), F.col("burn") / 10)).alias("score")))
    sums = rows.groupBy("run_set", "owner").agg(F.round(F.sum("score"), 6).alias("score"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("run_set").orderBy(F.desc("score"), "owner"))).filter(F.col("rank") <= OWNERS)


def graph_compare(e: DataFrame, paths: DataFrame, owners: DataFrame) -> DataFrame:
    """New and stronger edges, another best path, grown owners; the DELTAS gravest."""
    pair = lambda df, keys, v: df.groupBy(*keys).agg(*[F.max(F.when(F.col("run_set") == s, F.col(v))).alias(a) for s, a in (("baseline", "b"), ("candidate", "c"))])
    grave = lambda d, b: F.when((d >= 0.6) | ((b > 0) & (d / b >= 0.6)), "high").otherwise("medium")
    delta, zero = F.col("c") - F.coalesce("b", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    out = lambda df, kind, name, severity: df.select(kind.alias("change"), name.alias("name"), severity.alias("severity"), zero.alias("baseline"), F.col("c").alias("candidate"), F.round(delta, 6).alias("delta"))
    ed = pair(e, ["from", "to", "kind"], "confidence").filter("c is not null").filter((F.col("b").isNull() & (F.col("c") >= 0.35)) | (delta >= 0.25))
    rows = out(ed, F.when(F.col("b").isNull(), "new_edge").otherwise("stronger_edge"), F.concat_ws("->", "from", "to", "kind"), grave(F.when(F.col("b").isNull(), F.col("c")).otherwise(delta), zero))
    own = pair(owners, ["owner"], "score").filter("c is not null").filter(delta >= 1)
    rows = rows.unionByName(out(own, F.lit("owner_grew"), F.col("owner"), grave(delta, zero)))
    side = lambda s, v: F.max(F.when(F.col("run_set") == s, F.col(v)))
    first = paths.filter("rank = 1").agg(side("baseline", "path").alias("bp"), side("candidate", "path").alias("cp"), side("baseline", "cost").alias("b"), side("candidate", "cost").alias("c"))
    rows = rows.unionByName(out(first.filter("cp is not null and not (cp <=> bp)"), F.lit("path_changed"), F.col("cp"), F.lit("medium")))
    order = [F.when(F.col("severity") == "high", 0).otherwise(1), F.abs("delta").desc(), F.col("change"), F.col("name")]
    return rows.orderBy(*order).limit(DELTAS)
