"""Queries of the D, N, U07, G05 and H families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators import iterate, periodic
from fleetpulse.operators import timeline as tl
from fleetpulse.plans.timeline_queries import TL
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import sql

WHOLE_SIGNALS = ["jank_pct", "http", "http_failed", "stalls"]


def whole_series(spark, d) -> DataFrame:
    """The timeline's own buckets: its signals and the HTTP calls of the three most frequent routes of a run set.

    The tables have no DNS or connection events; the reference leaves out signals that are 0 everywhere as well.
    """
    rel = tl.relative(src.wide(spark, d))
    b = tl.timeline(rel).withColumn("jank_pct", tl.jank_pct()).withColumnRenamed("bucket", "ix")
    out = b.select("run_set", "ix", *[F.col(s).cast("double").alias(s) for s in WHOLE_SIGNALS]).unpivot(["run_set", "ix"], WHOLE_SIGNALS, "signal", "value")
    calls = rel.filter("type = 'http'").join(F.broadcast(b.select("run_set", "size").distinct()), "run_set").groupBy("run_set", "route", F.expr("rel_ms div size").alias("ix")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy("run_set").orderBy(F.desc("n"), "route")
    top = calls.groupBy("run_set", "route").agg(F.sum("n").alias("n")).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("run_set", "route")
    routes = b.select("run_set", "ix").join(F.broadcast(top), "run_set").join(calls, ["run_set", "route", "ix"], "left")
    out = out.unionByName(routes.select("run_set", "ix", F.concat(F.lit("route:"), "route").alias("signal"), F.coalesce("n", F.lit(0.0)).alias("value")))
    live = out.groupBy("run_set", "signal").agg(F.max(F.abs("value")).alias("m")).filter("m > 0").select("run_set", "signal")
    return out.join(F.broadcast(live), ["run_set", "signal"])


WHOLE_SERIES = """calls_by_route AS (SELECT run_set, route, bucket, count(*) AS n FROM bucketed WHERE type = 'http' GROUP BY ALL),
  top_routes AS (SELECT run_set, route FROM (SELECT run_set, route, row_number() OVER (PARTITION BY run_set ORDER BY sum(n) DESC, route) AS rn FROM calls_by_route GROUP BY run_set, route) WHERE rn <= 3),
  every AS (SELECT run_set, bucket AS ix, unnest(['jank_pct', 'http', 'http_failed', 'stalls']) AS signal, unnest([CASE WHEN frames > 0 THEN jank * 100.0::DOUBLE / frames ELSE 0 END, http::DOUBLE, http_failed::DOUBLE, stalls::DOUBLE]) AS value FROM tl
    UNION ALL SELECT run_set, tl.bucket, 'route:' || route, coalesce(c.n, 0)::DOUBLE FROM tl JOIN top_routes t USING (run_set) LEFT JOIN calls_by_route c USING (run_set, route, bucket)),
  series AS (SELECT * FROM every WHERE (run_set, signal) IN (SELECT (run_set, signal) FROM every GROUP BY ALL HAVING max(abs(value)) > 0))""".replace("SELECT (run_set, signal) FROM every GROUP BY ALL", "SELECT (run_set, signal) FROM every GROUP BY run_set, signal")


BURSTS = """
SELECT s.run_set, s.signal, ix, value FROM series s JOIN (SELECT run_set, signal, any_value(m) AS m, median(abs(value - m)) AS mad, median(value) FILTER (value > 0) AS pm FROM (SELECT *, median(value) OVER (PARTITION BY run_set, signal) AS m FROM series) GROUP BY run_set, signal) t USING (run_set, signal)
WHERE value > 0 AND value >= greatest(1, m + 3 * mad, 2 * m, CASE WHEN m = 0 AND pm > 1 THEN pm ELSE 0 END)"""


@query("n02_bursts", sql(*TL, WHOLE_SERIES, body=BURSTS))
def n02(spark, d):
    return periodic.bursts(whole_series(spark, d))


@query("d01_autocorrelation", sql(*TL, WHOLE_SERIES, "x AS (SELECT *, value - avg(value) OVER (PARTITION BY run_set, signal) AS x FROM series)",
                                  "lagged AS (SELECT run_set, signal, x, " + ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, 61)) + " FROM x WINDOW w AS (PARTITION BY run_set, signal ORDER BY ix))",
                                  "sums AS (SELECT run_set, signal, count(*) AS n, sum(x * x) AS ss, [" + ", ".join(f"sum(x * l{k})" for k in range(1, 61)) + "] AS s FROM lagged GROUP BY run_set, signal)", body="""
SELECT run_set, signal, CAST(lag AS INTEGER) AS lag, round(coalesce(s[lag], 0) / ss, 6) AS r FROM (SELECT *, unnest(range(1, 61)) AS lag FROM sums) WHERE lag <= n // 2"""))
def d01(spark, d):
    return periodic.autocorrelation(whole_series(spark, d)).withColumn("r", F.round("r", 6))


@query("d05_spectral_peaks")
def d05(spark, d):
    return periodic.peaks(periodic.spectrum(whole_series(spark, d)))


WHOLE = """g AS (SELECT run_set AS g, user_id AS src, (user_id + 7 * k) % (SELECT max(user_id) + 1 FROM tel) AS dst, count(*) AS n FROM tel WHERE type = 'call' GROUP BY ALL)"""


def whole_graph(spark, d) -> DataFrame:
    """All call rows between unfolded user ids: a user calls the one 7 * k ids on, around the largest id."""
    ids = src.events(spark, d).agg((F.max("user_id") + 1).alias("ids"))
    e = src.of_type(spark, d, "call").crossJoin(F.broadcast(ids))
    return e.groupBy(F.col("run_set").alias("g"), F.col("user_id").alias("src"), ((F.col("user_id") + 7 * F.col("k")) % F.col("ids")).alias("dst")).agg(F.count(F.lit(1)).alias("n"))


COMPONENTS = sql(WHOLE, """reach AS (SELECT g, src AS s, dst AS t FROM g UNION SELECT r.g, r.s, e.dst FROM reach r JOIN g e ON e.g = r.g AND e.src = r.t)""", body="""
SELECT n.g, node, least(node, coalesce(min(b.s), node)) AS component FROM (SELECT DISTINCT g, unnest([src, dst]) AS node FROM g) n
LEFT JOIN reach a ON a.g = n.g AND a.s = node LEFT JOIN reach b ON b.g = n.g AND b.s = a.t AND b.t = node GROUP BY n.g, node""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("u07_strong_components", COMPONENTS)
def u07(spark, d):
    return iterate.strong_components(whole_graph(spark, d))


REACHED = sql(WHOLE, """walk AS (SELECT g, src AS node, 0 AS depth FROM g WHERE src < 3 UNION SELECT w.g, e.dst, depth + 1 FROM walk w JOIN g e ON e.g = w.g AND e.src = w.node WHERE depth < (SELECT max(user_id) FROM tel))""", body="""
SELECT g, node, min(depth) AS depth FROM walk GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("h01_reachability", REACHED)
def h01(spark, d):
    e = whole_graph(spark, d).withColumn("label", F.lit("call"))
    return iterate.reachable(e, e.filter("src < 3").select("g", F.col("src").alias("node"))).select("g", "node", "depth")


def heap_tree(spark, d):
    """Calls as heap edges from smaller to larger ids, so that graphs have ends; three roots, sizes by id."""
    e = whole_graph(spark, d).filter("src < dst").withColumn("label", F.lit("call"))
    ids = e.select("g", F.col("src").alias("node")).unionByName(e.select("g", F.col("dst").alias("node"))).distinct()
    return e, ids.filter("node < 3"), ids


@query("h02_reachable_targets", sql(WHOLE, """walk AS (SELECT g, src AS node FROM g WHERE src < 3 AND src < dst UNION SELECT w.g, e.dst FROM walk w JOIN g e ON e.g = w.g AND e.src = w.node AND e.src < e.dst)""", body="""
SELECT g, class, node, CAST(rn AS INTEGER) AS rank FROM (SELECT g, 'class' || (node % 4) AS class, node, row_number() OVER (PARTITION BY g, node % 4 ORDER BY node) AS rn FROM walk) WHERE rn <= 2000""").replace("WITH ", "WITH RECURSIVE ", 1))
def h02(spark, d):
    e, roots, ids = heap_tree(spark, d)
    return iterate.reachable_targets(iterate.reachable(e, roots), ids.withColumn("class", F.concat(F.lit("class"), (F.col("node") % 4).cast("string"))))


@query("h04_blocked_reachability", sql(WHOLE, """walk AS (SELECT g, src AS node, 0 AS depth FROM g WHERE src < 3 AND src < dst AND src <> 1 UNION SELECT w.g, e.dst, depth + 1 FROM walk w JOIN g e ON e.g = w.g AND e.src = w.node AND e.src < e.dst AND e.dst % 5 <> 4 AND e.dst <> 1 WHERE depth < 3)""", body="""
SELECT g, node, min(depth) AS depth FROM walk WHERE node % 5 <> 4 GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))
def h04(spark, d):
    """Three steps from the roots, past node 1 and every fifth node, which are blocked."""
    e, roots, ids = heap_tree(spark, d)
    return iterate.bounded(e, roots, ids.filter("node = 1 or node % 5 = 4"), 3).select("g", "node", "depth")


RETAINED = [WHOLE, "t AS (SELECT DISTINCT g AS tgg, src AS tg FROM g WHERE src BETWEEN 3 AND 8 AND src < dst)", """own AS (SELECT g, src AS tg, src AS node FROM g WHERE src IN (SELECT tg FROM t) AND src < dst UNION SELECT o.g, o.tg, e.dst FROM own o JOIN g e ON e.g = o.g AND e.src = o.node AND e.src < e.dst)""",
            """other AS (SELECT g, tg, src AS node FROM g, t WHERE src < 3 AND src < dst UNION SELECT o.g, o.tg, e.dst FROM other o JOIN g e ON e.g = o.g AND e.src = o.node AND e.src < e.dst AND e.dst <> o.tg)""",
            "kept AS (SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM other x WHERE x.g = own.g AND x.tg = own.tg AND x.node = own.node))"]


def retained_of(spark, d, depth: int = 256):
    e, roots, ids = heap_tree(spark, d)
    targets = e.filter("src between 3 and 8").select("g", F.col("src").alias("node")).distinct()
    return iterate.retained(e, roots, targets, ids.withColumns({"size": F.col("node") + 1, "class": F.concat(F.lit("class"), (F.col("node") % 11).cast("string"))}), depth)


@query("h03_retained", sql(*RETAINED, body="SELECT g AS graph, tg AS target, count(*) AS objects, CAST(sum(node + 1) AS BIGINT) AS bytes FROM kept GROUP BY ALL").replace("WITH ", "WITH RECURSIVE ", 1))
def h03(spark, d):
    return retained_of(spark, d).select("graph", "target", "objects", "bytes")


@query("h03_retained_classes", sql(*RETAINED, "c AS (SELECT g, tg, 'class' || (node % 11) AS class, count(*) AS n FROM kept GROUP BY ALL)", body="""
SELECT g AS graph, tg AS target, string_agg(class || ' x ' || n, '|' ORDER BY n DESC, class) AS classes, true AS exact FROM (SELECT *, row_number() OVER (PARTITION BY g, tg ORDER BY n DESC, class) AS r FROM c) WHERE r <= 8 GROUP BY ALL""").replace("WITH ", "WITH RECURSIVE ", 1))
def h03_classes(spark, d):
    return retained_of(spark, d).select("graph", "target", F.array_join("classes", "|").alias("classes"), "exact")


@query("h03_dominators", sql(WHOLE, """e AS (SELECT g, src, dst FROM g WHERE src < dst AND dst >= 3)""", """reached AS (SELECT DISTINCT g, src AS node FROM g WHERE src < 3 AND src < dst UNION SELECT r.g, e.dst FROM reached r JOIN e ON e.g = r.g AND e.src = r.node)""",
                           """past AS (SELECT v.g, v.node AS without, r.node FROM reached v JOIN reached r ON r.g = v.g AND r.node < 3 AND r.node <> v.node UNION SELECT p.g, p.without, e.dst FROM past p JOIN e ON e.g = p.g AND e.src = p.node AND e.dst <> p.without)""", body="""
SELECT r.g, r.node, (SELECT count(*) FROM reached v WHERE v.g = r.g AND NOT EXISTS (SELECT 1 FROM past p WHERE p.g = r.g AND p.without = v.node AND p.node = r.node)) AS dominators,
       (SELECT max(v.node) FROM reached v WHERE v.g = r.g AND v.node < r.node AND NOT EXISTS (SELECT 1 FROM past p WHERE p.g = r.g AND p.without = v.node AND p.node = r.node)) AS parent FROM reached r""").replace("WITH ", "WITH RECURSIVE ", 1))
def h03_dominators(spark, d):
    """Edges go from smaller to larger ids here, so the greatest dominator is the nearest."""
    e, roots, _ = heap_tree(spark, d)
    tree = iterate.dominators(e, roots.join(e.select("g", F.col("src").alias("node")), ["g", "node"], "left_semi"))
    return tree.select("g", "node", F.size("chain").cast("bigint").alias("dominators"), F.when(F.size("chain") > 1, F.element_at("chain", -2)).alias("parent"))


@query("h05_reference_paths")
def h05(spark, d):
    """Paths by parent pointers; which parent comes first has no SQL, tests hold paths against their edges."""
    e, roots, ids = heap_tree(spark, d)
    reached = iterate.reachable(e, roots)
    return iterate.reference_paths(reached, ids.filter("node % 3 = 0")).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("h06_alternative_paths")
def h06(spark, d):
    """Up to three paths from roots to each target by reverse steps; tests hold them against brute force."""
    e, roots, ids = heap_tree(spark, d)
    return iterate.alternative_paths(e, roots, ids.filter("node % 7 = 3")).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("g05_shortest_paths")
def g05(spark, d):
    """Cheapest paths from three nodes, weight 1 / (1 + calls); the tests hold it against brute force."""
    e = whole_graph(spark, d).select("g", "src", "dst", (1.0 / (1 + F.col("n"))).alias("weight"))
    out = iterate.shortest_paths(e, e.filter("src < 3").select("g", F.col("src").alias("node")).distinct())
    return out.select("g", "source", "node", F.round("cost", 6).alias("cost"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
