"""Queries of network loops, the weighted state model, the explanation graph and the rest of the timeline (N, K, G, M, C, D06, J20-J22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut
from fleetpulse.operators import causal, loops, periodic
from fleetpulse.operators import timeline as tl
from fleetpulse.plans.graph_queries import whole_series
from fleetpulse.plans.timeline_queries import AREAS, HTTP, STATES, TL, bucketed, change_points, http, load_scores, model, timeline
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import NET_NAME_SQL, PHASES, sql


BASE = "['route:' || route, 'owner:' || owner]"
METRIC_KIND = """CASE k % 9 WHEN 0 THEN {'kind': 'dns', 'route': 'get_r1', 'owner': '', 'tokens': ['dns_high', 'route:get_r1']} WHEN 1 THEN {'kind': 'connect', 'route': 'post_x', 'owner': '', 'tokens': ['connect_high', 'route:post_x']}
  WHEN 2 THEN {'kind': 'retry', 'route': '', 'owner': '', 'tokens': ['reconnect_high']} WHEN 3 THEN {'kind': 'websocket', 'route': '', 'owner': 'chat', 'tokens': ['websocket_reconnect', 'reconnect_high', 'owner:chat']}
  WHEN 4 THEN {'kind': 'websocket', 'route': 'get_feed', 'owner': '', 'tokens': ['websocket_failure', 'http_failed', 'route:get_feed']} WHEN 5 THEN {'kind': 'route', 'route': 'get_a', 'owner': '', 'tokens': ['route:get_a', 'route:get_a']}
  WHEN 6 THEN {'kind': 'failure', 'route': '', 'owner': '', 'tokens': ['http_failed', 'http_5xx']} WHEN 8 THEN {'kind': 'dns', 'route': '', 'owner': '', 'tokens': ['dns_high']} END"""


def _both(kind: str, when: str, tokens: str) -> str:
    return " UNION ALL ".join(f"SELECT run_set, ord, bucket, {name} AS signal, '{kind}' AS kind, route, owner, 1.0::DOUBLE AS value, list_concat({tokens}, {BASE}) AS tokens FROM calls_in WHERE {when}"
                              for name in (f"'{kind}:global'", f"'{kind}:route:' || route"))


CONTRIB = f"""contrib AS (SELECT run_set, ord, bucket, 'route:' || route AS signal, 'route' AS kind, route, owner, 1.0::DOUBLE AS value, {BASE} AS tokens FROM calls_in
  UNION ALL SELECT run_set, ord, bucket, 'owner:' || owner, 'owner', route, owner, 1.0::DOUBLE, {BASE} FROM calls_in UNION ALL {_both('dns', 'dns_ms > 0', "['dns_high']")} UNION ALL {_both('connect', 'connect_ms > 0', "['connect_high']")}
  UNION ALL {_both('failure', 'failed OR server_error', "list_filter(['http_failed', CASE WHEN server_error THEN 'http_5xx' END], lambda x: x IS NOT NULL)")}
  UNION ALL SELECT run_set, ord, bucket, 'metric:' || m.kind || ':' || m.route || ':' || m.owner || ':' || name, m.kind, m.route, m.owner, v::DOUBLE, m.tokens FROM (SELECT *, {NET_NAME_SQL} AS name, k % 4 AS v, {METRIC_KIND} AS m FROM bucketed WHERE type = 'call')
    WHERE m IS NOT NULL AND v > 0 AND NOT (k % 2 = 0 AND contains(name, 'attempts') AND v <= 1))"""
VALS = "vals AS (SELECT run_set, signal, bucket, sum(value) AS value FROM contrib GROUP BY ALL), spans AS (SELECT run_set, max(bucket) + 1 AS n FROM vals GROUP BY run_set)"
BURST = """dense AS (SELECT g.run_set, g.signal, g.bucket, coalesce(v.value, 0) AS value FROM (SELECT run_set, signal, unnest(range(0, n)) AS bucket FROM (SELECT DISTINCT run_set, signal FROM vals) JOIN spans USING (run_set)) g LEFT JOIN vals v USING (run_set, signal, bucket)),
  mids AS (SELECT run_set, signal, median(value) AS m, median(value) FILTER (value > 0) AS pm FROM dense GROUP BY ALL), limits AS (SELECT run_set, signal, greatest(1, m + 3 * median(abs(value - m)), 2 * m, CASE WHEN m = 0 AND pm > 1 THEN pm ELSE 0 END) AS least_value FROM dense JOIN mids USING (run_set, signal) GROUP BY run_set, signal, m, pm),
  found AS (SELECT run_set, signal, bucket, value FROM vals JOIN limits USING (run_set, signal) WHERE value >= least_value)"""
LOOP_VIEWS = [*TL, HTTP, CONTRIB, VALS, BURST]


def contrib(spark, d) -> DataFrame:
    rows = cut(bucketed(spark, d), "bucketed")
    return loops.contributions(http(rows), src.net_metrics(rows))


@query("p21_network_metrics", sql(body=f"""
SELECT name, m.kind AS kind, m.route AS route, m.owner AS owner, count(*) AS n FROM (SELECT {NET_NAME_SQL} AS name, {METRIC_KIND} AS m FROM ctx WHERE type = 'call') GROUP BY ALL"""))
def p21(spark, d):
    m = src.net_metrics(src.events(spark, d)).withColumn("m", loops.network_metric(F.col("name")))
    return m.groupBy("name", "m.kind", "m.route", "m.owner").agg(F.count(F.lit(1)).alias("n"))


@query("n01_loop_signals", sql(*TL, HTTP, CONTRIB, body="""
SELECT run_set, signal, min(kind) AS kind, coalesce(arg_min(route, ord) FILTER (route <> ''), '') AS route, coalesce(arg_min(owner, ord) FILTER (owner <> ''), '') AS owner, count(*) AS rows, sum(value) AS value, count(DISTINCT bucket) AS buckets, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM contrib GROUP BY ALL"""))
def n01(spark, d):
    c = contrib(spark, d)
    n = c.groupBy("run_set", "signal").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"), F.count_distinct("bucket").alias("buckets"), F.sum(F.size("tokens")).alias("tokens"))
    return loops.described(c).join(n, ["run_set", "signal"])


@query("n02_loop_bursts", sql(*LOOP_VIEWS, body="SELECT * FROM found"))
def n02(spark, d):
    return loops.bursts(loops.points(contrib(spark, d)))


@query("n03_burst_gaps", sql(*LOOP_VIEWS, body="""
SELECT run_set, signal, count(*) AS bursts, median(gap) AS gap, sum(value) AS burst_sum, min(bucket) AS first, max(bucket) AS last FROM (SELECT *, bucket - lag(bucket) OVER (PARTITION BY run_set, signal ORDER BY bucket) AS gap FROM found) GROUP BY ALL HAVING count(*) >= 3"""))
def n03(spark, d):
    g = loops.gaps(loops.bursts(loops.points(contrib(spark, d))))
    return g.groupBy("run_set", "signal").agg(F.count(F.lit(1)).alias("bursts"), F.median("gap").alias("gap"), F.sum("value").alias("burst_sum"), F.min("bucket").alias("first"), F.max("bucket").alias("last")).filter("bursts >= 3")


@query("n05_motifs", sql(*LOOP_VIEWS, """toks AS (SELECT run_set, signal, bucket, token, count(*) AS total FROM (SELECT run_set, signal, bucket, unnest(tokens) AS token FROM contrib) GROUP BY ALL)""",
                         """own AS (SELECT run_set, signal, token, count(*) AS buckets, sum(total) AS total, true AS seen FROM toks JOIN found USING (run_set, signal, bucket) GROUP BY ALL)""",
                         """every AS (SELECT * FROM own UNION ALL SELECT run_set, signal, token, n, n, false FROM (SELECT run_set, signal, CASE min(kind) WHEN 'dns' THEN 'dns_high' WHEN 'connect' THEN 'connect_high' WHEN 'retry' THEN 'reconnect_high' WHEN 'websocket' THEN 'websocket_reconnect' WHEN 'failure' THEN 'http_failed' END AS token FROM contrib GROUP BY ALL)
  JOIN (SELECT run_set, signal, count(*) AS n FROM found GROUP BY ALL) USING (run_set, signal) WHERE token IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own o WHERE o.run_set = run_set AND o.signal = signal AND o.token = token))""".replace("o.run_set = run_set AND o.signal = signal AND o.token = token", "(o.run_set, o.signal, o.token) = (k.run_set, k.signal, k.token)").replace("GROUP BY ALL)\n  JOIN", "GROUP BY ALL) k\n  JOIN"),
                         body="""
SELECT run_set, signal, array_to_string(list(token ORDER BY rn), '|') AS motif, least(1.0::DOUBLE, count(*) FILTER (seen AND buckets >= 2) / 3.0::DOUBLE) AS motif_score FROM (
  SELECT *, row_number() OVER (PARTITION BY run_set, signal ORDER BY CASE WHEN token = 'dns_high' THEN 0 WHEN token = 'connect_high' THEN 1 WHEN token IN ('reconnect_high', 'websocket_reconnect') THEN 2 WHEN token IN ('websocket_failure', 'http_5xx', 'http_failed') THEN 3
    WHEN starts_with(token, 'route:') THEN 4 WHEN starts_with(token, 'owner:') THEN 5 ELSE 6 END, buckets DESC, total DESC, token) AS rn FROM every WHERE buckets >= 2 OR starts_with(token, 'route:') OR starts_with(token, 'owner:')) WHERE rn <= 5 GROUP BY ALL"""))
def n05(spark, d):
    c = contrib(spark, d)
    return loops.motifs(c, loops.bursts(loops.points(c)), loops.described(c)).withColumn("motif", F.array_join("motif", "|"))


def found_loops(spark, d) -> DataFrame:
    rows = bucketed(spark, d)
    return loops.loops(contrib(spark, d), rows.groupBy("run_set").agg(F.max("size").alias("size")))


@query("n08_loops")
def n08(spark, d):
    """The loops kept of each run set; the spectral part has no SQL, tests hold it against brute force."""
    return loops.selected(found_loops(spark, d)).withColumns({c: F.round(c, 6) for c in ("confidence", "burn")})


@query("n09_loop_compare")
def n09(spark, d):
    return loops.compare(loops.selected(found_loops(spark, d)))


@query("m04_phases", sql(*TL, HTTP, body="""
SELECT run_set, bucket, count(nullif(dns_ms, 0)) AS dns, CAST(coalesce(sum(dns_ms) // nullif(count(nullif(dns_ms, 0)), 0), 0) AS BIGINT) AS dns_ms, count(nullif(connect_ms, 0)) AS connect, CAST(coalesce(sum(connect_ms) // nullif(count(nullif(connect_ms, 0)), 0), 0) AS BIGINT) AS connect_ms,
  CAST(coalesce(sum(ttfb_ms) // nullif(count(nullif(ttfb_ms, 0)), 0), 0) AS BIGINT) AS ttfb_ms FROM calls_in GROUP BY ALL"""))
def m04(spark, d):
    return tl.phase_buckets(http(bucketed(spark, d)))


@query("m09_route_series", sql(*TL, """top_routes AS (SELECT run_set, route FROM (SELECT run_set, route, row_number() OVER (PARTITION BY run_set ORDER BY count(*) DESC, route) AS rn FROM bucketed WHERE type = 'http' GROUP BY run_set, route) WHERE rn <= 3)""", body="""
SELECT run_set, route, count(*) AS buckets, sum(n)::DOUBLE AS calls, max(n)::DOUBLE AS most FROM (SELECT t.run_set, r.route, t.bucket, count(b.ord) AS n FROM tl t JOIN top_routes r USING (run_set) LEFT JOIN bucketed b ON b.run_set = t.run_set AND b.bucket = t.bucket AND b.type = 'http' AND b.route = r.route GROUP BY ALL) GROUP BY run_set, route"""))
def m09(spark, d):
    s = whole_series(spark, d).filter("signal like 'route:%'")
    return s.groupBy("run_set", F.substr("signal", F.lit(7)).alias("route")).agg(F.count(F.lit(1)).alias("buckets"), F.sum("value").alias("calls"), F.max("value").alias("most"))


@query("m10_sufficiency", sql(*TL, body="SELECT run_set, count(*) AS buckets, max(size) AS size, CASE WHEN count(*) < 3 THEN 'medium' ELSE 'ok' END AS status FROM tl GROUP BY run_set"))
def m10(spark, d):
    return tl.sufficiency(timeline(spark, d))


SAMPLES = """samples AS (SELECT b.run_set, b.bucket, r.route, o.owner, s.screen, n.network FROM (SELECT DISTINCT run_set, bucket FROM tl) b
  LEFT JOIN (SELECT run_set, bucket, arg_min(route, (-n, route)) AS route FROM (SELECT run_set, bucket, route, count(*) AS n FROM bucketed WHERE type = 'http' GROUP BY ALL) GROUP BY ALL) r USING (run_set, bucket)
  LEFT JOIN (SELECT run_set, bucket, arg_min(owner, (-n, owner)) AS owner FROM (SELECT run_set, bucket, owner, count(*) AS n FROM bucketed WHERE type = 'http' OR stall_ms IS NOT NULL GROUP BY ALL) GROUP BY ALL) o USING (run_set, bucket)
  LEFT JOIN (SELECT run_set, bucket, arg_min(screen, (-n, screen)) AS screen FROM (SELECT run_set, bucket, screen, count(*) AS n FROM bucketed WHERE type = 'ui' GROUP BY ALL) GROUP BY ALL) s USING (run_set, bucket)
  LEFT JOIN (SELECT run_set, bucket, arg_min(network, (-n, network)) AS network FROM (SELECT run_set, bucket, CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'wifi' WHEN 2 THEN 'cellular' ELSE 'other' END AS network, count(*) AS n FROM bucketed WHERE type = 'memory' GROUP BY ALL) GROUP BY ALL) n USING (run_set, bucket))"""


def samples(rows: DataFrame) -> DataFrame:
    """Route, owner, screen and network that stand for each bucket: all four counted in one pass over the rows."""
    k = F.col("k")
    network = F.when(k % 4 == 0, "none").when(k % 4 == 1, "wifi").when(k % 4 == 2, "cellular").otherwise("other")
    of = lambda name, when, c: F.when(when, F.struct(F.lit(name).alias("dim"), c.alias("value")))
    on = lambda t: F.col("type") == t
    seen = F.array_compact(F.array(of("route", on("http"), F.col("route")), of("owner", on("http") | F.col("stall_ms").isNotNull(), F.col("owner")), of("screen", on("ui"), F.col("screen")), of("network", on("memory"), network)))
    n = rows.select("run_set", "bucket", F.inline(seen)).groupBy("run_set", "bucket", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
    best = lambda dim: F.min_by("value", F.when(F.col("dim") == dim, F.struct(-F.col("n"), F.col("value")))).alias(dim)
    return n.groupBy("run_set", "bucket").agg(*[best(x) for x in ("route", "owner", "screen", "network")])


@query("m07_samples", sql(*TL, SAMPLES, body="SELECT * FROM samples WHERE coalesce(route, owner, screen, network) IS NOT NULL"))
def m07(spark, d):
    return samples(bucketed(spark, d))


@query("c04_described_changes", sql(*TL, SAMPLES, "good AS (SELECT run_set, 'pss_kb' AS signal, bucket, pss_kb::DOUBLE AS before, http::DOUBLE AS after, (http - stalls)::DOUBLE AS delta, (frames % 11)::DOUBLE AS score FROM tl WHERE http > 0)", body="""
SELECT g.*, s.route, s.owner, s.screen, s.network, CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END AS direction, round(CASE WHEN before <> 0 THEN delta * 100 / before ELSE 0 END, 4) AS delta_pct, CASE WHEN delta <= 0 THEN 'ok' WHEN score >= 6 THEN 'high' ELSE 'medium' END AS severity FROM good g LEFT JOIN samples s USING (run_set, bucket)"""))
def c04(spark, d):
    """Every bucket with calls stands for a change point here, so that all branches are seen."""
    t = timeline(spark, d).filter("http > 0")
    num = lambda c: c.cast("double")
    good = t.select("run_set", F.lit("pss_kb").alias("signal"), "bucket", num(F.col("pss_kb")).alias("before"), num(F.col("http")).alias("after"), num(F.col("http") - F.col("stalls")).alias("delta"), num(F.col("frames") % 11).alias("score"))
    return tl.described_changes(good, samples(bucketed(spark, d)))


@query("c03_changes_nearby")
def c03_nearby(spark, d):
    """C03 and C04 of the timeline's own signals."""
    return tl.described_changes(change_points(spark, d), samples(bucketed(spark, d)))


@query("k01_contributors", sql(*STATES, body="SELECT run_set, state, count(*) AS windows, round(sum(weight), 4) AS weight, count(w0) AS loops, count(w1) AS stalls, count(w2) AS memory, count(w3) AS janky, count(w4) AS slow FROM states GROUP BY ALL"))
def k01(spark, d):
    n = lambda s: F.count_if(F.exists("symptoms", lambda x: x["state"] == s))
    return model(spark, d).groupBy("run_set", "state").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum("weight"), 4).alias("weight"), n("network_loop").alias("loops"), n("stalled").alias("stalls"), n("memory_pressure").alias("memory"), n("janky").alias("janky"), n("network_slow").alias("slow"))


@query("k08_context_sticky", sql(*STATES, SAMPLES, """ctxs AS (SELECT s.run_set, s.bucket, state, bad, concat_ws('|', 'owner:' || owner, 'route:' || route, 'screen:' || screen, 'network:' || network) AS context FROM states s LEFT JOIN samples USING (run_set, bucket))""", body="""
SELECT run_set, state, context, CAST(c AS BIGINT) AS count, p AS probability, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY p DESC, c DESC, state, context) AS rn FROM (
  SELECT run_set, state, context, count(*) FILTER (state = ns AND context = nc) AS c, round(count(*) FILTER (state = ns AND context = nc) / count(*), 6) AS p FROM (SELECT *, lead(state) OVER w AS ns, lead(context) OVER w AS nc FROM ctxs WINDOW w AS (PARTITION BY run_set ORDER BY bucket)) WHERE ns IS NOT NULL AND bad AND context <> '' GROUP BY ALL) WHERE c > 0) WHERE rn <= 5"""))
def k08(spark, d):
    s = model(spark, d).join(samples(bucketed(spark, d)), ["run_set", "bucket"], "left").fillna("", ["route", "owner", "screen", "network"])
    return tl.context_sticky(s)


WTRANS = """trans AS (SELECT *, round(count / sum(count) OVER (PARTITION BY run_set, from_state), 6) AS probability FROM (SELECT run_set, from_state, to_state, count(*) AS count FROM (SELECT run_set, state AS from_state, lead(state) OVER (PARTITION BY run_set ORDER BY bucket) AS to_state FROM states) WHERE to_state IS NOT NULL GROUP BY ALL)),
  eps AS (SELECT run_set, count(*) AS episodes, round(coalesce(avg(n) FILTER (e < last), 0), 6) AS recovery_windows, round(coalesce(avg(n * size) FILTER (e < last), 0), 6) AS recovery_ms FROM (SELECT run_set, island, count(*) AS n, max(bucket) AS e, max(last) AS last, max(size) AS size FROM (
    SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run_set ORDER BY bucket) AS island, max(bucket) OVER (PARTITION BY run_set) AS last FROM states) WHERE bad GROUP BY run_set, island) GROUP BY run_set),
  moves AS (SELECT run_set, CAST(sum(count) AS BIGINT) AS transitions, coalesce(max(probability) FILTER (from_state = to_state AND from_state NOT IN ('healthy', 'recovering')), 0) AS stickiest, CAST(sum(CASE WHEN f AND NOT t THEN count ELSE 0 END) AS BIGINT) AS healthy_to_bad,
    round(CASE WHEN sum(CASE WHEN NOT f THEN count ELSE 0 END) > 0 THEN sum(CASE WHEN NOT f AND t THEN count ELSE 0 END) / sum(CASE WHEN NOT f THEN count ELSE 0 END) ELSE 1 END, 6) AS recovery_probability FROM (SELECT *, from_state IN ('healthy', 'recovering') AS f, to_state IN ('healthy', 'recovering') AS t FROM trans) GROUP BY run_set),
  model AS (SELECT *, CASE WHEN healthy_to_bad > 0 AND recovery_probability < 0.35 THEN 'high' WHEN stickiest >= 0.7 THEN 'high' WHEN confidence = 'low' THEN 'medium' WHEN healthy_to_bad > 0 OR recovery_windows >= 3 THEN 'medium' ELSE 'ok' END AS status FROM (
    SELECT *, CASE WHEN windows < 4 OR transitions < 3 THEN 'low' WHEN episodes = 0 AND windows >= 10 THEN 'high' WHEN episodes = 0 OR windows < 10 OR episodes < 2 THEN 'medium' ELSE 'high' END AS confidence FROM (
      SELECT w.run_set, windows, exposure, transitions, stickiest, healthy_to_bad, recovery_probability, coalesce(episodes, 0) AS episodes, coalesce(recovery_windows, 0) AS recovery_windows, coalesce(recovery_ms, 0) AS recovery_ms
      FROM (SELECT run_set, count(*) AS windows, round(avg(CASE WHEN bad THEN 1.0::DOUBLE ELSE 0 END), 6) AS exposure FROM states GROUP BY run_set) w JOIN moves USING (run_set) LEFT JOIN eps USING (run_set))))"""


@query("k09_model_summary", sql(*STATES, WTRANS, body="SELECT * FROM model"))
def k09(spark, d):
    return tl.model_summary(model(spark, d))


def _severity(kind: str) -> str:
    if kind == "count":
        return "CASE WHEN w >= 3 THEN 'high' WHEN w >= 1 THEN 'medium' ELSE 'ok' END"
    much, some = (25, 10) if kind == "share" else (5000, 1000)
    return f"CASE WHEN w <= 0 THEN 'ok' WHEN w >= {much} OR (b > 0 AND w * 100 / b >= 50) THEN 'high' WHEN w >= {some} OR (b > 0 AND w * 100 / b >= 20) THEN 'medium' ELSE 'ok' END"


@query("k10_model_compare", sql(*STATES, WTRANS, "mrows AS (" + " UNION ALL ".join(f"SELECT run_set, '{n}' AS metric, '{k}' AS kind, {w} AS up, {n}{' * 100' if k == 'share' else ''}::DOUBLE AS v FROM model" for n, k, w in tl.MODEL_METRICS) +
                                """ UNION ALL SELECT run_set, 'sticky:' || from_state, 'share', true, probability * 100 FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY probability DESC, count DESC, from_state) AS rn FROM trans WHERE from_state = to_state) WHERE rn <= 3)""", body=f"""
SELECT metric, round(b, 6) AS baseline, round(c, 6) AS candidate, d AS delta, CASE kind WHEN 'count' THEN {_severity('count')} WHEN 'share' THEN {_severity('share')} ELSE {_severity('duration')} END AS severity FROM (
  SELECT *, CASE WHEN up THEN d ELSE -d END AS w FROM (SELECT *, round(c - b, 6) AS d FROM (SELECT metric, kind, up, coalesce(max(v) FILTER (run_set = 'baseline'), 0) AS b, coalesce(max(v) FILTER (run_set = 'candidate'), 0) AS c FROM mrows GROUP BY ALL)))"""))
def k10(spark, d):
    return tl.model_compare(model(spark, d))


@query("j21_integral_compare", sql(*STATES, AREAS, "scores AS (" + " UNION ALL ".join(f"SELECT run_set, '{n}' AS score, round({n}, 4) AS value, {m} AS m, {h} AS h FROM areas" for n, (m, h) in tl.LIMITS.items()) + ")", body="""
SELECT score, baseline, candidate, delta, round(pct, 4) AS delta_pct, CASE WHEN delta <= 0 THEN 'ok' WHEN delta >= h * 0.35::DOUBLE OR pct >= 50 THEN 'high' WHEN delta >= m * 0.35::DOUBLE OR pct >= 15 THEN 'medium' ELSE 'ok' END AS severity FROM (
  SELECT *, CASE WHEN baseline <> 0 THEN delta * 100 / baseline ELSE 0 END AS pct FROM (SELECT score, m, h, baseline, candidate, round(candidate - baseline, 4) AS delta FROM (SELECT score, m, h, coalesce(max(value) FILTER (run_set = 'baseline'), 0) AS baseline, coalesce(max(value) FILTER (run_set = 'candidate'), 0) AS candidate FROM scores GROUP BY ALL)))"""))
def j21(spark, d):
    return tl.integral_compare(load_scores(spark, d))


S = "CASE WHEN bad THEN 2.0::DOUBLE WHEN state = 'recovering' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"
SYMPTOM = "CASE state " + " ".join(f"WHEN '{k}' THEN 'symptom:{v}'" for k, v in causal.SYMPTOMS.items()) + " END"


def _edge(a: str, b: str, kind: str, strength: str, when: str = "true") -> str:
    return f"SELECT run_set, {a} AS a, {b} AS b, '{kind}' AS kind, {strength} AS s FROM g WHERE ({when}) AND {a} IS NOT NULL AND {b} IS NOT NULL"


ST, SC, OW, RO, NE = "'state:' || state", "'screen:' || screen", "'owner:' || owner", "'route:' || route", "'network:' || network"
SLOW, DNS, CON = "'symptom:network_slow'", "'phase:DNS'", "'phase:connect'"
GRAPH = ["g AS (SELECT s.*, " + S + " AS base, screen, owner, route, network, coalesce(p.dns, 0) AS dns, coalesce(p.connect, 0) AS connect FROM states s LEFT JOIN samples USING (run_set, bucket) LEFT JOIN (SELECT run_set, bucket, count(nullif(dns_ms, 0)) AS dns, count(nullif(connect_ms, 0)) AS connect FROM calls_in GROUP BY ALL) p USING (run_set, bucket))",
         "one_way AS (" + " UNION ALL ".join([
             _edge(ST, SYMPTOM, "state-symptom", "base"), _edge(SC, ST, "screen-state", "base"), _edge(OW, ST, "owner-state", "base"), _edge(SC, OW, "screen-owner", "base * 0.8::DOUBLE"), _edge(RO, ST, "route-state", "base"), _edge(OW, RO, "owner-route", "base + 0.5::DOUBLE"),
             _edge(RO, "'phase:HTTP'", "route-phase", "base", "http > 0"), _edge(RO, DNS, "route-phase", "base + dns * 0.3::DOUBLE", "dns > 0"), _edge(DNS, SLOW, "phase-symptom", "base + 0.5::DOUBLE", "dns > 0 AND route IS NOT NULL"), _edge(RO, CON, "route-phase", "base + connect * 0.3::DOUBLE", "connect > 0"),
             _edge(CON, SLOW, "phase-symptom", "base + 0.5::DOUBLE", "connect > 0 AND route IS NOT NULL"), _edge(RO, SLOW, "route-symptom", "base + http_failed", "http_failed > 0"), _edge(NE, ST, "network-state", "base * 0.7::DOUBLE")]) + ")",
         """edges AS (SELECT run_set, "from", "to", kind, CAST(sum(n) AS BIGINT) AS count, least(1, sum(s) / 6) AS confidence, 1 / least(1, sum(s) / 6) AS weight FROM (
  SELECT run_set, a AS "from", b AS "to", kind, 1 AS n, greatest(0.1, s) AS s FROM one_way UNION ALL SELECT run_set, b, a, kind, 1, greatest(0.1, s) FROM one_way) WHERE "from" <> "to" GROUP BY ALL)"""]
CAUSAL = [*STATES, SAMPLES, *GRAPH]


def contributions(spark, d) -> DataFrame:
    s = model(spark, d).join(samples(bucketed(spark, d)), ["run_set", "bucket"], "left").fillna("", ["route", "owner", "screen", "network"])
    return causal.contributions(s)


def graph(spark, d) -> DataFrame:
    return causal.edges(contributions(spark, d))


@query("g01_edge_contributions", sql(*CAUSAL, body="SELECT run_set, kind, count(*) AS n, round(sum(s), 4) AS strength FROM one_way GROUP BY ALL"))
def g01(spark, d):
    return contributions(spark, d).groupBy("run_set", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 4).alias("strength"))


@query("g03_edges", sql(*CAUSAL, body='SELECT run_set, "from", "to", kind, count, round(confidence, 6) AS confidence, round(weight, 6) AS weight FROM edges'))
def g03(spark, d):
    return graph(spark, d).withColumns({c: F.round(c, 6) for c in ("confidence", "weight")})


@query("g04_nodes", sql(*CAUSAL, body="""SELECT DISTINCT run_set, "from" AS node, split_part("from", ':', 1) AS kind FROM edges"""))
def g04(spark, d):
    return causal.nodes(graph(spark, d))


@query("g02_loop_edges")
def g02(spark, d):
    """Edges of the run sets' own loops."""
    return causal.edges(causal.loop_contributions(loops.selected(found_loops(spark, d)))).withColumns({c: F.round(c, 6) for c in ("confidence", "weight")})


@query("g05_explanation_paths")
def g05(spark, d):
    """Symptoms to owners and routes; tests hold the search against brute force."""
    return causal.explanation_paths(graph(spark, d)).withColumns({c: F.round(c, 6) for c in ("cost", "confidence")})


@query("g06_all_paths")
def g06(spark, d):
    return causal.all_paths(graph(spark, d)).withColumns({c: F.round(c, 6) for c in ("cost", "confidence")})


@query("g07_owner_scores", sql(*CAUSAL, body="""
SELECT run_set, owner, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, owner) AS rn FROM (SELECT run_set, substr("from", 7) AS owner, round(sum(confidence), 6) AS score FROM edges WHERE starts_with("from", 'owner:') GROUP BY ALL)) WHERE rn <= 8"""))
def g07(spark, d):
    return causal.owner_scores(graph(spark, d))


@query("g08_graph_compare")
def g08(spark, d):
    e = cut(graph(spark, d), "edges")
    return causal.graph_compare(e, causal.explanation_paths(e), causal.owner_scores(e, loops.selected(found_loops(spark, d)))).withColumns({c: F.round(c, 6) for c in ("baseline", "candidate")})


@query("d06_periodic_report")
def d06(spark, d):
    """Lags, entropy and best peak of each signal with its status; spectra have no SQL here."""
    s = whole_series(spark, d)
    lags, power = periodic.lag_summary(periodic.autocorrelation(s)), periodic.spectrum(s)
    return periodic.report(s, lags, periodic.peaks(power))
