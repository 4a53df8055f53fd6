"""Queries of the M, C, I, K and R families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.staging import cut
from fleetpulse.operators import robust as rob
from fleetpulse.operators import timeline as op
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import DEVICE_SQL, METRIC_SQL, PHASES, RETAINED_SQL, STALL_SQL, UI_SQL, WIDE_SQL, sql

SCALE_CASE = "CASE " + " ".join(f"WHEN span // {s * 1000} + 1 <= 50000 THEN {s * 1000}" for s in op.SCALES) + " ELSE CAST(ceil(span / 180000000000.0::DOUBLE) AS BIGINT) * 3600000 END"
REL = ["rel AS (SELECT *, greatest(time_ms - min(time_ms) OVER (PARTITION BY run_set, source), 0) AS rel_ms FROM wide)", f"scale AS (SELECT run_set, span, CAST({SCALE_CASE} AS BIGINT) AS size FROM (SELECT run_set, max(rel_ms) AS span FROM rel GROUP BY run_set))"]
TL = [WIDE_SQL, *REL,
      """prev AS (SELECT *, last_value(rx IGNORE NULLS) OVER w AS p_rx, last_value(tx IGNORE NULLS) OVER w AS p_tx FROM rel WINDOW w AS (PARTITION BY run_set, source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
      """bucketed AS (SELECT p.*, size, rel_ms // size AS bucket, CASE WHEN p_rx IS NULL THEN 0 WHEN rx >= p_rx THEN rx - p_rx ELSE rx END AS d_rx, CASE WHEN p_tx IS NULL THEN 0 WHEN tx >= p_tx THEN tx - p_tx ELSE tx END AS d_tx FROM prev p JOIN scale USING (run_set))""",
      """tl AS (SELECT e.run_set, e.bucket, e.size, coalesce(http, 0) AS http, coalesce(http_failed, 0) AS http_failed, coalesce(http_avg_ms, 0) AS http_avg_ms, coalesce(http_p95_ms, 0) AS http_p95_ms, coalesce(frames, 0) AS frames, coalesce(jank, 0) AS jank,
          coalesce(stalls, 0) AS stalls, coalesce(stall_max_ms, 0) AS stall_max_ms, coalesce(pss_kb, 0) AS pss_kb, coalesce(ram_kb, 0) AS ram_kb, coalesce(rx, 0) AS rx, coalesce(tx, 0) AS tx
        FROM (SELECT run_set, size, unnest(range(0, span // size + 1)) AS bucket FROM scale) e LEFT JOIN (
          SELECT run_set, bucket, count(*) FILTER (type = 'http') AS http, count(*) FILTER (type = 'http' AND failed) AS http_failed, CAST(sum(dur) FILTER (type = 'http') // count(*) FILTER (type = 'http') AS BIGINT) AS http_avg_ms,
            quantile_disc(dur, 0.95) FILTER (type = 'http') AS http_p95_ms, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(jank) AS BIGINT) AS jank, count(stall_ms) AS stalls, max(stall_ms) AS stall_max_ms, max(pss_kb) AS pss_kb,
            min(nullif(ram_kb, 0)) AS ram_kb, CAST(sum(d_rx) AS BIGINT) AS rx, CAST(sum(d_tx) AS BIGINT) AS tx FROM bucketed GROUP BY ALL) s USING (run_set, bucket))"""]


def timeline(spark, d):
    return op.timeline(op.relative(src.wide(spark, d)))


@query("m02_relative_time", sql(*[WIDE_SQL, REL[0]], body="SELECT run_set, source, max(rel_ms) AS span_ms, CAST(sum(rel_ms) AS BIGINT) AS total_ms FROM rel GROUP BY ALL"))
def m02(spark, d):
    return op.relative(src.wide(spark, d)).groupBy("run_set", "source").agg(F.max("rel_ms").alias("span_ms"), F.sum("rel_ms").alias("total_ms"))


@query("m06_timeline", sql(*TL, body="SELECT * FROM tl"))
def m06(spark, d):
    return timeline(spark, d)


@query("m07_top_route", sql(*TL, body="""
SELECT run_set, bucket, arg_min(route, (-n, route)) AS route FROM (SELECT run_set, bucket, route, count(*) AS n FROM bucketed WHERE type = 'http' GROUP BY ALL) GROUP BY ALL"""))
def m07(spark, d):
    rel = op.relative(src.wide(spark, d))
    scale = rel.groupBy("run_set").agg(op.bucket_size(F.max("rel_ms")).alias("size"))
    rows = rel.filter("type = 'http'").join(F.broadcast(scale), "run_set").withColumn("bucket", F.expr("rel_ms div size"))
    return op.top_sample(rows, "route")


@query("m08_series", sql(*TL, "long AS (UNPIVOT (SELECT run_set, bucket, " + ", ".join(f"{s}::BIGINT AS {s}" for s in op.SERIES) + " FROM tl) ON " + ", ".join(op.SERIES) + " INTO NAME signal VALUE value)",
                         "live AS (SELECT run_set, signal FROM long GROUP BY run_set, signal HAVING max(abs(value)) > 0)", body="SELECT run_set, bucket, signal, value FROM long JOIN live USING (run_set, signal)"))
def m08(spark, d):
    return op.series(timeline(spark, d))


def bucketed(spark, d) -> DataFrame:
    """All events with their bucket."""
    rel = op.relative(src.wide(spark, d))
    scale = rel.groupBy("run_set").agg(op.bucket_size(F.max("rel_ms")).alias("size"))
    return rel.join(F.broadcast(scale), "run_set").withColumn("bucket", F.expr("rel_ms div size"))


def http(rows: DataFrame) -> DataFrame:
    return src.phases(rows.filter("type = 'http'"))


HTTP = f"calls_in AS (SELECT *, {PHASES} FROM bucketed WHERE type = 'http')"


#: Eight windows of each run set stand for its loops: the spans of calls that share k % 100 and their share as confidence.
WINDOWS_SQL = """loops AS (SELECT run_set, first_ms, last_ms, confidence, burn FROM (SELECT run_set, count(*) * (1 + (k % 100) / 100.0::DOUBLE) / 50 AS burn, min(bucket) * any_value(size) AS first_ms, (min(bucket) + (max(bucket) - min(bucket)) // 40) * any_value(size) AS last_ms, (k % 100) / 100.0::DOUBLE AS confidence,
  row_number() OVER (PARTITION BY run_set ORDER BY count(*) DESC, k % 100) AS rn FROM bucketed WHERE type = 'http' GROUP BY run_set, k % 100) WHERE rn <= 8)"""
_STATES = ["""floors AS (SELECT t.*, f.pss_floor, coalesce((SELECT max(confidence) FROM loops l WHERE l.run_set = t.run_set AND confidence >= 0.35 AND t.bucket * t.size BETWEEN first_ms AND last_ms), 0) AS loop_confidence, coalesce(p.dns, 0) AS dns, coalesce(p.connect, 0) AS connect, coalesce(p.dns_ms, 0) AS dns_ms, coalesce(p.connect_ms, 0) AS connect_ms
    FROM tl t JOIN (SELECT run_set, coalesce(min(nullif(pss_kb, 0)), 0) AS pss_floor FROM tl GROUP BY run_set) f USING (run_set) LEFT JOIN (SELECT run_set, bucket, count(nullif(dns_ms, 0)) AS dns, count(nullif(connect_ms, 0)) AS connect, CAST(sum(dns_ms) // nullif(count(nullif(dns_ms, 0)), 0) AS BIGINT) AS dns_ms, CAST(sum(connect_ms) // nullif(count(nullif(connect_ms, 0)), 0) AS BIGINT) AS connect_ms FROM calls_in GROUP BY ALL) p USING (run_set, bucket))""",
           """weights AS (SELECT *, CASE WHEN loop_confidence >= 0.35 THEN least(1, greatest(0.05, loop_confidence)) END AS w0, CASE WHEN stalls > 0 THEN least(1, greatest(0.05, 0.65 + stalls * 0.1::DOUBLE + stall_max_ms / 3000.0::DOUBLE)) END AS w1,
    CASE WHEN (pss_floor > 0 AND pss_kb >= pss_floor + 32768) OR (ram_kb > 0 AND ram_kb < 262144) THEN greatest(CASE WHEN pss_floor > 0 AND pss_kb >= pss_floor + 32768 THEN least(1, greatest(0.05, (pss_kb - pss_floor) / 131072.0::DOUBLE)) ELSE 0 END, CASE WHEN ram_kb > 0 AND ram_kb < 262144 THEN least(1, greatest(0.05, (262144 - ram_kb) / 262144.0::DOUBLE)) ELSE 0 END) END AS w2,
    CASE WHEN frames > 0 AND jank * 100.0::DOUBLE / frames >= 5 THEN least(1, greatest(0.05, jank * 100.0::DOUBLE / frames / 20)) END AS w3,
    nullif(greatest(CASE WHEN http_failed > 0 THEN least(1, greatest(0.05, 0.75 + http_failed * 0.1::DOUBLE)) ELSE 0 END, CASE WHEN http > 0 AND http_p95_ms >= 500 THEN least(1, greatest(0.05, (http_p95_ms - 300) / 1000.0::DOUBLE)) ELSE 0 END,
      CASE WHEN dns_ms >= 100 THEN least(1, greatest(0.05, (dns_ms - 50) / 500.0::DOUBLE)) ELSE 0 END, CASE WHEN connect_ms >= 150 THEN least(1, greatest(0.05, (connect_ms - 100) / 700.0::DOUBLE)) ELSE 0 END), 0) AS w4 FROM floors)""",
           """raw AS (SELECT *, CASE WHEN w0 IS NOT NULL THEN 'network_loop' WHEN w1 IS NOT NULL THEN 'stalled' WHEN w2 IS NOT NULL THEN 'memory_pressure' WHEN w3 IS NOT NULL THEN 'janky' WHEN w4 IS NOT NULL THEN 'network_slow' ELSE 'healthy' END AS raw, coalesce(w0, w1, w2, w3, w4, 0) AS weight FROM weights),
  states AS (SELECT *, raw <> 'healthy' AS bad, CASE WHEN raw = 'healthy' AND coalesce(lag(raw <> 'healthy') OVER (PARTITION BY run_set ORDER BY bucket), false) THEN 'recovering' ELSE raw END AS state FROM raw)"""]
STATES = [*TL, HTTP, WINDOWS_SQL, *_STATES]


def windows(rows: DataFrame) -> DataFrame:
    h = rows.filter("type = 'http'").groupBy("run_set", (F.col("k") % 100).alias("m")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    h = h.withColumn("rn", F.expr("row_number() over (partition by run_set order by n desc, m)")).filter("rn <= 8")
    return h.select("run_set", (F.col("a") * F.col("size")).alias("first_ms"), ((F.col("a") + F.expr("(b - a) div 40")) * F.col("size")).alias("last_ms"), (F.col("m") / 100.0).alias("confidence"), (F.col("n") * (1 + F.col("m") / 100.0) / 50).alias("burn"))


def model_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(timeline with phases, loop windows), from one pass over the event table: its rows are staged with their buckets."""
    rows = cut(bucketed(spark, d), "bucketed")
    t = op.timeline(rows.drop("size", "bucket")).join(op.phase_buckets(http(rows)), ["run_set", "bucket"], "left").fillna(0, ["dns", "dns_ms", "connect", "connect_ms", "ttfb_ms"])
    return t, windows(rows)


def model(spark, d) -> DataFrame:
    """States of all buckets, with loop windows and phases."""
    return cut(op.states(*model_inputs(spark, d)), "states")


def load_scores(spark, d) -> DataFrame:
    t, loops = model_inputs(spark, d)
    return op.integrals(op.states(t, loops), loops)


TRANS = """trans AS (SELECT *, round(count / sum(count) OVER (PARTITION BY run_set, from_state), 6) AS probability FROM (
  SELECT run_set, from_state, to_state, count(*) AS count FROM (SELECT run_set, state AS from_state, lead(state) OVER (PARTITION BY run_set ORDER BY bucket) AS to_state FROM states) WHERE to_state IS NOT NULL GROUP BY ALL))"""


@query("k03_states", sql(*STATES, body="SELECT run_set, state, bad, count(*) AS windows, min(bucket) AS first, max(bucket) AS last FROM states GROUP BY ALL"))
def k03(spark, d):
    return model(spark, d).groupBy("run_set", "state", "bad").agg(F.count(F.lit(1)).alias("windows"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))


@query("k04_transitions", sql(*STATES, TRANS, body="SELECT * FROM trans"))
def k04(spark, d):
    return op.transitions(model(spark, d))


@query("k05_recovery", sql(*STATES, TRANS, body="""
SELECT run_set, CAST(sum(CASE WHEN f AND NOT t THEN count ELSE 0 END) AS BIGINT) AS healthy_to_bad, round(CASE WHEN sum(CASE WHEN NOT f THEN count ELSE 0 END) > 0 THEN sum(CASE WHEN NOT f AND t THEN count ELSE 0 END) / sum(CASE WHEN NOT f THEN count ELSE 0 END) ELSE 1 END, 6) AS recovery_probability
FROM (SELECT *, from_state IN ('healthy', 'recovering') AS f, to_state IN ('healthy', 'recovering') AS t FROM trans) GROUP BY run_set"""))
def k05(spark, d):
    return op.transition_summary(op.transitions(model(spark, d)))


@query("k06_episodes", sql(*STATES, body="""
SELECT run_set, count(*) AS episodes, round(coalesce(avg(n) FILTER (e < last), 0), 6) AS recovery_windows, round(coalesce(avg(n * size) FILTER (e < last), 0), 6) AS recovery_ms, max(n) AS longest FROM (
  SELECT run_set, island, count(*) AS n, max(bucket) AS e, max(last) AS last, max(size) AS size FROM (
    SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run_set ORDER BY bucket) AS island, max(bucket) OVER (PARTITION BY run_set) AS last FROM states) WHERE bad GROUP BY run_set, island) GROUP BY run_set"""))
def k06(spark, d):
    return op.episodes(model(spark, d))


@query("k07_exposure", sql(*STATES, body="""
SELECT run_set, state, n AS windows, round(n / total, 6) AS share FROM (SELECT run_set, state, count(*) AS n FROM states WHERE bad GROUP BY ALL) JOIN (SELECT run_set, count(*) AS total FROM states GROUP BY run_set) USING (run_set)"""))
def k07(spark, d):
    return op.exposure(model(spark, d))


@query("k11_divergence", sql(*STATES, TRANS, body="""
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS divergence, count(*) AS pairs FROM (
  SELECT from_state, to_state, coalesce(max(s) FILTER (run_set = 'baseline'), 0) AS p, coalesce(max(s) FILTER (run_set = 'candidate'), 0) AS q FROM (
    SELECT *, count / sum(count) OVER (PARTITION BY run_set) AS s FROM trans) GROUP BY ALL)"""))
def k11(spark, d):
    return op.divergence(op.transitions(model(spark, d)))


AREAS = """areas AS (SELECT a.run_set, jank_pressure_area, latency_pain_area, network_failure_burn + coalesce(burn, 0) AS network_failure_burn, memory_pressure_area, recovery_debt FROM (
  SELECT run_set, sum(CASE WHEN frames > 0 THEN jank * 100.0::DOUBLE / frames ELSE 0 END * dt) AS jank_pressure_area, sum(greatest(http_p95_ms - 300, 0) * dt) AS latency_pain_area, sum((http_failed + 0.25::DOUBLE * dns + 0.25::DOUBLE * connect) * dt) AS network_failure_burn,
    sum((CASE WHEN pss_floor > 0 AND pss_kb > pss_floor THEN pss_kb - pss_floor ELSE 0 END + CASE WHEN ram_kb > 0 AND ram_kb < 262144 THEN 262144 - ram_kb ELSE 0 END) / 1024.0::DOUBLE * dt) AS memory_pressure_area, sum(streak * dt) AS recovery_debt
  FROM (SELECT *, CASE WHEN sore THEN sum(dt) OVER (PARTITION BY run_set, island, sore ORDER BY bucket) ELSE 0 END AS streak FROM (
    SELECT *, sum(CASE WHEN sore THEN 0 ELSE 1 END) OVER (PARTITION BY run_set ORDER BY bucket) AS island FROM (
      SELECT *, size / 1000.0::DOUBLE AS dt, (frames > 0 AND jank * 100.0::DOUBLE / frames >= 5) OR (http > 0 AND http_p95_ms >= 500) OR http_failed > 0 OR (pss_floor > 0 AND pss_kb >= pss_floor + 32768) OR (ram_kb > 0 AND ram_kb < 262144) AS sore FROM states))) GROUP BY run_set) a
  LEFT JOIN (SELECT run_set, sum(burn) AS burn FROM loops GROUP BY run_set) USING (run_set))"""


@query("i06_load_scores", sql(*STATES, AREAS, body=" UNION ALL ".join(
    f"SELECT run_set, '{n}' AS score, round({n}, 4) AS value, CASE WHEN {n} >= {h} THEN 'high' WHEN {n} >= {m} THEN 'medium' ELSE 'ok' END AS severity FROM areas" for n, (m, h) in op.LIMITS.items())))
def i06(spark, d):
    return load_scores(spark, d)


JANK = "CASE WHEN frames > 0 THEN jank * 100.0::DOUBLE / frames ELSE 0 END"
POINTS = f"""points AS (SELECT run_set, 'http_p95_ms' AS signal, bucket, size, http_p95_ms::DOUBLE AS value, 100.0::DOUBLE AS least, 50.0::DOUBLE AS noise FROM tl WHERE http > 0 AND http_p95_ms > 0
  UNION ALL SELECT run_set, 'jank_pct', bucket, size, {JANK}, 5, 2 FROM tl WHERE frames > 0 UNION ALL SELECT run_set, 'pss_kb', bucket, size, pss_kb, 10240, 4096 FROM tl WHERE pss_kb > 0
  UNION ALL SELECT run_set, 'http_failed', bucket, size, http_failed, 2, 1 FROM tl)"""
CANDS = """cands AS (SELECT run_set, signal, bucket, size, before, after, after - before AS delta, abs(after - before) / greatest(noise, (list_sort(list_transform(a, lambda x: abs(x - before)))[2] + list_sort(list_transform(b, lambda x: abs(x - after)))[2]) / 2) AS score, least FROM (
  SELECT *, list_sort(a)[2] AS before, list_sort(b)[2] AS after FROM (SELECT *, list(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS b FROM points WINDOW w AS (PARTITION BY run_set, signal ORDER BY bucket)) WHERE len(a) = 3 AND len(b) = 3)),
  good AS (SELECT run_set, signal, bucket, size, before, after, delta, score FROM cands WHERE abs(delta) >= least AND score >= 3)"""


@query("c02_change_candidates", sql(*TL, POINTS, CANDS, body="SELECT run_set, signal, bucket, size, before, after, delta, round(score, 6) AS score FROM good"))
def c02(spark, d):
    return op.change_candidates(op.signal_points(timeline(spark, d))).withColumn("score", F.round("score", 6))


def picked(n: int = 5) -> list[str]:
    """The greedy choice as five common table expressions."""
    out, left = [], "good"
    for i in range(n):
        out.append(f"best{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_set, signal ORDER BY score DESC, bucket) AS rn FROM {left}) WHERE rn = 1)")
        out.append(f"left{i} AS (SELECT l.* FROM {left} l JOIN best{i} b USING (run_set, signal) WHERE abs(l.bucket - b.bucket) > 3)")
        left = f"left{i}"
    return [*out, "chosen AS (" + " UNION ALL ".join(f"SELECT run_set, signal, bucket, size, before, after, delta, score FROM best{i}" for i in range(n)) + ")"]


def change_points(spark, d):
    return op.change_points(op.change_candidates(op.signal_points(cut(timeline(spark, d), "timeline"))))


@query("c03_change_points", sql(*TL, POINTS, CANDS, *picked(), body="SELECT run_set, signal, bucket, size, before, after, delta, round(score, 6) AS score FROM chosen"))
def c03(spark, d):
    return change_points(spark, d).withColumn("score", F.round("score", 6))


@query("c05_change_compare", sql(*TL, POINTS, CANDS, *picked(), "b AS (SELECT signal, bucket * size AS ms, score FROM chosen WHERE run_set = 'baseline'), c AS (SELECT signal, bucket * size AS ms, score FROM chosen WHERE run_set = 'candidate')", body="""
SELECT signal, ms AS time_ms, CASE WHEN b_score IS NULL THEN 'appeared' ELSE 'strengthened' END AS change, round(score, 6) AS score FROM (
  SELECT c.signal, c.ms, c.score, arg_min(b.score, (abs(b.ms - c.ms), b.ms)) AS b_score FROM c LEFT JOIN b ON b.signal = c.signal AND abs(b.ms - c.ms) <= 2000 GROUP BY ALL) WHERE b_score IS NULL OR score >= b_score + 2
UNION ALL SELECT signal, ms, 'disappeared', round(score, 6) FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE b.signal = c.signal AND abs(b.ms - c.ms) <= 2000)"""))
def c05(spark, d):
    return op.change_compare(change_points(spark, d))


SAMPLES = f"""hp AS (SELECT *, {PHASES} FROM ctx WHERE type = 'http'), samples AS (SELECT run_set, 'Route' AS dimension, route AS name, 'http_ms' AS metric, dur::DOUBLE AS value, 1 AS weight FROM hp
  UNION ALL SELECT run_set, 'Owner', owner, 'http_ms', dur, 1 FROM hp UNION ALL SELECT run_set, 'Route', route, 'dns_ms', dns_ms, 1 FROM hp WHERE dns_ms > 0 UNION ALL SELECT run_set, 'Route', route, 'connect_ms', connect_ms, 1 FROM hp WHERE connect_ms > 0
  UNION ALL SELECT run_set, 'Screen', screen, 'ui_p95_ms', p95_ms, 1 FROM ui WHERE p95_ms > 0 UNION ALL SELECT run_set, 'Screen', screen, 'jank_pct', jank * 100.0::DOUBLE / frames, 1 FROM ui
  UNION ALL SELECT run_set, 'Owner', owner, 'stall_ms', dur, 1 FROM stalls UNION ALL SELECT run_set, 'Owner', class, 'retained_age_ms', age_ms, 1 FROM retained UNION ALL SELECT run_set, 'Memory', 'process', 'pss_kb', pss_kb, 1 FROM device
  UNION ALL SELECT run_set, 'Context', 'device', 'ram_kb', ram_kb, 1 FROM device UNION ALL SELECT run_set, 'Context', 'device', 'battery', battery, 1 FROM device WHERE battery <> 0
  UNION ALL SELECT run_set, 'Gauge', name, 'value', v, CASE WHEN mode IN ('last', 'state') THEN 1 ELSE greatest(n, 1) END FROM metrics WHERE mode <> 'counter')"""
RVIEWS = [UI_SQL, STALL_SQL, RETAINED_SQL, DEVICE_SQL, METRIC_SQL, SAMPLES]


def samples(spark, d):
    return rob.samples(http(src.events(spark, d)), src.ui_windows(spark, d), src.stalls(spark, d), src.metrics(spark, d), src.retained(spark, d), src.device(spark, d))


DIST = """dist AS (SELECT run_set, dimension, name, metric, n, median, p90, p95, p99, mad, round(trimmed, 6) AS trimmed, lo AS min, hi AS max FROM (
  SELECT run_set, dimension, name, metric, count(*) AS n, any_value(m) AS median, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, median(abs(value - m)) AS mad,
    avg(value) FILTER (rn > floor(cnt * 0.1) AND rn <= cnt - floor(cnt * 0.1)) AS trimmed, min(value) AS lo, max(value) AS hi FROM (
      SELECT *, median(value) OVER w AS m, count(*) OVER w AS cnt, row_number() OVER (PARTITION BY run_set, dimension, name, metric ORDER BY value) AS rn FROM samples, unnest(range(0, weight)) WINDOW w AS (PARTITION BY run_set, dimension, name, metric)) GROUP BY ALL))"""


@query("r03_distributions", sql(*RVIEWS, DIST, body="SELECT * FROM dist"))
def r03(spark, d):
    return rob.distributions(samples(spark, d))


CLIFF = """cliff AS (SELECT dimension, name, metric, nb, nc, round(CASE WHEN nb > 0 AND nc > 0 THEN (2 * rc - nc * (nc + 1.0::DOUBLE)) / (nb * nc) - 1 ELSE 0 END, 6) AS delta FROM (
  SELECT dimension, name, metric, CAST(sum(CASE WHEN run_set = 'baseline' THEN weight ELSE 0 END) AS BIGINT) AS nb, CAST(sum(CASE WHEN run_set = 'candidate' THEN weight ELSE 0 END) AS BIGINT) AS nc,
    sum(CASE WHEN run_set = 'candidate' THEN weight * (below + (tied + 1) / 2.0::DOUBLE) ELSE 0 END) AS rc FROM (
      SELECT s.*, sum(weight) OVER (PARTITION BY dimension, name, metric, value) AS tied, sum(weight) OVER (PARTITION BY dimension, name, metric ORDER BY value) - sum(weight) OVER (PARTITION BY dimension, name, metric, value) AS below FROM samples s) GROUP BY ALL))"""


@query("r06_cliffs_delta", sql(*RVIEWS, CLIFF, body="SELECT * FROM cliff"))
def r06(spark, d):
    return rob.cliffs_delta(samples(spark, d))


@query("r08_robust_compare", sql(*RVIEWS, DIST, CLIFF, body="""
SELECT dimension, name, metric, nb, nc, before, after, round(pct, 6) AS delta_pct, delta AS cliff, CASE WHEN abs(delta) >= 0.474 THEN 'large' WHEN abs(delta) >= 0.33 THEN 'medium' WHEN abs(delta) >= 0.147 THEN 'small' ELSE 'negligible' END AS effect, tier,
  CASE WHEN nb = 0 OR nc = 0 THEN 'medium' WHEN tier >= 2 AND pct >= 50 AND delta >= 0.33 THEN 'high' WHEN tier >= 1 AND pct >= 20 AND delta >= 0.147 THEN 'medium' WHEN tier = 0 AND pct >= 80 AND delta >= 0.474 THEN 'medium' ELSE 'ok' END AS severity FROM (
  SELECT *, CASE WHEN least(nb, nc) >= 50 AND abs(delta) >= 0.33 AND abs(pct) >= 20 THEN 2 WHEN least(nb, nc) >= 20 AND abs(delta) >= 0.147 AND abs(pct) >= 10 THEN 1 ELSE 0 END AS tier FROM (
    SELECT c.*, coalesce(p.b, 0) AS before, coalesce(p.c, 0) AS after, CASE WHEN coalesce(p.b, 0) <> 0 THEN (coalesce(p.c, 0) - p.b) * 100.0::DOUBLE / p.b ELSE 0 END AS pct FROM cliff c JOIN (
      SELECT dimension, name, metric, max(p95) FILTER (run_set = 'baseline') AS b, max(p95) FILTER (run_set = 'candidate') AS c FROM dist GROUP BY ALL) p USING (dimension, name, metric)))"""))
def r08(spark, d):
    s = samples(spark, d)
    return rob.robust_compare(rob.distributions(s), rob.cliffs_delta(s))


@query("r04_bootstrap_p95")
def r04(spark, d):
    """Confidence intervals of p95; resampling has no SQL twin, tests check coverage."""
    return rob.bootstrap_p95(samples(spark, d))
