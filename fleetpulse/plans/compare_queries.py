"""Queries of the compare and gate family."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import compare as op
from fleetpulse.operators import inspect as ins
from fleetpulse.plans.inspect_queries import ALL_PROBLEMS, FLOW_VIEWS, HTTP, ROUTES, flows, problems
from fleetpulse.plans.evidence_queries import SEGMENTS, q05
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import DEVICE_SQL, RETAINED_SQL, STALL_SQL, UI_SQL, sql

LATENCY = """CASE WHEN b = 0 AND c > 0 THEN CASE WHEN c >= 1000 THEN 'high' ELSE 'medium' END WHEN c <= b THEN 'ok'
  WHEN c - b >= 500 OR (c - b) * 100.0::DOUBLE / b >= 50 THEN 'high' WHEN c - b >= 100 OR (c - b) * 100.0::DOUBLE / b >= 15 THEN 'medium' ELSE 'ok' END"""


def both(table: str, keys: str, values: list[str]) -> str:
    """Both sides of a statistics table as SQL, by a full outer join."""
    on = " AND ".join(f"b.{k} = c.{k}" for k in keys.split(", "))
    out = ", ".join(f"coalesce(b.{k}, c.{k}) AS {k}" for k in keys.split(", "))
    cols = ", ".join(f"coalesce({s}.{v}, 0) AS {s}_{v}" for v in values for s in "bc")
    return f"SELECT {out}, {cols} FROM (SELECT * FROM {table} WHERE run_set = 'baseline') b FULL JOIN (SELECT * FROM {table} WHERE run_set = 'candidate') c ON {on}"


@query("j12_route_compare", sql(f"routes AS ({ROUTES})", body=f"""
SELECT * EXCLUDE (b, c), {LATENCY} AS severity FROM (SELECT *, c_p95_ms - b_p95_ms AS delta_p95_ms, b_p95_ms AS b, c_p95_ms AS c FROM ({both('routes', 'route', ['count', 'failures', 'p95_ms'])}))"""))
def j12(spark, d):
    return op.route_compare(ins.route_stats(src.of_type(spark, d, "http")))


SCREENS = """screens AS (SELECT run_set, screen, CAST(sum(frames) AS BIGINT) AS frames, round(sum(jank) * 100.0::DOUBLE / sum(frames), 6) AS jank_pct,
  round(sum(frames) * 1000.0::DOUBLE / sum(window_ms), 6) AS avg_fps, max(p95_ms) AS max_p95_ms FROM ui GROUP BY ALL)"""


@query("j13_screen_compare", sql(UI_SQL, SCREENS, body=f"""
SELECT *, CASE WHEN delta_jank_pct >= 3 OR delta_fps <= -5 THEN 'high' WHEN delta_jank_pct >= 1 OR delta_fps <= -2 THEN 'medium' ELSE 'ok' END AS severity FROM (
  SELECT *, round(c_jank_pct - b_jank_pct, 6) AS delta_jank_pct, round(c_avg_fps - b_avg_fps, 6) AS delta_fps FROM ({both('screens', 'screen', ['frames', 'jank_pct', 'avg_fps', 'max_p95_ms'])}))"""))
def j13(spark, d):
    return op.screen_compare(ins.screen_stats(src.ui_windows(spark, d)))


OWNERS = f"""owners AS (SELECT run_set, owner, kind, CAST(sum(n) AS BIGINT) AS count, CAST(sum(v) AS BIGINT) AS total_ms, max(v) AS max_ms FROM (
  SELECT run_set, owner, 'http' AS kind, dur AS v, 1 AS n FROM ctx WHERE {HTTP} UNION ALL SELECT run_set, owner, 'main_thread_stall', dur, 1 FROM stalls
  UNION ALL SELECT run_set, class, 'retained_object', age_ms, n FROM retained) GROUP BY ALL)"""


@query("j14_owner_compare", sql(STALL_SQL, RETAINED_SQL, OWNERS, body=f"""
SELECT * EXCLUDE (b, c), {LATENCY} AS severity FROM (SELECT *, c_count - b_count AS delta_count, c_max_ms - b_max_ms AS delta_max_ms, b_max_ms AS b, c_max_ms AS c
  FROM ({both('owners', 'owner, kind', ['count', 'total_ms', 'max_ms'])}))"""))
def j14(spark, d):
    return op.owner_compare(ins.owner_stats(src.of_type(spark, d, "http"), src.stalls(spark, d), src.retained(spark, d)))


@query("j15_flow_compare", sql(*FLOW_VIEWS, "rated AS (SELECT *, CASE WHEN frames > 0 THEN jank * 100.0::DOUBLE / frames ELSE 0 END AS jank_pct FROM flows)", body=f"""
SELECT screen, flow, step, owner, p AS delta_problems, s AS delta_spam, h AS delta_http_p95_ms, st AS delta_stall, round(j, 6) AS delta_jank_pct,
  CASE WHEN p >= 10 OR st >= 500 OR h >= 500 OR j >= 3 THEN 'high' WHEN p > 0 OR s >= 50 OR st >= 100 OR h >= 100 OR j >= 1 THEN 'medium' ELSE 'ok' END AS severity FROM (
  SELECT *, c_problems - b_problems AS p, c_spam - b_spam AS s, c_http_p95_ms - b_http_p95_ms AS h, c_stall - b_stall AS st, c_jank_pct - b_jank_pct AS j
  FROM ({both('rated', 'screen, flow, step, owner', ['problems', 'spam', 'http_p95_ms', 'stall', 'jank_pct'])}))"""))
def j15(spark, d):
    return op.flow_compare(flows(spark, d))


SUMMARY = f"""summary AS (SELECT * FROM (SELECT run_set, count(*) AS events FROM tel GROUP BY run_set)
  LEFT JOIN (SELECT run_set, quantile_disc(dur, 0.95) AS http_p95_ms, count(*) FILTER (failed) AS http_failed, count(*) AS n_http FROM ctx WHERE {HTTP} GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, sum(jank) * 100.0::DOUBLE / sum(frames) AS ui_jank_pct, sum(frames) * 1000.0::DOUBLE / sum(window_ms) AS ui_avg_fps, sum(frames) AS n_ui FROM ui GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, max(dur) AS stall_max_ms, count(*) AS n_stall FROM stalls GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, max(pss_kb) AS max_pss_kb, min(nullif(ram_kb, 0)) AS min_ram_kb, count(*) AS n_device FROM device GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, sum(CASE WHEN l_rx >= f_rx THEN l_rx - f_rx ELSE l_rx END) AS rx_bytes, sum(CASE WHEN l_tx >= f_tx THEN l_tx - f_tx ELSE l_tx END) AS tx_bytes FROM (
    SELECT run_set, source, arg_min(rx, ord) AS f_rx, arg_max(rx, ord) AS l_rx, arg_min(tx, ord) AS f_tx, arg_max(tx, ord) AS l_tx FROM device GROUP BY ALL) GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, sum(n) AS retained FROM retained GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, sum(n) AS log_spam, count(*) AS n_spam FROM spam GROUP BY run_set) USING (run_set)
  LEFT JOIN (SELECT run_set, sum(n) AS problems, count(*) AS n_problems FROM problems GROUP BY run_set) USING (run_set))"""
#: Metric, sample size, and the case for an effect.
METRIC_ROWS = [("http_p95_ms", "n_http", 1, 0), ("http_failed", "n_http", 1, 0), ("ui_jank_pct", "n_ui", 1, 1), ("ui_avg_fps", "n_ui", -1, 1), ("stall_max_ms", "n_stall", 1, 0), ("max_pss_kb", "n_device", 1, 0),
               ("min_ram_kb", "n_device", -1, 0), ("rx_bytes", "n_device", 1, 0), ("tx_bytes", "n_device", 1, 0), ("retained", "retained", 1, 0), ("log_spam", "n_spam", 1, 0), ("problems", "n_problems", 1, 0)]
LONG = "long AS (" + " UNION ALL ".join(f"SELECT run_set, '{m}' AS metric, {w} AS worse, {r} AS rate, {m}::DOUBLE AS v, {n}::BIGINT AS n FROM summary" for m, n, w, r in METRIC_ROWS) + ")"
DELTAS = """deltas AS (
  SELECT metric, round(b, 6) AS baseline, round(c, 6) AS candidate, round(pct, 6) AS change_pct,
    round(CASE WHEN rate = 0 AND b = 0 AND c > 0 THEN CASE WHEN worse = 1 THEN c ELSE 0 END WHEN (c - b) * worse > 0 THEN abs(c - b) ELSE 0 END, 6) AS regression_abs,
    round(CASE WHEN rate = 0 AND b = 0 AND c > 0 THEN CASE WHEN worse = 1 THEN 100 ELSE 0 END WHEN (c - b) * worse > 0 THEN abs(pct) ELSE 0 END, 6) AS regression_pct, sample_size,
    CASE WHEN rate = 0 AND b = 0 AND c > 0 THEN CASE WHEN worse = 1 THEN 'medium' ELSE 'ok' END
      WHEN rate = 1 AND worse = 1 THEN CASE WHEN c - b >= 3 THEN 'high' WHEN c - b >= 1 THEN 'medium' ELSE 'ok' END
      WHEN rate = 1 THEN CASE WHEN b - c >= 5 THEN 'high' WHEN b - c >= 2 THEN 'medium' ELSE 'ok' END
      WHEN b = 0 THEN 'ok' WHEN pct * worse >= 25 THEN 'high' WHEN pct * worse >= 10 THEN 'medium' ELSE 'ok' END AS effect
  FROM (SELECT *, CASE WHEN b <> 0 THEN (c - b) * 100.0::DOUBLE / b ELSE 0 END AS pct FROM (
    SELECT metric, worse, rate, coalesce(max(v) FILTER (run_set = 'baseline'), 0) AS b, coalesce(max(v) FILTER (run_set = 'candidate'), 0) AS c,
      least(coalesce(max(n) FILTER (run_set = 'baseline'), 0), coalesce(max(n) FILTER (run_set = 'candidate'), 0)) AS sample_size FROM long GROUP BY metric, worse, rate)))"""
QUALITY = """quality AS (SELECT run_set, CASE WHEN heavy THEN 'low' WHEN lost > 0 OR unsealed > 0 THEN 'medium' ELSE 'high' END AS level, concat_ws('|', CASE WHEN heavy THEN 'heavy_loss' WHEN lost > 0 THEN 'some_loss' END, CASE WHEN unsealed > 0 THEN 'unsealed_segments' END) AS reasons FROM (
  SELECT *, lost >= 100 OR pct >= 1 AS heavy FROM (SELECT run_set, sum(accepted - written) AS lost, sum(accepted - written) * 100.0::DOUBLE / sum(accepted) AS pct, count(*) FILTER (NOT sealed) AS unsealed FROM segments GROUP BY run_set)))"""
CONF = """conf AS (SELECT CASE least(CASE WHEN logs >= 5 AND n >= 500 THEN 3 WHEN logs >= 2 AND n >= 80 THEN 2 ELSE 1 END, (SELECT min(CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FROM quality)) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT min(logs) AS logs, min(n) AS n FROM (SELECT run_set, count(DISTINCT source) AS logs, count(*) AS n FROM tel GROUP BY run_set)))"""
ADJUSTED = "adjusted AS (SELECT *, CASE WHEN effect = 'high' AND (confidence = 'low' OR sample_size < 3) THEN 'medium' ELSE effect END AS severity FROM deltas, conf)"
MIX = """mix AS (SELECT dimension, CASE WHEN baseline IS NOT DISTINCT FROM candidate THEN 'ok' ELSE 'medium' END AS severity FROM (SELECT dimension, max(summary) FILTER (run_set = 'baseline') AS baseline, max(summary) FILTER (run_set = 'candidate') AS candidate FROM (
    SELECT run_set, dimension, string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) AS summary FROM (SELECT run_set, 'network' AS dimension, network AS value, count(*) AS n FROM device GROUP BY ALL UNION ALL SELECT run_set, 'source', source, count(*) FROM tel GROUP BY ALL) GROUP BY ALL) GROUP BY dimension))"""
DELTA_VIEWS = [*ALL_PROBLEMS, DEVICE_SQL, SUMMARY, LONG, DELTAS, SEGMENTS, QUALITY, CONF, ADJUSTED]


def summary(spark, d):
    """One row per run set: all signals of one scan by conditional aggregates, with traffic and problems beside them; what
    a run set lacks is null, never a reason to drop it."""
    w, k, on = src.wide(spark, d), F.col("k"), lambda t: F.col("type") == t
    call, n = on("call"), lambda c: F.count_if(c)
    of = lambda c, v: F.when(c, v)
    kept, spam, stall = of(call & (k % 3 == 0), 1 + k % 3), of(on("ui") & (k % 2 == 0), 20 + F.col("dur") % 60), F.col("stall_ms")
    frames = F.sum("frames")
    one = w.groupBy("run_set").agg(
        F.count(F.lit(1)).alias("events"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY case when type = 'http' then dur end)").alias("http_p95_ms"), n(on("http") & F.col("failed")).alias("http_failed"),
        *[n(on("http")).alias(f"n_{m}") for m in ("http_p95_ms", "http_failed")], (F.sum("jank") * 100.0 / frames).alias("ui_jank_pct"), (frames * 1000.0 / (n(on("ui")) * 1000)).alias("ui_avg_fps"),
        *[frames.alias(f"n_{m}") for m in ("ui_jank_pct", "ui_avg_fps")], F.max(stall).alias("stall_max_ms"), F.count(stall).alias("n_stall_max_ms"),
        F.max("pss_kb").alias("max_pss_kb"), F.min(of(F.col("ram_kb") != 0, F.col("ram_kb"))).alias("min_ram_kb"), n(on("memory") & (k % 17 == 0)).alias("low_memory"),
        *[n(on("memory")).alias(f"n_{m}") for m in ("max_pss_kb", "min_ram_kb", "rx_bytes", "tx_bytes")], F.sum(kept).alias("retained"), F.sum(kept).alias("n_retained"), F.sum(spam).alias("log_spam"), F.count(spam).alias("n_log_spam"))
    bad = problems(spark, d).groupBy("run_set").agg(F.sum("n").alias("problems"), F.count(F.lit(1)).alias("n_problems"))
    return one.join(ins.traffic(src.device(spark, d)), "run_set", "left").join(bad, "run_set", "left")


def adjusted(spark, d):
    return op.adjusted(op.metric_deltas(summary(spark, d)), op.comparison_confidence(ins.run_totals(src.events(spark, d)), q05(spark, d)))


@query("v01_metric_deltas", sql(*DELTA_VIEWS, body="SELECT * FROM adjusted"))
def v01(spark, d):
    return adjusted(spark, d)


LIMITS = [("*", "medium", None, None), ("http_p95_ms", None, 5.0, 1.0), ("ui_jank_pct", "ok", 0.01, 0.0), ("problems", "ok", 10.0, 0.5), ("max_pss_kb", None, 1.0, None)]
LIMIT_SQL = "limits AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in LIMITS) + ") t(metric, max_severity, max_abs, max_pct))"
RANK = "CASE {} WHEN 'ok' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END"


@query("v06_threshold_gate", sql(*DELTA_VIEWS, LIMIT_SQL, "j AS (SELECT a.*, l.max_abs, l.max_pct, coalesce(l.max_severity, g.max_severity) AS lim FROM adjusted a LEFT JOIN limits l ON l.metric = a.metric, (SELECT max_severity FROM limits WHERE metric = '*') g)", body=f"""
SELECT metric, severity, regression_abs, regression_pct, 'severity' AS rule FROM j WHERE lim IS NOT NULL AND {RANK.format('severity')} > {RANK.format('lim')}
UNION ALL SELECT metric, severity, regression_abs, regression_pct, 'regression_abs' FROM j WHERE max_abs > 0 AND regression_abs > max_abs
UNION ALL SELECT metric, severity, regression_abs, regression_pct, 'regression_pct' FROM j WHERE max_pct > 0 AND regression_pct > max_pct"""))
def v06(spark, d):
    limits = spark.createDataFrame(LIMITS, "metric string, max_severity string, max_abs double, max_pct double")
    return op.gate(adjusted(spark, d), limits)


@query("v02_mix_deltas", sql(DEVICE_SQL, body="""
SELECT dimension, baseline, candidate, CASE WHEN baseline IS NOT DISTINCT FROM candidate THEN 'ok' ELSE 'medium' END AS severity FROM (
  SELECT dimension, max(summary) FILTER (run_set = 'baseline') AS baseline, max(summary) FILTER (run_set = 'candidate') AS candidate FROM (
    SELECT run_set, dimension, string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) AS summary FROM (
      SELECT run_set, 'network' AS dimension, network AS value, count(*) AS n FROM device GROUP BY ALL UNION ALL SELECT run_set, 'source', source, count(*) FROM tel GROUP BY ALL) GROUP BY ALL) GROUP BY dimension)"""))
def v02(spark, d):
    net = ins.mix(src.device(spark, d), "network").withColumn("dimension", F.lit("network"))
    logs = ins.mix(src.events(spark, d), "source").withColumn("dimension", F.lit("source"))
    return op.mix_deltas(net.unionByName(logs))


@query("v06_comparison_gate", sql(*DELTA_VIEWS, MIX, body="""
SELECT 'cohort_mismatch' AS rule, dimension AS value FROM mix WHERE severity <> 'ok' UNION ALL SELECT DISTINCT 'confidence', confidence FROM adjusted WHERE confidence <> 'high'"""))
def v06_comparison(spark, d):
    return op.comparison_gate(adjusted(spark, d), v02(spark, d).filter("severity <> 'ok'"), "high", True)
