"""Queries of the A, P, J07 and T families."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import flags, text
from fleetpulse.operators import inspect as op
from fleetpulse.operators import sketch
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import CALL_SQL, DEVICE_SQL, METRIC_SQL, RETAINED_SQL, SPAM_SQL, STALL_SQL, UI_SQL, sql

HTTP = "type = 'http'"


@query("a01_run_totals", sql(body="""
SELECT run_set, CAST(sum(n) AS BIGINT) AS events, count(*) AS logs, CAST(sum(span) AS BIGINT) AS duration_ms
FROM (SELECT run_set, source, count(*) AS n, max(time_ms) - min(time_ms) AS span FROM tel GROUP BY ALL) GROUP BY run_set"""))
def a01(spark, d):
    return op.run_totals(src.events(spark, d))


@query("a02_http_totals", sql(body=f"""
SELECT run_set, count(*) AS http_count, count(*) FILTER (failed) AS http_failed, quantile_disc(dur, 0.95) AS http_p95_ms FROM ctx WHERE {HTTP} GROUP BY run_set"""))
def a02(spark, d):
    return op.http_totals(src.of_type(spark, d, "http"))


ROUTES = f"""SELECT run_set, route, count(*) AS count, count(*) FILTER (failed) AS failures, quantile_disc(dur, 0.5) AS p50_ms, quantile_disc(dur, 0.95) AS p95_ms,
  max(dur) AS max_ms, CAST(sum(dur) // count(*) AS BIGINT) AS avg_ms, arg_min(owner, ord) AS owner_sample FROM ctx WHERE {HTTP} GROUP BY run_set, route"""


@query("a03_route_stats", sql(body=ROUTES))
def a03(spark, d):
    return op.route_stats(src.of_type(spark, d, "http"))


def _ui_sql(by: str, tail: bool) -> str:
    return sql(UI_SQL, body=f"""
SELECT run_set, {by} count(*) AS windows, CAST(sum(window_ms) AS BIGINT) AS window_ms, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(jank) AS BIGINT) AS jank,
  min(frames * 1000.0::DOUBLE / window_ms) AS min_fps, {'max(p95_ms) AS max_p95_ms, max(p99_ms) AS max_p99_ms,' if tail else ''}
  round(sum(jank) * 100.0::DOUBLE / sum(frames), 6) AS jank_pct, round(sum(frames) * 1000.0::DOUBLE / sum(window_ms), 6) AS avg_fps FROM ui GROUP BY ALL""")


@query("a04_screen_stats", _ui_sql("screen,", True))
def a04(spark, d):
    return op.screen_stats(src.ui_windows(spark, d))


@query("a05_ui_totals", _ui_sql("", False))
def a05(spark, d):
    return op.ui_totals(src.ui_windows(spark, d))


@query("a06_owner_stats", sql(STALL_SQL, RETAINED_SQL, body=f"""
SELECT run_set, owner, kind, CAST(sum(n) AS BIGINT) AS count, CAST(sum(v) AS BIGINT) AS total_ms, max(v) AS max_ms, arg_min(stack, ord) AS stack FROM (
  SELECT run_set, owner, 'http' AS kind, dur AS v, 1 AS n, NULL AS stack, ord FROM ctx WHERE {HTTP}
  UNION ALL SELECT run_set, owner, 'main_thread_stall', dur, 1, stack, ord FROM stalls
  UNION ALL SELECT run_set, class, 'retained_object', age_ms, n, NULL, ord FROM retained) GROUP BY run_set, owner, kind"""))
def a06(spark, d):
    return op.owner_stats(src.of_type(spark, d, "http"), src.stalls(spark, d), src.retained(spark, d))


@query("a07_stall_totals", sql(STALL_SQL, body="SELECT run_set, count(*) AS stall_count, max(dur) AS stall_max_ms FROM stalls GROUP BY run_set"))
def a07(spark, d):
    return op.stall_totals(src.stalls(spark, d))


PROBLEM_SQL = f"""problems AS (
  SELECT run_set, source, screen, flow, step, owner, 'http_problem' AS kind, 1::BIGINT AS n, dur AS window_ms, dur AS max_ms FROM ctx WHERE {HTTP} AND (failed OR dur >= 1000)
  UNION ALL SELECT run_set, source, screen, flow, step, owner, 'ui_jank', greatest(jank, 1), window_ms, p95_ms FROM ui WHERE jank > 0 OR p95_ms >= 32
  UNION ALL SELECT run_set, source, screen, flow, step, owner, 'main_thread_stall', 1, dur, dur FROM stalls
  UNION ALL SELECT run_set, source, screen, flow, step, owner, 'retained_object', n, 0, age_ms FROM retained
  UNION ALL SELECT run_set, source, screen, flow, step, owner, 'log_spam', n, 5000, 0 FROM spam WHERE n >= 50)"""
LEGACY_SQL = """legacy AS (
  SELECT run_set, source, screen, flow, step, owner, CASE WHEN k % 2 = 0 THEN 'http_problem' ELSE 'ui_jank' END AS kind, (1 + k % 3)::BIGINT AS n, 5000::BIGINT AS window_ms, dur AS max_ms
  FROM ctx WHERE type = 'memory')"""
ALL_PROBLEMS = [UI_SQL, STALL_SQL, RETAINED_SQL, SPAM_SQL, PROBLEM_SQL]


def problems(spark, d):
    return op.problem_rows(src.of_type(spark, d, "http"), src.ui_windows(spark, d), src.stalls(spark, d), src.retained(spark, d), src.log_spam(spark, d))


def legacy(spark, d):
    return src.of_type(spark, d, "memory").select(
        "run_set", "source", *op.CONTEXT, F.when(F.col("k") % 2 == 0, "http_problem").otherwise("ui_jank").alias("kind"),
        (1 + F.col("k") % 3).cast("bigint").alias("n"), F.lit(5000).cast("bigint").alias("window_ms"), F.col("dur").alias("max_ms"))


STATS = """count(*) AS windows, CAST(sum(n) AS BIGINT) AS count, CAST(sum(window_ms) AS BIGINT) AS window_ms, max(max_ms) AS max_ms"""


@query("a10_problem_stats", sql(*ALL_PROBLEMS, body=f"SELECT run_set, screen, flow, step, owner, kind, {STATS} FROM problems GROUP BY ALL"))
def a10(spark, d):
    return op.problem_stats(problems(spark, d))


@query("j07_problems_with_legacy", sql(*ALL_PROBLEMS, LEGACY_SQL, body=f"""
SELECT run_set, screen, flow, step, owner, kind, {STATS} FROM (
  SELECT * FROM problems UNION ALL SELECT * FROM legacy l WHERE NOT EXISTS (SELECT 1 FROM problems p WHERE p.run_set = l.run_set AND p.source = l.source AND p.screen = l.screen
    AND p.flow = l.flow AND p.step = l.step AND p.owner = l.owner AND p.kind = l.kind)) GROUP BY ALL"""))
def j07(spark, d):
    return op.problem_stats(op.without_legacy(problems(spark, d), legacy(spark, d)))


FLOW_SQL = f"""flows AS (
  SELECT run_set, screen, flow, step, owner, CAST(coalesce(sum(http), 0) AS BIGINT) AS http, CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed, coalesce(quantile_disc(http_ms, 0.95), 0) AS http_p95_ms,
    CAST(coalesce(sum(stall), 0) AS BIGINT) AS stall, CAST(coalesce(sum(windows), 0) AS BIGINT) AS windows, CAST(coalesce(sum(frames), 0) AS BIGINT) AS frames, CAST(coalesce(sum(jank), 0) AS BIGINT) AS jank,
    CAST(coalesce(sum(spam), 0) AS BIGINT) AS spam, CAST(coalesce(sum(problems), 0) AS BIGINT) AS problems, coalesce(max(problem_max), 0) AS problem_max_ms, coalesce(max(pss), 0) AS pss_kb
  FROM (
    SELECT run_set, screen, flow, step, owner, 1 AS http, failed::INT AS failed, dur AS http_ms, NULL::INT AS stall, NULL::INT AS windows, NULL::INT AS frames, NULL::INT AS jank, NULL::BIGINT AS spam, NULL::BIGINT AS problems, NULL::BIGINT AS problem_max, NULL::BIGINT AS pss FROM ctx WHERE {HTTP}
    UNION ALL SELECT run_set, screen, flow, step, owner, NULL, NULL, NULL, NULL, 1, frames, jank, NULL, NULL, NULL, NULL FROM ui
    UNION ALL SELECT run_set, screen, flow, step, owner, NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM stalls
    UNION ALL SELECT run_set, screen, flow, step, owner, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, NULL, NULL, NULL FROM spam
    UNION ALL SELECT run_set, screen, flow, step, owner, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, pss_kb FROM device
    UNION ALL SELECT run_set, screen, flow, step, owner, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, max_ms, NULL FROM problems) GROUP BY run_set, screen, flow, step, owner)"""
FLOW_VIEWS = [*ALL_PROBLEMS, DEVICE_SQL, FLOW_SQL]


def flows(spark, d):
    return op.flow_stats(src.of_type(spark, d, "http"), src.ui_windows(spark, d), src.stalls(spark, d), src.log_spam(spark, d), src.device(spark, d), problems(spark, d))


@query("a08_flow_stats", sql(*FLOW_VIEWS, body="SELECT * FROM flows"))
def a08(spark, d):
    return flows(spark, d)


SCORE = "problems * 10000 + stall * 5000 + jank * 100 + spam * 10 + failed * 500 + http_p95_ms + problem_max_ms"


@query("t02_flow_ranking", sql(*FLOW_VIEWS, body=f"""
SELECT * FROM (SELECT *, {SCORE} AS score, row_number() OVER (PARTITION BY run_set ORDER BY {SCORE} DESC, screen, flow, step, owner) AS rank FROM flows) WHERE rank <= 80"""))
def t02(spark, d):
    scored = flows(spark, d).withColumn("score", op.flow_severity())
    return op.top(scored, 80, F.desc("score"), "screen", "flow", "step", "owner").withColumn("rank", F.col("rank").cast("bigint"))


@query("a09_log_spam", sql(SPAM_SQL, body="""
SELECT run_set, screen, flow, step, owner, log_source, CASE level WHEN 0 THEN 'verbose' WHEN 1 THEN 'debug' WHEN 2 THEN 'info' WHEN 3 THEN 'warn' WHEN 4 THEN 'error' ELSE 'assert' END AS level,
  CAST(sum(n) AS BIGINT) AS count, count(*) AS windows FROM spam GROUP BY ALL"""))
def a09(spark, d):
    return op.spam_stats(src.log_spam(spark, d)).withColumn("level", text.level_name(F.col("level")))


@query("a11_runtime_calls", sql(CALL_SQL, body="""
SELECT run_set, screen, flow, step, owner, caller, callee, CAST(sum(n) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms, max(dur) AS max_ms FROM calls GROUP BY ALL"""))
def a11(spark, d):
    return op.call_stats(src.calls(spark, d))


@query("a12_counters", sql(METRIC_SQL, body="SELECT run_set, name, CAST(sum(v) AS BIGINT) AS value FROM metrics WHERE mode = 'counter' GROUP BY ALL"))
def a12(spark, d):
    return op.counters(src.metrics(spark, d))


@query("a13_gauges", sql(METRIC_SQL, body="""
SELECT run_set, name, mode, CAST(CASE mode WHEN 'average' THEN total // samples WHEN 'boolean' THEN total * 100 // samples ELSE last END AS BIGINT) AS value, max, samples FROM (
  SELECT run_set, name, arg_max(mode, ord) AS mode, arg_max(v, ord) AS last, sum(v * greatest(n, 1)) AS total, CAST(sum(greatest(n, 1)) AS BIGINT) AS samples, max(v) AS max
  FROM metrics WHERE mode <> 'counter' GROUP BY run_set, name)"""))
def a13(spark, d):
    return op.gauges(src.metrics(spark, d))


@query("a14_device_context", sql(DEVICE_SQL, body="""
SELECT run_set, arg_max(battery, ord) AS battery, arg_max(network, ord) AS network, arg_max(ram_kb, ord) AS ram_kb, min(nullif(battery, 0)) AS min_battery, min(nullif(ram_kb, 0)) AS min_ram_kb,
  count(*) FILTER (low_memory) AS low_memory, count(*) AS contexts FROM device GROUP BY run_set"""))
def a14(spark, d):
    return op.device_context(src.device(spark, d))


@query("a15_memory", sql(DEVICE_SQL, body="SELECT run_set, count(*) AS samples, max(pss_kb) AS max_pss_kb FROM device GROUP BY run_set"))
def a15(spark, d):
    return op.memory(src.device(spark, d))


@query("a16_traffic", sql(DEVICE_SQL, body="""
SELECT run_set, CAST(sum(CASE WHEN l_rx >= f_rx THEN l_rx - f_rx ELSE l_rx END) AS BIGINT) AS rx_bytes, CAST(sum(CASE WHEN l_tx >= f_tx THEN l_tx - f_tx ELSE l_tx END) AS BIGINT) AS tx_bytes FROM (
  SELECT run_set, source, arg_min(rx, ord) AS f_rx, arg_max(rx, ord) AS l_rx, arg_min(tx, ord) AS f_tx, arg_max(tx, ord) AS l_tx FROM device GROUP BY ALL) GROUP BY run_set"""))
def a16(spark, d):
    return op.traffic(src.device(spark, d))


@query("a17_retained_by_class", sql(RETAINED_SQL, body="SELECT run_set, class, CAST(sum(n) AS BIGINT) AS count, max(age_ms) AS max_age_ms FROM retained GROUP BY ALL"))
def a17(spark, d):
    return op.retained_by_class(src.retained(spark, d))


@query("a17_retained_by_age", sql(RETAINED_SQL, body="""
SELECT run_set, CASE WHEN age_ms < 10000 THEN '<10s' WHEN age_ms < 30000 THEN '10-30s' WHEN age_ms < 60000 THEN '30-60s' ELSE '>=60s' END AS age, CAST(sum(n) AS BIGINT) AS count FROM retained GROUP BY ALL"""))
def a17_age(spark, d):
    return op.retained_by_age(src.retained(spark, d))


@query("a18_network_mix", sql(DEVICE_SQL, body="SELECT run_set, network AS value, count(*) AS count FROM device GROUP BY ALL"))
def a18(spark, d):
    return op.mix(src.device(spark, d), "network")


@query("a19_cohorts", sql(DEVICE_SQL, body="""
SELECT run_set, coalesce(net, 'unknown') AS network, count(*) AS events FROM (
  SELECT t.run_set, last_value(network IGNORE NULLS) OVER (PARTITION BY t.run_set ORDER BY t.source, t.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS net
  FROM tel t LEFT JOIN device d ON t.ord = d.ord) GROUP BY ALL"""))
def a19(spark, d):
    return op.cohorts(src.events(spark, d), src.device(spark, d))


@query("a20_jankstats", sql(METRIC_SQL, body="SELECT run_set, name, CAST(sum(v) AS BIGINT) AS value FROM metrics WHERE mode = 'counter' AND name LIKE 'jankstats.%' GROUP BY ALL"))
def a20(spark, d):
    return op.counters(src.metrics(spark, d).filter(F.col("name").startswith("jankstats.")))


@query("a21_run_environment", sql(DEVICE_SQL, body="""
SELECT run_set, arg_max(source, ord) AS source, arg_max(network, ord) AS network, arg_max(battery, ord) AS battery, max(ord) AS last_ord FROM device GROUP BY run_set"""))
def a21(spark, d):
    last = F.max_by(F.struct("source", "network", "battery"), "ord").alias("l")
    return src.device(spark, d).groupBy("run_set").agg(last, F.max("ord").alias("last_ord")).select("run_set", "l.source", "l.network", "l.battery", "last_ord")


@query("a22_percentiles", sql(body=f"""
SELECT run_set, source, quantile_disc(dur, 0.5) AS p50, quantile_disc(dur, 0.9) AS p90, quantile_disc(dur, 0.95) AS p95, quantile_disc(dur, 0.99) AS p99, count(*) AS n FROM ctx WHERE {HTTP} GROUP BY ALL"""))
def a22(spark, d):
    from fleetpulse.functions.numbers import nearest_rank

    return src.of_type(spark, d, "http").groupBy("run_set", "source").agg(
        *[nearest_rank("dur", p).alias(n) for n, p in (("p50", .5), ("p90", .9), ("p95", .95), ("p99", .99))], F.count(F.lit(1)).alias("n"))


#: A cap that some routes of the small tables exceed and others don't.
ROUTE_CAP = 40
SAMPLES = f"""d AS (SELECT run_set, screen, dur, md5(source || ':' || ord) AS digest FROM ctx WHERE {HTTP}),
  s AS (SELECT *, row_number() OVER (PARTITION BY run_set, screen ORDER BY digest, dur) AS r, count(*) OVER (PARTITION BY run_set, screen) AS seen, max(dur) OVER (PARTITION BY run_set, screen) AS top FROM d)"""


@query("a22_sampled_percentiles", sql(SAMPLES, body=f"""
SELECT run_set, screen, quantile_disc(dur, 0.5) AS p50, quantile_disc(dur, 0.95) AS p95, any_value(top) AS max, count(*) AS sampled, any_value(seen) AS seen, any_value(seen) > count(*) AS approximate FROM s WHERE r <= {ROUTE_CAP} GROUP BY run_set, screen"""))
def a22_sampled(spark, d):
    by = ["run_set", "screen"]
    return sketch.sampled_percentiles(sketch.sample(src.of_type(spark, d, "http"), by, "dur", ["source", "ord"], ROUTE_CAP), by, {"p50": .5, "p95": .95})


@query("a24_per_log_routes", sql(body=f"""
SELECT source AS run_set, route, count(*) AS count, count(*) FILTER (failed) AS failures, quantile_disc(dur, 0.5) AS p50_ms, quantile_disc(dur, 0.95) AS p95_ms, max(dur) AS max_ms,
  CAST(sum(dur) // count(*) AS BIGINT) AS avg_ms, arg_min(owner, ord) AS owner_sample FROM ctx WHERE {HTTP} GROUP BY source, route"""))
def a24(spark, d):
    return op.route_stats(src.of_type(spark, d, "http").withColumn("run_set", F.col("source")))


@query("a25_size_profile", sql(body="""
SELECT run_set, type, records, bytes, CAST(bytes // records AS BIGINT) AS avg_bytes, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (PARTITION BY run_set), 6) AS share_pct, logs FROM (
  SELECT run_set, type, count(*) AS records, CAST(sum(dur) AS BIGINT) AS bytes, count(DISTINCT source) AS logs FROM tel GROUP BY ALL)"""))
def a25(spark, d):
    return op.size_profile(src.events(spark, d))


@query("p01_context_filter", sql(body=f"""
SELECT run_set, route, count(*) AS count, count(*) FILTER (failed) AS failures FROM ctx WHERE {HTTP} AND contains(lower(route), 'r3') AND contains(lower(owner), 'owner1') GROUP BY ALL"""))
def p01(spark, d):
    http = src.of_type(spark, d, "http").filter((F.instr(F.lower("route"), "r3") > 0) & (F.instr(F.lower("owner"), "owner1") > 0))
    return http.groupBy("run_set", "route").agg(F.count(F.lit(1)).alias("count"), F.count_if("failed").alias("failures"))


@query("p05_context_key", sql(RETAINED_SQL, body="""
SELECT run_set, CASE WHEN holder = 'unknown' THEN CASE WHEN screen = 'unknown' THEN 'unknown' ELSE screen END ELSE holder END AS key, count(*) AS n FROM retained GROUP BY ALL"""))
def p05(spark, d):
    return src.retained(spark, d).groupBy("run_set", text.known(F.col("holder"), F.col("screen")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_flags", sql(body="""
SELECT run_set, count(*) FILTER (k & 1 <> 0) AS failed, count(*) FILTER (k & 2 <> 0) AS slow, count(*) FILTER (k & 4 <> 0) AS classified, count(*) FILTER (k & 8 <> 0) AS tls, count(*) FILTER (k & 3 = 3) AS failed_and_slow FROM ctx GROUP BY run_set"""))
def p07(spark, d):
    on = lambda bit: F.col("k").bitwiseAND(bit) != 0
    return src.events(spark, d).groupBy("run_set").agg(
        F.count_if(on(1)).alias("failed"), F.count_if(on(2)).alias("slow"), F.count_if(on(4)).alias("classified"), F.count_if(on(8)).alias("tls"), F.count_if(on(1) & on(2)).alias("failed_and_slow"))


BITS = "flagged AS (SELECT *, ord * 7919 AS flags FROM ctx)"


def flagged(rows):
    """Flag bits spread over the rows by their number."""
    return rows.withColumn("flags", F.col("ord") * 7919)


@query("p07_flag_bits", sql(BITS, body="SELECT run_set, " + ", ".join(f"count(*) FILTER (flags & {1 << b} <> 0) AS {n}" for n, b in flags.FLAGS.items()) + " FROM flagged GROUP BY run_set"))
def p07_bits(spark, d):
    return flags.with_flags(flagged(src.events(spark, d)).drop("failed")).groupBy("run_set").agg(*[F.count_if(n).alias(n) for n in flags.FLAGS])


@query("p09_classified_problems", sql(UI_SQL, body="""
SELECT run_set, kind, count(*) AS windows, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT run_set, 'http_problem' AS kind, 1 AS n FROM (SELECT *, ord * 7919 AS f FROM ctx WHERE type = 'http') WHERE f & 2 <> 0 OR k % 100 >= 97 OR f & 32768 <> 0 OR (f & 131072 = 0 AND dur >= 1000)
  UNION ALL SELECT run_set, 'ui_jank', greatest(jank, 1) FROM (SELECT *, ord * 7919 AS f FROM ui) WHERE f & 65536 <> 0 OR (f & 262144 = 0 AND (jank > 0 OR p95_ms >= 32))) GROUP BY ALL"""))
def p09(spark, d):
    none = src.stalls(spark, d).limit(0)
    h = flags.with_flags(flagged(src.of_type(spark, d, "http")).withColumn("status", F.when(F.col("k") % 100 >= 97, 503).otherwise(200)), "failed", "slow", "http_classified")
    u = flags.with_flags(flagged(src.ui_windows(spark, d)), "ui_problem", "ui_classified")
    rows = op.problem_rows(h, u, none, none.withColumns({"n": F.lit(0), "age_ms": F.lit(0)}), none.withColumn("n", F.lit(0)))
    return rows.groupBy("run_set", "kind").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("count"))


@query("p06_context_overrides", sql(body="""
SELECT run_set, type, screen, owner, flow, count(*) AS n FROM (SELECT run_set, t AS type, CASE WHEN t IN ('ui', 'retained') AND k % 3 = 0 THEN 'Payload' || (k % 4) ELSE screen END AS screen,
  CASE WHEN t IN ('http', 'retained') AND k % 4 = 0 THEN 'p.Owner' || (k % 3) WHEN t = 'call' THEN 'c.Caller' || (k % 2) ELSE owner END AS owner, CASE WHEN t = 'retained' AND k % 5 = 0 THEN 'pf' ELSE flow END AS flow
  FROM (SELECT *, CASE type WHEN 'memory' THEN 'retained' ELSE type END AS t FROM ctx)) GROUP BY ALL"""))
def p06(spark, d):
    k = F.col("k")
    some = lambda n, v: F.when(k % n == 0, v).otherwise("")
    e = src.events(spark, d).withColumns({"type": F.when(F.col("type") == "memory", "retained").otherwise(F.col("type")), "p_screen": some(3, F.concat(F.lit("Payload"), (k % 4).cast("string"))), "p_owner": some(4, F.concat(F.lit("p.Owner"), (k % 3).cast("string"))),
                                          "p_flow": some(5, F.lit("pf")), "p_step": F.lit(None).cast("string"), "caller": F.concat(F.lit("c.Caller"), (k % 2).cast("string"))})
    return op.with_overrides(e).groupBy("run_set", "type", "screen", "owner", "flow").agg(F.count(F.lit(1)).alias("n"))


@query("p14_owner_parts", sql(body=r"""
SELECT owner, regexp_extract(owner, '^(.+)\.[^.]*$', 1) AS class, regexp_extract(owner, '([^.]*)$', 1) AS method, regexp_extract(owner, '([^.]+\.[^.]+)$', 1) AS short, count(*) AS n FROM ctx GROUP BY ALL"""))
def p14(spark, d):
    o = F.col("owner")
    return src.events(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n")).select("owner", text.class_of_owner(o).alias("class"), text.method_of_owner(o).alias("method"), text.short_name(o).alias("short"), "n")


@query("p18_object_kinds", sql(RETAINED_SQL, body="""
SELECT class, CASE WHEN lower(class) LIKE '%activity%' THEN 'activity' WHEN lower(class) LIKE '%fragment%' THEN 'fragment' WHEN lower(class) LIKE '%view%' THEN 'view' WHEN starts_with(lower(class), 'android.') THEN 'system' ELSE 'user' END AS kind,
  NOT starts_with(class, 'android.') AS app, count(*) AS n FROM retained GROUP BY ALL"""))
def p18(spark, d):
    c = F.col("class")
    return src.retained(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")).select("class", text.object_kind(c).alias("kind"), text.is_app(c).alias("app"), "n")


@query("p22_redacted_urls", r"""
SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '{email}', 'g'),
  '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b', '{uuid}', 'g'), '\b[0-9a-fA-F]{16,}\b', '{hex}', 'g'), '/[0-9]+(/|$)', '/{id}\1', 'g') AS route, count(*) AS n FROM pages GROUP BY ALL""")
def p22(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1)
    return spark.read.parquet(f"{d}/pages.parquet").groupBy(text.redact_route(path).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("f01_f04_order_statistics", sql(body=f"""
SELECT run_set, route, count(*) AS n, median(dur)::DOUBLE AS median, quantile_disc(dur, 0.9) AS p90, min(dur) AS min, max(dur) AS max FROM ctx WHERE {HTTP} GROUP BY ALL"""))
def f01(spark, d):
    from fleetpulse.functions.numbers import nearest_rank

    return src.of_type(spark, d, "http").groupBy("run_set", "route").agg(
        F.count(F.lit(1)).alias("n"), F.median("dur").alias("median"), nearest_rank("dur", 0.9).alias("p90"), F.min("dur").alias("min"), F.max("dur").alias("max"))


@query("f05_saturating_scores", sql(CALL_SQL, body="""
SELECT run_set, caller, callee, count, round(CASE WHEN count > 0 THEN least(8.0, 3.0 * ln(1 + count) / ln(1 + 50.0::DOUBLE)) ELSE 0 END, 6) AS count_score,
  round(CASE WHEN total_ms > 0 THEN least(8.0, 3.0 * ln(1 + total_ms) / ln(1 + 1000.0::DOUBLE)) ELSE 0 END, 6) AS time_score
FROM (SELECT run_set, caller, callee, CAST(sum(n) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms FROM calls GROUP BY ALL)"""))
def f05(spark, d):
    from fleetpulse.functions.numbers import saturating_score

    c = src.calls(spark, d).groupBy("run_set", "caller", "callee").agg(F.sum("n").cast("bigint").alias("count"), F.sum("total_ms").alias("total_ms"))
    return c.select("run_set", "caller", "callee", "count", F.round(saturating_score(F.col("count"), 50), 6).alias("count_score"), F.round(saturating_score(F.col("total_ms"), 1000), 6).alias("time_score"))


@query("t04_bounded_sets", sql(body="""
SELECT run_set, owner, array_to_string(list_sort(list(DISTINCT screen))[1:4], '|') AS screens, array_to_string(list_sort(list(DISTINCT route))[1:6], '|') AS routes FROM ctx GROUP BY ALL"""))
def t04(spark, d):
    first = lambda c, k: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, k), "|")
    return src.events(spark, d).groupBy("run_set", "owner").agg(first("screen", 4).alias("screens"), first("route", 6).alias("routes"))


@query("t01_ranked_routes", sql(body=f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY failures DESC, p95_ms DESC, count DESC, route) AS rank FROM ({ROUTES})) WHERE rank <= 5"""))
def t01(spark, d):
    r = op.top(op.route_stats(src.of_type(spark, d, "http")), 5, F.desc("failures"), F.desc("p95_ms"), F.desc("count"), "route")
    return r.withColumn("rank", F.col("rank").cast("bigint"))


@query("q09_attribution_quality", sql(*FLOW_VIEWS, body="""
SELECT run_set, round(sum(CASE WHEN screen = 'unknown' THEN problems ELSE 0 END) * 100.0::DOUBLE / sum(problems), 6) AS unknown_pct, sum(CASE WHEN screen = 'unknown' THEN problems ELSE 0 END) * 100 >= sum(problems) * 80 AS weak FROM flows GROUP BY run_set"""))
def q09(spark, d):
    unknown = F.sum(F.when(F.col("screen") == "unknown", F.col("problems")).otherwise(0))
    return flows(spark, d).groupBy("run_set").agg(F.round(unknown * 100.0 / F.sum("problems"), 6).alias("unknown_pct"), (unknown * 100 >= F.sum("problems") * 80).alias("weak"))
