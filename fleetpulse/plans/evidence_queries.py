"""Queries of the L, B, U, Q, S and J families on side data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators import evidence as op
from fleetpulse.operators import inspect, resolve
from fleetpulse.operators import problems as prob
from fleetpulse.plans.inspect_queries import ALL_PROBLEMS, problems
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import CALL_SQL, DEVICE_SQL, RETAINED_SQL, SPAM_SQL, sql

SUSPECTS = """suspects AS (SELECT run_set, class, CASE WHEN holder = 'unknown' THEN owner ELSE holder END AS holder, screen, flow, step, CAST(sum(n) AS BIGINT) AS count, max(age_ms) AS max_age_ms,
  CAST(sum(CASE WHEN evidence = 'confirmed' THEN n ELSE 0 END) AS BIGINT) AS confirmed FROM retained GROUP BY ALL)"""
KIND = """CASE WHEN lower(class) LIKE '%activity%' THEN 'activity' WHEN lower(class) LIKE '%fragment%' THEN 'fragment' WHEN lower(class) LIKE '%view%' THEN 'view' WHEN starts_with(lower(class), 'android.') THEN 'system' ELSE 'user' END"""
MEMORY_SQL = "memory AS (SELECT run_set, max(pss_kb) AS max_pss_kb, count(*) FILTER (low_memory) AS low_memory FROM device GROUP BY run_set)"
#: hs stands for the heap evidence of each suspect; without a dump there is none.
SCORED = f"""hs AS (SELECT run_set, class, holder, screen, flow, step, NULL::BIGINT AS heap_kb, NULL::VARCHAR AS heap_holder, false AS heap_path, NULL::VARCHAR AS chain FROM suspects),
  sized AS (SELECT *, CASE WHEN max_pss_kb > 0 THEN least(full_kb, greatest(max_pss_kb // 3, base)) ELSE full_kb END AS estimate FROM (
    SELECT *, base * greatest(count, 1) * CASE WHEN max_age_ms >= 60000 THEN 3 WHEN max_age_ms >= 30000 THEN 2 ELSE 1 END AS full_kb FROM (
      SELECT *, CASE kind WHEN 'activity' THEN 2048 WHEN 'fragment' THEN 1024 WHEN 'view' THEN 768 WHEN 'system' THEN 128 ELSE 256 END::BIGINT AS base,
        CASE WHEN heap_path THEN 'confirmed_path' WHEN confirmed < count THEN 'time_only' WHEN confirmed > 0 THEN 'after_explicit_gc' WHEN heap_kb IS NOT NULL THEN 'unconfirmed_heap' ELSE 'time_only' END AS evidence,
        starts_with(class, 'android.') AS system, NOT starts_with(class, 'android.') OR contains(coalesce(heap_holder, holder), '.') AS user_owned, regexp_matches(lower(class), 'activity|fragment|view') AS risky FROM (
          SELECT s.*, {KIND} AS kind, m.max_pss_kb, m.low_memory, h.heap_kb, h.heap_holder, h.heap_path, h.chain FROM suspects s LEFT JOIN memory m USING (run_set) JOIN hs h USING (run_set, class, holder, screen, flow, step))))),
  raw_scores AS (SELECT *, (count * 2.0::DOUBLE + max_age_ms / 10000.0::DOUBLE + CASE WHEN max_age_ms >= 60000 THEN 8 WHEN max_age_ms >= 30000 THEN 4 ELSE 0 END + CASE WHEN user_owned THEN 4 ELSE 0 END + CASE WHEN system THEN 3 ELSE 0 END
      + CASE WHEN risky THEN 5 ELSE 0 END + CASE WHEN low_memory > 0 THEN 2 ELSE 0 END + CASE WHEN max_pss_kb >= 524288 THEN 2 ELSE 0 END + CASE WHEN estimate >= 16384 THEN 5 WHEN estimate >= 4096 THEN 2 ELSE 0 END)
      * CASE evidence WHEN 'confirmed_path' THEN 1.0::DOUBLE WHEN 'after_explicit_gc' THEN 0.75::DOUBLE WHEN 'unconfirmed_heap' THEN 0.6::DOUBLE ELSE 0.45::DOUBLE END
      + CASE WHEN heap_path THEN 6 + CASE WHEN retained_kb >= 16384 THEN 4 WHEN retained_kb >= 4096 THEN 2 ELSE 0 END ELSE 0 END AS raw_score FROM (SELECT *, CASE WHEN heap_kb > 0 THEN heap_kb ELSE estimate END AS retained_kb FROM sized)),
  scored AS (SELECT run_set, class, holder, screen, flow, step, count, max_age_ms, confirmed, kind, chain, retained_kb, evidence, round(raw_score, 1) AS score,
    CASE WHEN high AND evidence NOT IN ('time_only', 'unconfirmed_heap') THEN 'high' WHEN high OR medium THEN 'medium' ELSE 'ok' END AS severity FROM (
    SELECT *, raw_score >= 16 OR max_age_ms >= 60000 OR count >= 10 OR retained_kb >= 16384 AS high, raw_score >= 7 OR max_age_ms >= 15000 OR count >= 2 OR retained_kb >= 4096 AS medium FROM raw_scores))"""
LEAKS = [RETAINED_SQL, DEVICE_SQL, SUSPECTS, MEMORY_SQL, SCORED]


def memory(spark, d) -> DataFrame:
    return src.device(spark, d).groupBy("run_set").agg(F.max("pss_kb").alias("max_pss_kb"), F.count_if("low_memory").alias("low_memory"))


def leaks(spark, d) -> DataFrame:
    return op.leak_scores(op.suspects(src.retained(spark, d)), memory(spark, d))


@query("l01_suspects", sql(RETAINED_SQL, SUSPECTS, body="SELECT * FROM suspects"))
def l01(spark, d):
    return op.suspects(src.retained(spark, d))


@query("l03_leak_scores", sql(*LEAKS, body="SELECT * FROM scored"))
def l03(spark, d):
    return leaks(spark, d)


@query("l09_leak_statistics", sql(*LEAKS, body="""
SELECT run_set, count(*) AS suspects, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (evidence = 'confirmed_path') AS heap_confirmed, count(*) FILTER (evidence <> 'confirmed_path') AS runtime_only,
  count(*) FILTER (evidence = 'after_explicit_gc') AS after_explicit_gc, count(*) FILTER (evidence = 'time_only') AS time_only, count(*) FILTER (holder = 'unknown') AS unknown_holder, count(*) FILTER (NOT starts_with(class, 'android.') OR contains(holder, '.')) AS user_owned,
  count(*) FILTER (starts_with(class, 'android.')) AS system_retained, count(DISTINCT class) AS classes, count(DISTINCT holder) AS holders, CAST(sum(count) AS BIGINT) AS objects, CAST(sum(retained_kb) AS BIGINT) AS retained_kb, max(max_age_ms) AS max_age_ms FROM scored GROUP BY run_set"""))
def l09(spark, d):
    return op.leak_statistics(leaks(spark, d))


SAT = "CASE WHEN {v} > 0 THEN least(8.0::DOUBLE, 3.0::DOUBLE * ln(1 + {v}) / ln(1 + {p}.0::DOUBLE)) ELSE 0 END"
STEP = "CASE WHEN {v} >= {h} THEN 3 WHEN {v} >= {m} THEN 2 ELSE 1 END"


def _step(v: str, m: int, h: int) -> str:
    return STEP.format(v=v, m=m, h=h)


CALL_COST = f"{SAT.format(v='count', p=160)} + {SAT.format(v='total_ms', p=2200)} + {SAT.format(v='max_ms', p=500)}"
WINDOW_COST = f"{SAT.format(v='count', p=8)} + {SAT.format(v='max_ms', p=500)}"
STRIP = "regexp_extract({o}, '^(.*)[.]', 1)"
HOLDER_CLASS = "CASE WHEN ends_with(holder, '.run') THEN regexp_extract(holder, '^(.*)[.]', 1) ELSE holder END"
#: The four inputs by context, then every signal.
SIGNALS = f"""pw AS (SELECT run_set, screen, flow, step, owner, kind, CAST(sum(n) AS BIGINT) AS count, CAST(sum(window_ms) AS BIGINT) AS window_ms, max(max_ms) AS max_ms FROM problems GROUP BY ALL),
  sp AS (SELECT run_set, screen, flow, step, owner, log_source, level, CAST(sum(n) AS BIGINT) AS count FROM spam GROUP BY ALL),
  cl AS (SELECT run_set, screen, flow, step, owner, caller, callee, CAST(sum(n) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms, max(dur) AS max_ms FROM calls GROUP BY ALL),
  sig AS (
  SELECT run_set, {STRIP.format(o='owner')} AS class, 'run' AS method, CASE kind WHEN 'http_problem' THEN 'network' WHEN 'ui_jank' THEN 'ui' ELSE 'main_thread' END AS category, kind AS name,
    CASE kind WHEN 'main_thread_stall' THEN {_step('max_ms', 2000, 8000)} WHEN 'ui_jank' THEN {_step('count', 20, 100)} ELSE {_step('max_ms', 700, 1500)} END AS severity, {WINDOW_COST} AS score, count, window_ms AS total_ms, max_ms, screen, flow, step,
    CASE kind WHEN 'http_problem' THEN ['network_duplicates'] WHEN 'main_thread_stall' THEN ['anr_risk'] ELSE [] END AS extra, 0::BIGINT AS retained, 0::BIGINT AS memory_kb FROM pw WHERE kind NOT IN ('retained_object', 'log_spam')
  UNION ALL SELECT run_set, {HOLDER_CLASS}, CASE WHEN ends_with(holder, '.run') THEN 'run' ELSE '' END, 'memory', CASE WHEN evidence = 'confirmed_path' THEN 'confirmed_retention_path' ELSE 'retention_signal' END,
    CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, score, count, 0, max_age_ms, screen, flow, step, CASE WHEN retained_kb >= 4096 THEN ['lifecycle_leak', 'oom_risk'] ELSE ['lifecycle_leak'] END, count, retained_kb FROM scored
  UNION ALL SELECT run_set, {STRIP.format(o='owner')}, 'run', 'logging', 'log_spam', {_step('count', 100, 1000)}, {SAT.format(v='count', p=160)}, count, 0, 0, screen, flow, step, ['log_spam'], 0, 0 FROM sp
  UNION ALL SELECT run_set, {STRIP.format(o='o')}, regexp_extract(o, '([^.]*)$', 1), 'runtime', role, {_step('max_ms', 500, 2000)}, ({CALL_COST}) * w, count, total_ms, max_ms, screen, flow, step,
    CASE WHEN max_ms >= 700 AND regexp_matches(lower(o), 'main|ui|click|render|bind') THEN ['anr_risk'] ELSE [] END, 0, 0
    FROM (SELECT *, unnest([caller, callee]) AS o, unnest(['call_initiator', 'called_work']) AS role, unnest([0.45::DOUBLE, 1.0::DOUBLE]) AS w FROM cl))"""
SIG = [*ALL_PROBLEMS, CALL_SQL, DEVICE_SQL, SUSPECTS, MEMORY_SQL, SCORED, SIGNALS]


def inputs(spark, d) -> dict[str, DataFrame]:
    """What code problems and influence are scored by."""
    return {"windows": inspect.problem_stats(problems(spark, d)), "leaks": leaks(spark, d), "spam": inspect.spam_stats(src.log_spam(spark, d)), "calls": inspect.call_stats(src.calls(spark, d))}


def signals(spark, d):
    return prob.signals(**inputs(spark, d))


NAME = "CASE {s} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'ok' END"


@query("b03_signals", sql(*SIG, body=f"""SELECT run_set, class, method, category, name, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms, max(max_ms) AS max_ms, round(sum(score), 4) AS score,
  {NAME.format(s='max(severity)')} AS severity FROM sig GROUP BY ALL"""))
def b03(spark, d):
    return prob.merged_signals(signals(spark, d))


SETS = "array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} NOT IN ('unknown', '')))[1:{n}], '|')"
REGISTRY = f"""reg AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_set ORDER BY score DESC, class, method) AS INTEGER) AS rank, {NAME.format(s='CASE WHEN score >= 18 THEN 3 WHEN score >= 7 THEN greatest(worst, 2) ELSE worst END')} AS severity FROM (
  SELECT run_set, class, method, round(sum(score), 1) AS score, CAST(sum(count) AS BIGINT) AS count, max(severity) AS worst, array_to_string(list_sort(list_distinct(flatten(list([category] || extra)))), '|') AS categories,
    array_to_string(list_sort(list(DISTINCT name)), '|') AS problems, {SETS.format(c='screen', n=6)} AS screens, {SETS.format(c='flow', n=6)} AS flows, {SETS.format(c='step', n=6)} AS steps,
    CAST(sum(CASE WHEN category IN ('network', 'ui', 'main_thread') THEN count ELSE 0 END) AS BIGINT) AS problem_count, CAST(sum(CASE WHEN category = 'logging' THEN count ELSE 0 END) AS BIGINT) AS log_spam, CAST(sum(retained) AS BIGINT) AS retained,
    CAST(sum(memory_kb) AS BIGINT) AS memory_kb, CAST(sum(CASE WHEN category = 'runtime' THEN count ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN category = 'runtime' THEN total_ms ELSE 0 END) AS BIGINT) AS call_ms, max(max_ms) AS max_ms
  FROM sig GROUP BY run_set, class, method))"""


@query("b04_registry", sql(*SIG, REGISTRY, body="SELECT * EXCLUDE (worst) REPLACE (coalesce(screens, '') AS screens, coalesce(flows, '') AS flows, coalesce(steps, '') AS steps) FROM reg WHERE rank <= 200"))
def b04(spark, d):
    return prob.registry(signals(spark, d))


@query("b07_category_statistics", sql(*SIG, body="""
SELECT run_set, category, count(DISTINCT class || '.' || method) AS places, CAST(sum(n) AS BIGINT) AS count FROM (SELECT run_set, class, method, unnest(list_distinct([category] || extra)) AS category, count AS n FROM sig) GROUP BY ALL"""))
def b07(spark, d):
    each = signals(spark, d).select("run_set", "class", "method", "count", F.explode(F.array_union(F.array("category"), "extra")).alias("category"))
    return each.groupBy("run_set", "category").agg(F.count_distinct(F.concat_ws(".", "class", "method")).alias("places"), F.sum("count").alias("count"))


@query("b07_severity_statistics", sql(*SIG, REGISTRY, body="SELECT run_set, severity, count(*) AS places, max(score) AS max_score FROM reg WHERE rank <= 200 GROUP BY ALL"))
def b07_severity(spark, d):
    return prob.registry(signals(spark, d)).groupBy("run_set", "severity").agg(F.count(F.lit(1)).alias("places"), F.max("score").alias("max_score"))


INFLUENCE = f"""ir AS (
  SELECT run_set, {STRIP.format(o='owner')} AS class, flow, screen, {SAT.format(v='count', p=160)} AS score, 'log_spam' AS reason, 0::BIGINT AS problems, count AS log_spam, 0::BIGINT AS main_ms, 0::BIGINT AS runtime_ms, 0::BIGINT AS retained, 0::BIGINT AS memory_kb FROM sp
  UNION ALL SELECT run_set, {STRIP.format(o='owner')}, flow, screen, {WINDOW_COST}, kind, count, 0, CASE WHEN kind = 'main_thread_stall' THEN window_ms ELSE 0 END, 0, 0, 0 FROM pw WHERE kind NOT IN ('retained_object', 'log_spam')
  UNION ALL SELECT run_set, {HOLDER_CLASS}, flow, screen, score * 0.45::DOUBLE, evidence, 0, 0, 0, 0, count, retained_kb FROM scored
  UNION ALL SELECT run_set, {STRIP.format(o='caller')}, flow, screen, ({SAT.format(v='count', p=220)}) * 0.45::DOUBLE, 'calls', 0, 0, 0, total_ms // 4, 0, 0 FROM cl
  UNION ALL SELECT run_set, {STRIP.format(o='callee')}, flow, screen, {CALL_COST}, 'calls', 0, 0, 0, total_ms, 0, 0 FROM cl),
  infl AS (SELECT *, round(raw, 1) AS score, CASE WHEN round(raw, 1) >= 12 THEN 'high' WHEN round(raw, 1) >= 6 THEN 'medium' ELSE 'ok' END AS severity, 'runtime' AS status FROM (
    SELECT run_set, class, contexts, s + 0.35::DOUBLE * contexts AS raw, problems, log_spam, main_ms, runtime_ms, retained, memory_kb, coalesce(flows, '') AS flows, coalesce(screens, '') AS screens, reasons FROM (
      SELECT run_set, class, sum(score) AS s, count(DISTINCT flow) FILTER (flow <> 'unknown') + count(DISTINCT screen) FILTER (screen <> 'unknown') AS contexts, CAST(sum(problems) AS BIGINT) AS problems, CAST(sum(log_spam) AS BIGINT) AS log_spam, CAST(sum(main_ms) AS BIGINT) AS main_ms,
        CAST(sum(runtime_ms) AS BIGINT) AS runtime_ms, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(memory_kb) AS BIGINT) AS memory_kb, {SETS.format(c='flow', n=4)} AS flows, {SETS.format(c='screen', n=4)} AS screens, array_to_string(list_sort(list(DISTINCT reason))[1:5], '|') AS reasons FROM ir GROUP BY run_set, class)))"""
EDGES = "edges AS (SELECT run_set, regexp_extract(caller, '^(.*)[.]', 1) AS from_class, regexp_extract(callee, '^(.*)[.]', 1) AS to_class, CAST(sum(greatest(n, 1)) AS BIGINT) AS count FROM calls GROUP BY ALL)"
#: A class graph of the build: what is called, and stores and disks below it that no run has seen.
STATIC = """static AS (SELECT run_set, from_class, to_class, CAST(sum(n) AS BIGINT) AS count FROM (SELECT run_set, from_class, to_class, count AS n FROM edges
  UNION ALL SELECT run_set, regexp_extract(callee, '^(.*)[.]', 1), 'com.app.Store' || (k % 4), 1 FROM calls UNION ALL SELECT run_set, 'com.app.Store' || (k % 4), 'com.app.Disk' || (k % 2), 1 FROM calls) GROUP BY ALL)"""
ALL_NODES = """alln AS (SELECT run_set, class, contexts, raw, problems, log_spam, main_ms, runtime_ms, retained, memory_kb, flows, screens, reasons, score, severity, status FROM infl
  UNION ALL SELECT run_set, class, 0, 0.0::DOUBLE, 0, 0, 0, 0, 0, 0, '', '', '', 0.0::DOUBLE, 'ok', 'static_only' FROM (SELECT DISTINCT run_set, unnest([from_class, to_class]) AS class FROM static) s WHERE NOT EXISTS (SELECT 1 FROM infl i WHERE i.run_set = s.run_set AND i.class = s.class))"""
TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, class) AS rank FROM alln WHERE status = 'runtime' OR score > 0)"
#: So many selected classes that some edges are not at one.
SELECTED = 12
TOP_EDGES = f"""ends AS (SELECT *, class IN (SELECT class FROM ranked r WHERE r.run_set = alln.run_set AND r.rank <= {SELECTED}) AS chosen FROM alln),
  weighed AS (SELECT e.run_set, e.from_class, e.to_class, e.count, e.count * greatest(t.raw, f.raw * 0.35::DOUBLE) AS influence, f.status = 'runtime' OR t.status = 'runtime' AS confirmed, CASE WHEN t.status = 'runtime' THEN 2 WHEN f.status = 'runtime' THEN 1 ELSE 0 END AS reason
    FROM static e JOIN ends f ON f.run_set = e.run_set AND f.class = e.from_class JOIN ends t ON t.run_set = e.run_set AND t.class = e.to_class WHERE f.chosen OR t.chosen OR t.status = 'runtime'
    UNION ALL SELECT c.run_set, f.class, t.class, c.count, c.count + c.total_ms / 25.0::DOUBLE + c.max_ms / 5.0::DOUBLE, true, 3 FROM cl c JOIN ends f ON f.run_set = c.run_set AND f.class = {STRIP.format(o='caller')} JOIN ends t ON t.run_set = c.run_set AND t.class = {STRIP.format(o='callee')} WHERE f.chosen OR t.chosen),
  top_edges AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_set ORDER BY influence DESC, count DESC, from_class, to_class) AS INTEGER) AS rank FROM (
    SELECT run_set, from_class, to_class, CAST(sum(count) AS BIGINT) AS count, round(sum(influence), 4) AS influence, bool_or(confirmed) AS confirmed, ['static', 'near_symptoms', 'calls_symptoms', 'called_in_run'][max(reason) + 1] AS reason FROM weighed GROUP BY ALL) QUALIFY rank <= 120)"""
GRAPH = [EDGES, STATIC, INFLUENCE, ALL_NODES, TOP, TOP_EDGES]


def class_graph(spark, d) -> DataFrame:
    """The calls' class edges and two levels below them."""
    c, k = src.calls(spark, d), F.col("k")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"), F.lit(".run"))
    more = c.select("run_set", F.col("callee").alias("caller"), name("com.app.Store", 4).alias("callee"), F.lit(1).alias("n")).unionByName(c.select("run_set", name("com.app.Store", 4).alias("caller"), name("com.app.Disk", 2).alias("callee"), F.lit(1).alias("n")))
    return op.class_edges(c.select("run_set", "caller", "callee", "n").unionByName(more))


def influence(spark, d, static=None):
    return prob.influence(**inputs(spark, d), static=static)


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """(nodes, top edges) of the influence graph."""
    static = class_graph(spark, d)
    nodes = influence(spark, d, static)
    return nodes, prob.influence_edges(static, inspect.call_stats(src.calls(spark, d)), nodes, prob.top_nodes(nodes, SELECTED))


@query("u01_influence", sql(*SIG, EDGES, STATIC, INFLUENCE, ALL_NODES, body="SELECT * REPLACE (round(raw, 4) AS raw) FROM alln"))
def u01(spark, d):
    return influence(spark, d, class_graph(spark, d)).withColumn("raw", F.round("raw", 4))


@query("u05_class_edges", sql(CALL_SQL, EDGES, body="SELECT * FROM edges"))
def u05(spark, d):
    return op.class_edges(src.calls(spark, d))


@query("u04_influence_edges", sql(*SIG, *GRAPH, body="SELECT * FROM top_edges"))
def u04(spark, d):
    return graph(spark, d)[1]


@query("u10_shown_nodes", sql(*SIG, *GRAPH, body="""
SELECT run_set, class, CAST(row_number() OVER (PARTITION BY run_set ORDER BY seat) AS INTEGER) AS place, score, status FROM (SELECT run_set, class, min(seat) AS seat FROM (SELECT run_set, class, rank AS seat FROM ranked WHERE rank <= 60
  UNION ALL SELECT run_set, unnest([from_class, to_class]), rank * 2 + unnest([1000, 1001]) FROM top_edges) GROUP BY ALL) JOIN alln USING (run_set, class) QUALIFY place <= 80"""))
def u10_nodes(spark, d):
    return prob.shown_nodes(*graph(spark, d)).select("run_set", "class", "place", "score", "status")


@query("u09_hotspots", sql(*SIG, INFLUENCE, """mg AS (SELECT run_set, regexp_extract(caller, '^(.*)[.]', 1) AS from_class, regexp_extract(caller, '([^.]*)$', 1) AS from_method, regexp_extract(callee, '^(.*)[.]', 1) AS to_class, regexp_extract(callee, '([^.]*)$', 1) AS to_method, CAST(sum(greatest(n, 1)) AS BIGINT) AS count FROM calls GROUP BY ALL)""", body="""
SELECT run_set, class, method, role, CAST(sum(count) AS BIGINT) AS calls, round(sum(w), 1) AS heat FROM (
  SELECT m.run_set, unnest([from_class, to_class]) AS class, unnest([from_method, to_method]) AS method, unnest(['caller', 'callee']) AS role, count, unnest([ln(1 + count) * (1 + coalesce(f.raw, 0)), ln(1 + count) * (1 + coalesce(t.raw, 0))]) AS w
  FROM mg m LEFT JOIN infl f ON f.run_set = m.run_set AND f.class = m.from_class LEFT JOIN infl t ON t.run_set = m.run_set AND t.class = m.to_class) GROUP BY run_set, class, method, role
QUALIFY row_number() OVER (PARTITION BY run_set ORDER BY heat DESC, class, method, role) <= 12"""))
def u09(spark, d):
    from fleetpulse.operators.sidedata import method_graph

    return prob.method_hotspots(method_graph(src.calls(spark, d)), influence(spark, d))


SEGMENTS = """segments AS (SELECT 's' || user_id AS session_id, run_set, k AS segment_index, 'com.app' || CASE WHEN user_id % 17 = 0 THEN k % 2 ELSE 0 END AS process_name, 'ns' || CASE WHEN user_id % 23 = 0 THEN k % 3 ELSE 0 END AS namespace,
  min(time_ms) AS start_ms, bool_and(dur % 9 <> 0) AS sealed, CAST(sum(dur) AS BIGINT) AS accepted, CAST(sum(dur) - sum(k % 3) AS BIGINT) AS written FROM tel GROUP BY ALL)"""


def segments(spark, d) -> DataFrame:
    """A log's segments: a user's session, one segment for each value of k."""
    u, k = F.col("user_id"), F.col("k")
    return src.events(spark, d).groupBy(
        F.concat(F.lit("s"), u.cast("string")).alias("session_id"), "run_set", k.alias("segment_index"), F.concat(F.lit("com.app"), F.when(u % 17 == 0, k % 2).otherwise(0).cast("string")).alias("process_name"),
        F.concat(F.lit("ns"), F.when(u % 23 == 0, k % 3).otherwise(0).cast("string")).alias("namespace")).agg(
        F.min("time_ms").alias("start_ms"), F.bool_and(F.col("dur") % 9 != 0).alias("sealed"), F.sum("dur").alias("accepted"), (F.sum("dur") - F.sum(k % 3)).alias("written"))


@query("q01_chain_conflicts", sql(SEGMENTS, body="""
SELECT session_id, unnest(list_filter([CASE WHEN p > 1 THEN 'process_name_conflict' END, CASE WHEN ns > 1 THEN 'namespace_conflict' END, CASE WHEN n > i THEN 'duplicate_index' END], lambda x: x IS NOT NULL)) AS issue FROM (
  SELECT session_id, count(DISTINCT process_name) AS p, count(DISTINCT namespace) AS ns, count(*) AS n, count(DISTINCT segment_index) AS i FROM segments GROUP BY session_id)"""))
def q01(spark, d):
    return op.chain_conflicts(segments(spark, d))


CHAIN_GAPS = sql(SEGMENTS, body="""
SELECT run_set, session_id, segment_index, unnest(list_filter([CASE WHEN p IS NULL AND segment_index <> 0 THEN 'late_start' END, CASE WHEN segment_index > p + 1 THEN 'gap' END, CASE WHEN start_ms < t THEN 'backwards' END, CASE WHEN NOT s THEN 'after_unsealed' END], lambda x: x IS NOT NULL)) AS issue FROM (
  SELECT *, lag(segment_index) OVER w AS p, lag(start_ms) OVER w AS t, lag(sealed) OVER w AS s FROM segments WINDOW w AS (PARTITION BY run_set, session_id ORDER BY segment_index))""")


@query("q02_chain_gaps", CHAIN_GAPS)
def q02(spark, d):
    return op.chain_gaps(segments(spark, d), "run_set")


@query("q04_quality_totals", sql(SEGMENTS, body="""
SELECT run_set, unnest(['accepted', 'written']) AS counter, unnest([a, w]) AS value FROM (SELECT run_set, CAST(sum(a) AS BIGINT) AS a, CAST(sum(w) AS BIGINT) AS w FROM (
  SELECT run_set, session_id, arg_max(accepted, segment_index) AS a, arg_max(written, segment_index) AS w FROM segments GROUP BY ALL) GROUP BY run_set)"""))
def q04(spark, d):
    snaps = segments(spark, d).select("run_set", "session_id", "segment_index", F.col("segment_index").alias("sequence"), F.create_map(F.lit("accepted"), "accepted", F.lit("written"), "written").alias("counters"))
    return op.latest_snapshots(snaps)


@query("q05_collection_quality", sql(SEGMENTS, body="""
SELECT run_set, CASE WHEN heavy OR issues > 0 THEN 'low' WHEN lost > 0 OR unsealed > 0 THEN 'medium' ELSE 'high' END AS level,
  concat_ws('|', CASE WHEN heavy THEN 'heavy_loss' WHEN lost > 0 THEN 'some_loss' END, CASE WHEN unsealed > 0 THEN 'unsealed_segments' END, CASE WHEN issues > 0 THEN 'chain_issues' END) AS reasons, round(pct, 6) AS lost_pct FROM (
  SELECT *, lost >= 100 OR pct >= 1 AS heavy FROM (SELECT run_set, sum(accepted - written) AS lost, sum(accepted - written) * 100.0::DOUBLE / sum(accepted) AS pct, count(*) FILTER (NOT sealed) AS unsealed, 0 AS issues FROM segments GROUP BY run_set))"""))
def q05(spark, d):
    t = segments(spark, d).groupBy("run_set").agg(F.sum("accepted").alias("accepted"), F.sum(F.col("accepted") - F.col("written")).alias("lost"), F.count_if(~F.col("sealed")).alias("unsealed"), F.lit(0).alias("issues"))
    return op.collection_quality(t)


@query("s14_latest_session", sql(SEGMENTS, body="""
SELECT process_name, session_id, day, ix FROM (SELECT *, rank() OVER (PARTITION BY process_name ORDER BY day DESC, ix DESC) AS r FROM (
  SELECT process_name, session_id, strftime(epoch_ms(max(start_ms)), '%Y-%m-%d') AS day, max(segment_index) AS ix FROM segments GROUP BY ALL)) WHERE r = 1"""))
def s14(spark, d):
    day = F.date_format(F.timestamp_millis(F.max("start_ms")), "yyyy-MM-dd")
    logs = segments(spark, d).groupBy("process_name", "session_id").agg(day.alias("day"), F.max("segment_index").alias("ix"))
    return resolve.latest_sessions(logs)


@query("s15_overlap", sql(body="SELECT DISTINCT source FROM ctx WHERE run_set = 'baseline' INTERSECT SELECT source FROM ctx WHERE run_set = 'candidate'"))
def s15(spark, d):
    return resolve.overlap(src.events(spark, d), "source")


DICT_SQL = """dict AS (SELECT source, ord, k % 10 AS id, 'name' || dur AS value FROM ctx WHERE type = 'memory')"""


def dictionary(spark, d) -> DataFrame:
    return src.of_type(spark, d, "memory").select("source", "ord", (F.col("k") % 10).alias("id"), F.concat(F.lit("name"), F.col("dur").cast("string")).alias("value"))


@query("j01_symbols_as_of", sql(DICT_SQL, "refs AS (SELECT source, ord, k % 10 AS id FROM ctx WHERE type = 'call')", body="""
SELECT r.source, r.ord, r.id, coalesce(d.value, 'id:' || r.id) AS symbol FROM refs r ASOF LEFT JOIN dict d ON r.source = d.source AND r.id = d.id AND r.ord >= d.ord"""))
def j01(spark, d):
    refs = src.of_type(spark, d, "call").select("source", "ord", (F.col("k") % 10).alias("id"))
    return resolve.symbols_as_of(refs, dictionary(spark, d))


MAPPING = [("com.app.Owner1", "a.Feed"), ("com.app.Owner", "a.Any"), ("com.app", "b"), ("com.app.Service3.go", "c.Exact")]
MAP_SQL = "mapping AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MAPPING) + ") t(obfuscated, original))"


@query("j05_deobfuscation", sql(CALL_SQL, MAP_SQL, body="""
SELECT v.value, coalesce(arg_max(original || substr(v.value, length(obfuscated) + 1), length(obfuscated)), v.value) AS plain, n FROM (SELECT value, count(*) AS n FROM (SELECT unnest([caller, callee]) AS value FROM calls) GROUP BY value) v
LEFT JOIN mapping ON v.value = obfuscated OR (starts_with(v.value, obfuscated) AND substr(v.value, length(obfuscated) + 1, 1) IN ('.', '$', '#', ' ', '(', '[', ':')) GROUP BY v.value, n"""))
def j05(spark, d):
    c = src.calls(spark, d)
    values = c.select(F.explode(F.array("caller", "callee")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return resolve.deobfuscate(values, "value", spark.createDataFrame(MAPPING, "obfuscated string, original string"))


PLAIN = """coalesce((SELECT arg_max(original || substr({v}, length(obfuscated) + 1), length(obfuscated)) FROM mapping WHERE {v} = obfuscated OR (starts_with({v}, obfuscated) AND substr({v}, length(obfuscated) + 1, 1) IN ('.', '$', '#', ' ', '(', '[', ':'))), {v})"""


@query("j06_plain_class_graph", sql(CALL_SQL, EDGES, MAP_SQL, body=f"""
SELECT run_set, from_class, to_class, CAST(sum(count) AS BIGINT) AS count FROM (SELECT run_set, {PLAIN.format(v='from_class')} AS from_class, {PLAIN.format(v='to_class')} AS to_class, count FROM edges) WHERE from_class <> to_class GROUP BY ALL"""))
def j06(spark, d):
    return resolve.plain_class_graph(op.class_edges(src.calls(spark, d)), spark.createDataFrame(MAPPING, "obfuscated string, original string"))


STALLS = sql(body="""
SELECT source, user_id, beat AS start_ms, nxt - beat AS duration_ms FROM (SELECT source, user_id, time_ms AS beat, lead(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, ord) AS nxt FROM ctx) WHERE nxt - beat >= 700""")


@query("w09_stall_episodes", STALLS)
def w09(spark, d):
    """The reference's 700 ms; a user's events are one process's heartbeats."""
    w = Window.partitionBy("user_id").orderBy("time_ms", "ord")
    b = src.events(spark, d).select("source", "user_id", F.col("time_ms").alias("start_ms"), (F.lead("time_ms").over(w) - F.col("time_ms")).alias("duration_ms"))
    return b.filter(F.col("duration_ms") >= 700)


@query("w13_context_changes", sql(body="""
SELECT source, ord, screen, flow, step FROM (SELECT *, lag(screen || '|' || flow || '|' || step) OVER (PARTITION BY source ORDER BY ord) AS p FROM ctx) WHERE p IS DISTINCT FROM screen || '|' || flow || '|' || step"""))
def w13(spark, d):
    now = F.struct("screen", "flow", "step")
    before = F.lag(now).over(Window.partitionBy("source").orderBy("ord"))
    rows = src.events(spark, d).withColumn("changed", before.isNull() | ~before.eqNullSafe(now))
    return rows.filter("changed").select("source", "ord", "screen", "flow", "step")


@query("w17_counter_rates", sql(DEVICE_SQL, body="""
SELECT source, ord, greatest(0, rx - p) AS grown, round(greatest(0, rx - p) * 1000.0::DOUBLE / greatest(1, time_ms - t), 6) AS per_second FROM (
  SELECT *, lag(rx) OVER w AS p, lag(time_ms) OVER w AS t FROM device WINDOW w AS (PARTITION BY source ORDER BY ord)) WHERE p IS NOT NULL"""))
def w17(spark, d):
    w = Window.partitionBy("source").orderBy("ord")
    rows = src.device(spark, d).select("source", "ord", "rx", "time_ms", F.lag("rx").over(w).alias("p"), F.lag("time_ms").over(w).alias("t")).filter("p is not null")
    grown = F.greatest(F.lit(0), F.col("rx") - F.col("p"))
    return rows.select("source", "ord", grown.alias("grown"), F.round(grown * 1000.0 / F.greatest(F.lit(1), F.col("time_ms") - F.col("t")), 6).alias("per_second"))


@query("w04_log_windows", sql(SPAM_SQL, body="SELECT source, log_source, level, time_ms // 5000 AS window_ix, CAST(sum(n) AS BIGINT) AS n FROM spam GROUP BY ALL"))
def w04(spark, d):
    return src.log_spam(spark, d).groupBy("source", "log_source", "level", F.expr("time_ms div 5000").alias("window_ix")).agg(F.sum("n").alias("n"))
