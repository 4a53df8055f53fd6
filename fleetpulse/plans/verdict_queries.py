"""Queries of the V family, J17, J22, U08, L02, W05, W15 and W19."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import text
from fleetpulse.operators import compare
from fleetpulse.operators import evidence as ev
from fleetpulse.operators import inspect as ins
from fleetpulse.operators.leaks import match_confidence
from fleetpulse.operators import timeline as tl
from fleetpulse.operators import verdict as op
from fleetpulse.plans.compare_queries import CONF, DELTA_VIEWS, MIX, QUALITY, adjusted, summary, v02
from fleetpulse.plans.evidence_queries import INFLUENCE, LEAKS, SEGMENTS, SIG, class_graph, influence, leaks, q05, signals
from fleetpulse.plans.inspect_queries import FLOW_VIEWS, HTTP, SCORE, flows
from fleetpulse.plans.leak_queries import DELTAS as LEAK_DELTAS
from fleetpulse.plans.leak_queries import HEAP_LEAKS, MATCH, best, heap_scored
from fleetpulse.plans.timeline_queries import AREAS as AREAS_SQL
from fleetpulse.plans.timeline_queries import CANDS, POINTS, STATES, change_points, load_scores, model, picked
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import CALL_SQL, DEVICE_SQL, UI_SQL, sql

POINT_VIEWS = [POINTS, CANDS, *picked()]

@query("v10_findings", sql(*DELTA_VIEWS, "facts AS (SELECT run_set, events, coalesce(n_http, 0) AS http, coalesce(http_failed, 0) AS http_failed, coalesce(http_p95_ms, 0) AS p95, coalesce(ui_jank_pct, 0) AS jank, coalesce(ui_avg_fps, 0) AS fps, coalesce(stall_max_ms, 0) AS stall, coalesce(low_memory, 0) AS low, coalesce(retained, 0) AS kept FROM summary LEFT JOIN (SELECT run_set, count(*) FILTER (low_memory) AS low_memory FROM device GROUP BY run_set) USING (run_set))",
                           "rows AS (" + " UNION ALL ".join(f"SELECT run_set, '{n}' AS rule, round(({v})::DOUBLE, 6) AS value, {c} AS severity FROM facts" for n, v, c in [
                               ("low_sample", "events", "CASE WHEN events < 50 THEN 'medium' END"),
                               ("http_failures", "CASE WHEN http > 0 THEN http_failed * 100.0::DOUBLE / http ELSE 0 END", "CASE WHEN http > 0 AND http_failed * 100.0::DOUBLE / http >= 10 THEN 'high' WHEN http_failed > 0 THEN 'medium' END"),
                               ("http_p95", "p95", "CASE WHEN p95 >= 1500 THEN 'high' WHEN p95 >= 700 THEN 'medium' END"), ("ui_jank", "jank", "CASE WHEN jank >= 10 THEN 'high' WHEN jank >= 3 THEN 'medium' END"),
                               ("ui_fps", "fps", "CASE WHEN fps > 0 AND fps < 45 THEN 'high' WHEN fps > 0 AND fps < 55 THEN 'medium' END"), ("stall", "stall", "CASE WHEN stall >= 1000 THEN 'high' WHEN stall >= 250 THEN 'medium' END"),
                               ("low_memory", "low", "CASE WHEN low > 0 THEN 'high' END"), ("retained", "kept", "CASE WHEN kept >= 10 THEN 'high' WHEN kept > 0 THEN 'medium' END")]) + ")", body="""
SELECT * FROM rows WHERE severity IS NOT NULL UNION ALL SELECT run_set, 'none', 0.0::DOUBLE, 'ok' FROM facts WHERE run_set NOT IN (SELECT run_set FROM rows WHERE severity IS NOT NULL)"""))
def v10(spark, d):
    s = summary(spark, d).select("run_set", "events", F.col("n_http_failed").alias("http"), "http_failed", "http_p95_ms", "ui_jank_pct", "ui_avg_fps", "stall_max_ms", "low_memory", "retained")
    return op.findings(s.fillna(0))


def quality(spark, d):
    return q05(spark, d).select("run_set", "level", "reasons")


@query("v05_warnings", sql(DEVICE_SQL, SEGMENTS, QUALITY, MIX, body="""
SELECT 'cohort' AS kind, 'both' AS side, dimension AS warning FROM mix WHERE severity <> 'ok' UNION ALL SELECT 'quality', run_set, unnest(string_split(CASE WHEN reasons = '' THEN level ELSE reasons END, '|')) FROM quality WHERE level <> 'high'"""))
def v05(spark, d):
    return op.warnings(v02(spark, d), quality(spark, d))


FACTS = f"""facts AS (SELECT (SELECT confidence FROM conf) AS confidence,
    (SELECT max(level) FROM quality WHERE run_set = 'baseline') AS bq, (SELECT max(level) FROM quality WHERE run_set = 'candidate') AS cq, (SELECT count(*) FROM mix WHERE severity <> 'ok') AS cohorts,
    (SELECT sum(len(string_split(CASE WHEN reasons = '' THEN level ELSE reasons END, '|'))) FROM quality WHERE level <> 'high') AS qw, (SELECT count(DISTINCT source) FROM tel WHERE run_set = 'baseline') AS bl, (SELECT count(DISTINCT source) FROM tel WHERE run_set = 'candidate') AS cl,
    l.*, (SELECT count(*) FROM deltas) AS nd, (SELECT count(*) FROM deltas WHERE ({MATCH}) LIKE 'high%') AS hm, (SELECT count(*) FROM deltas WHERE ({MATCH}) LIKE 'medium%') AS mm FROM (
    SELECT count(*) AS n, count(*) FILTER (s.holder = 'unknown') AS unknown, count(*) FILTER (NOT starts_with(class, 'android.') OR contains(s.holder, '.')) AS own, max(max_age_ms) AS age, count(*) FILTER (evidence = 'confirmed_path') AS heap, count(*) FILTER (evidence = 'confirmed_path' AND b.field <> '') AS field,
      count(*) FILTER (evidence = 'confirmed_path' AND b.alternatives > 0) AS alt FROM scored s LEFT JOIN best b USING (run_set, class, holder, screen, flow, step) WHERE run_set = 'candidate') l)"""
BASE = "CASE confidence WHEN 'high' THEN 9 WHEN 'medium' THEN 7 ELSE 4 END"
CARD = [("data_quality", f"{BASE} - least(2, cohorts * 0.5::DOUBLE) - least(2, coalesce(qw, 0) * 0.5::DOUBLE)", "true", 5),
        ("retained_signal", "4 + (n - unknown)::DOUBLE / n * 3 + own::DOUBLE / n * 2 + CASE WHEN age >= 30000 THEN 1 ELSE 0 END", "n > 0", 5),
        ("heap_actionability", "3 + heap::DOUBLE / n * 3 + field::DOUBLE / n * 1.5::DOUBLE + heap::DOUBLE / n * 1.5::DOUBLE + alt::DOUBLE / n", "n > 0", 5),
        ("compare_stability", f"{BASE} * 0.4::DOUBLE + hm::DOUBLE / nd * 4 + mm::DOUBLE / nd * 2", "nd > 0", 6),
        ("gate_readiness", f"least(10, greatest(0, {BASE} - CASE WHEN cohorts > 0 THEN 2 ELSE 0 END - CASE WHEN qw > 0 THEN 2 ELSE 0 END + CASE WHEN bl >= 5 AND cl >= 5 THEN 1 ELSE 0 END))", "true", 5), ("readability", "3 + 7.0::DOUBLE", "n > 0", 6)]
CARD_SQL = "card AS (" + " UNION ALL ".join(f"SELECT '{a}' AS area, {op.WEIGHTS[a]} AS weight, CASE WHEN {w} THEN round(least(10, greatest(0, ({v})::DOUBLE)), 1) ELSE {idle} END AS score, CASE WHEN NOT ({w}) THEN 'not_exercised' WHEN ({v}) >= 8 THEN 'strong' WHEN ({v}) >= 6 THEN 'needs_work' ELSE 'weak' END AS status FROM facts" for a, v, w, idle in CARD) + ")"


def facts(spark, d):
    """One row: confidence, warnings and leak statistics of the comparison."""
    logs = ins.run_totals(src.events(spark, d))
    side = lambda s, c, f=F.max: f(F.when(F.col("run_set") == s, F.col(c)))
    sample = logs.agg(compare.sample_confidence(logs).alias("sample"), side("baseline", "logs").alias("baseline_logs"), side("candidate", "logs").alias("candidate_logs"))
    q = quality(spark, d)
    named = F.when(F.col("level") == "high", 0).otherwise(F.size(F.split(F.when(F.col("reasons") == "", F.col("level")).otherwise(F.col("reasons")), "[|]")))
    levels = q.agg(side("baseline", "level").alias("baseline_quality"), side("candidate", "level").alias("candidate_quality"), F.sum(named).alias("quality_warnings"))
    rank = lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).otherwise(1)
    worst = F.least(rank("sample"), rank("baseline_quality"), rank("candidate_quality"))
    s, b = heap_scored(spark, d), best(spark, d)
    own = s.filter("run_set = 'candidate'").join(b.select(*ev.SUSPECT, "field", "alternatives"), ev.SUSPECT, "left")
    path = F.col("evidence") == "confirmed_path"
    user = text.is_app(F.col("class")) | text.is_app(F.col("holder"))
    leak = own.agg(F.count(F.lit(1)).alias("leaks"), F.count_if(text.is_unknown(F.col("holder"))).alias("unknown_holder"), F.count_if(user).alias("user_owned"), F.max("max_age_ms").alias("max_age_ms"), F.count_if(path).alias("heap_confirmed"),
                   F.count_if(path & (F.col("field") != "")).alias("with_field"), F.count_if(path).alias("with_path"), F.count_if(path & (F.col("alternatives") > 0)).alias("with_alternatives"), F.count(F.lit(1)).alias("explained"))
    cmp = match_confidence(ev.leak_compare(s))
    moves = cmp.agg(F.count(F.lit(1)).alias("deltas"), F.count_if(F.col("match").startswith("high")).alias("high_match"), F.count_if(F.col("match").startswith("medium")).alias("medium_match"))
    cohorts = v02(spark, d).agg(F.count_if(F.col("severity") != "ok").alias("cohort_warnings"))
    out = sample
    for part in (levels, leak, moves, cohorts):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out.withColumn("confidence", F.when(worst == 3, "high").when(worst == 2, "medium").otherwise("low"))


@query("v09_scorecard", sql(*HEAP_LEAKS, LEAK_DELTAS, SEGMENTS, QUALITY, CONF, MIX, FACTS, CARD_SQL, body="""
SELECT area, weight, score, status, round(whole, 1) AS total, CASE WHEN f.bq = 'low' OR f.cq = 'low' THEN 'blocked' WHEN whole >= 8 AND f.confidence <> 'low' AND f.cohorts = 0 AND coalesce(f.qw, 0) = 0 THEN 'go' WHEN whole >= 6 THEN 'qa_only' ELSE 'blocked' END AS decision,
  concat_ws('|', CASE WHEN f.bq <> 'high' THEN 'resolve_baseline_quality' END, CASE WHEN f.cq <> 'high' THEN 'resolve_candidate_quality' END, CASE WHEN f.cohorts > 0 THEN 'align_cohorts' END, CASE WHEN f.n > f.heap AND f.heap = 0 THEN 'collect_heap_evidence' END) AS next_actions FROM card, (SELECT sum(score * weight) / sum(weight) AS whole FROM card), facts f"""))
def v09(spark, d):
    return op.scorecard(facts(spark, d))


@query("v11_compare_verdict", sql(*DELTA_VIEWS, MIX, body="""
SELECT * FROM (SELECT 'regression:' || metric AS finding, severity FROM adjusted WHERE severity IN ('high', 'medium') UNION ALL SELECT 'cohort:' || dimension, 'medium' FROM mix WHERE severity <> 'ok'
  UNION ALL SELECT 'no_regression', 'ok' WHERE NOT EXISTS (SELECT 1 FROM adjusted WHERE severity IN ('high', 'medium'))),
  (SELECT CASE coalesce(max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END), 0) WHEN 2 THEN 'investigate_first' WHEN 1 THEN 'review_and_repeat' ELSE 'keep_report' END AS advice FROM adjusted)"""))
def v11(spark, d):
    return op.compare_verdict(adjusted(spark, d), v02(spark, d).filter("severity <> 'ok'"))


@query("v12_section_statuses", sql(*STATES, AREAS_SQL, *POINT_VIEWS, "sections AS (" + " UNION ALL ".join(
    f"SELECT run_set, 'integrals' AS section, '{n}' AS name, CASE WHEN {n} >= {h} THEN 'high' WHEN {n} >= {m} THEN 'medium' ELSE 'ok' END AS severity, round({n}, 4) AS score FROM areas" for n, (m, h) in tl.LIMITS.items()) +
    " UNION ALL SELECT run_set, 'changes', signal || '@' || bucket, CASE WHEN delta <= 0 THEN 'ok' WHEN score >= 6 THEN 'high' ELSE 'medium' END, round(score, 6) FROM chosen)", body="""
SELECT run_set, section, CASE max(r) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'ok' END AS status, count(*) FILTER (r > 1) AS findings, arg_max(name, (r, score, name)) AS top FROM (SELECT *, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r FROM sections) GROUP BY ALL"""))
def v12(spark, d):
    one = load_scores(spark, d).select("run_set", F.lit("integrals").alias("section"), F.col("score").alias("name"), "severity", F.col("value").alias("score"))
    points = change_points(spark, d)
    severity = F.when(F.col("delta") <= 0, "ok").when(F.col("score") >= 6, "high").otherwise("medium")
    two = points.select("run_set", F.lit("changes").alias("section"), F.concat_ws("@", "signal", F.col("bucket").cast("string")).alias("name"), severity.alias("severity"), F.round("score", 6).alias("score"))
    return op.section_statuses(one.unionByName(two))


@query("v13_significant_buckets", sql(*STATES, body="SELECT run_set, bucket, state FROM states WHERE state <> 'healthy' AND (http > 0 OR http_failed > 0 OR frames > 0 OR jank > 0 OR stalls > 0 OR pss_kb > 0 OR rx > 0 OR tx > 0)"))
def v13(spark, d):
    return op.significant(model(spark, d)).select("run_set", "bucket", "state")


@query("v14_deltas_by_area", sql(*DELTA_VIEWS, body="SELECT area, count(*) AS metrics, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, arg_max(metric, (regression_pct, metric)) AS worst FROM (SELECT *, CASE " + " ".join(
    f"WHEN metric IN ({', '.join(repr(m) for m in ms)}) THEN '{a}'" for a, ms in op.AREAS.items()) + " ELSE 'other' END AS area FROM adjusted) GROUP BY area"))
def v14(spark, d):
    return op.deltas_by_area(adjusted(spark, d))


@query("v15_problem_flow", sql(*FLOW_VIEWS, body=f"SELECT run_set, screen, flow, step, owner, score FROM (SELECT *, {SCORE} AS score, row_number() OVER (PARTITION BY run_set ORDER BY {SCORE} DESC, screen DESC, flow DESC, step DESC, owner DESC) AS rn FROM flows) WHERE rn = 1"))
def v15(spark, d):
    return op.problem_flow(flows(spark, d), ins.flow_severity())


@query("j17_candidate_leaks", sql(*LEAKS, body="""
SELECT fingerprint, score, delta, change FROM (SELECT *, row_number() OVER (ORDER BY score DESC, fingerprint) AS rn FROM (
  SELECT c.fingerprint, c.score, round(c.score - coalesce(b.score, 0), 4) AS delta, CASE WHEN b.score IS NULL THEN 'new' WHEN c.score - b.score >= 8 THEN 'high' WHEN c.score - b.score >= 3 THEN 'up' WHEN c.score - b.score <= -3 THEN 'better' ELSE 'same' END AS change FROM (
    SELECT lower(concat_ws('|', class, holder, screen, flow, step)) AS fingerprint, score FROM scored WHERE run_set = 'candidate') c LEFT JOIN (
    SELECT lower(concat_ws('|', class, holder, screen, flow, step)) AS fingerprint, score FROM scored WHERE run_set = 'baseline') b USING (fingerprint))) WHERE rn <= 80"""))
def j17(spark, d):
    s = leaks(spark, d).withColumn("fingerprint", ev.leak_fingerprint())
    c = s.filter("run_set = 'candidate'").select("fingerprint", "score")
    b = s.filter("run_set = 'baseline'").select("fingerprint", F.col("score").alias("before"))
    delta = F.col("score") - F.col("before")
    change = F.when(F.col("before").isNull(), "new").when(delta >= 8, "high").when(delta >= 3, "up").when(delta <= -3, "better").otherwise("same")
    return c.join(b, "fingerprint", "left").select("fingerprint", "score", F.round(F.col("score") - F.coalesce("before", F.lit(0.0)), 4).alias("delta"), change.alias("change")).orderBy(F.desc("score"), "fingerprint").limit(80)


@query("j22_points_in_ranges", sql("ranges AS (SELECT run_set, min(time_ms) AS first, max(time_ms) AS last, (k % 100) / 100.0::DOUBLE AS confidence FROM ctx WHERE type = 'memory' GROUP BY run_set, user_id, k % 4, k % 100)", body=f"""
SELECT c.run_set, c.time_ms AS at, max(confidence) AS confidence FROM (SELECT DISTINCT run_set, time_ms FROM ctx WHERE {HTTP}) c JOIN ranges r ON r.run_set = c.run_set AND c.time_ms BETWEEN r.first AND r.last AND confidence >= 0.35 GROUP BY ALL"""))
def j22(spark, d):
    m = src.of_type(spark, d, "memory")
    ranges = m.groupBy("run_set", "user_id", (F.col("k") % 4).alias("a"), (F.col("k") % 100).alias("b")).agg(F.min("time_ms").alias("first"), F.max("time_ms").alias("last"))
    ranges = ranges.select("run_set", "first", "last", (F.col("b") / 100.0).alias("confidence"))
    return op.within(src.of_type(spark, d, "http").select("run_set", F.col("time_ms").alias("at")).distinct(), ranges)


#: Services call back: a third level, so that paths have several edges.
EDGES2 = """edges AS (SELECT run_set, from_class, to_class, CAST(sum(n) AS BIGINT) AS count FROM (SELECT run_set, regexp_extract(caller, '^(.*)[.]', 1) AS from_class, regexp_extract(callee, '^(.*)[.]', 1) AS to_class, greatest(n, 1) AS n FROM calls
  UNION ALL SELECT run_set, regexp_extract(callee, '^(.*)[.]', 1), 'com.app.Store' || (k % 4), 1 FROM calls UNION ALL SELECT run_set, 'com.app.Store' || (k % 4), 'com.app.Disk' || (k % 2), 1 FROM calls) GROUP BY ALL)"""
NODES = "scored_nodes AS (SELECT run_set, class, score, class IN (SELECT class FROM sig WHERE category <> 'runtime') AS runtime FROM infl UNION ALL SELECT DISTINCT run_set, 'com.app.Disk' || (k % 2), 0.0::DOUBLE, true FROM calls)"
LEVEL = """p{d} AS (SELECT run_set, source, hop, arg_max(path, (s, path)) AS path, max(s) AS s FROM (SELECT p.run_set, p.source, e.to_class AS hop, list_append(p.path, e.to_class) AS path, p.s + ln(1 + e.count) AS s FROM p{b} p JOIN edges e ON e.run_set = p.run_set AND e.from_class = p.hop
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.run_set = p.run_set AND x.source = p.source AND x.hop = e.to_class)) GROUP BY ALL)"""
LEVELS = [LEVEL.format(d=i, b=i - 1, seen=" UNION ALL ".join(f"SELECT run_set, source, hop FROM p{j}" for j in range(i))) for i in range(1, 5)]


@query("u08_hot_paths", sql(*SIG, INFLUENCE, EDGES2, NODES, """p0 AS (SELECT run_set, class AS source, class AS hop, [class] AS path, 0.0::DOUBLE AS s FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, class) AS rank FROM scored_nodes n WHERE score > 0 AND EXISTS (SELECT 1 FROM edges e WHERE e.run_set = n.run_set AND e.from_class = n.class)) WHERE rank <= 80)""",
                            *LEVELS, body="""
SELECT run_set, source, target, depth, path, weight, runtime FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY weight DESC, path) AS rn FROM (
  SELECT p.run_set, source, hop AS target, depth, array_to_string(path, '>') AS path, round(CASE WHEN s = 0 THEN 1 ELSE s END / sqrt(depth) * (1 + 0.25::DOUBLE * f.score + 0.75::DOUBLE * t.score) * CASE WHEN t.runtime THEN 1.35::DOUBLE ELSE 1 END, 4) AS weight, t.runtime AS runtime
  FROM (""" + " UNION ALL ".join(f"SELECT *, {i} AS depth FROM p{i}" for i in range(1, 5)) + """) p JOIN scored_nodes f ON f.run_set = p.run_set AND f.class = p.source JOIN scored_nodes t ON t.run_set = p.run_set AND t.class = p.hop WHERE t.runtime OR t.score > 0)) WHERE rn <= 8"""))
def u08(spark, d):
    edges, k = class_graph(spark, d), F.col("k")
    hot = signals(spark, d).filter("category <> 'runtime'").select("class").distinct().withColumn("runtime", F.lit(True))
    nodes = influence(spark, d).select("run_set", "class", "score").join(hot, "class", "left").select("run_set", "class", "score", F.coalesce("runtime", F.lit(False)).alias("runtime"))
    disks = src.calls(spark, d).select("run_set", F.concat(F.lit("com.app.Disk"), (k % 2).cast("string")).alias("class"), F.lit(0.0).alias("score"), F.lit(True).alias("runtime")).distinct()
    nodes = nodes.unionByName(disks)
    return op.hot_paths(edges, nodes)


@query("l02_retained_by_kind", sql(*LEAKS, body="SELECT run_set, kind, count(*) AS suspects, CAST(sum(retained_kb) AS BIGINT) AS retained_kb, max(score) AS max_score FROM scored GROUP BY ALL"))
def l02(spark, d):
    return leaks(spark, d).groupBy("run_set", "kind").agg(F.count(F.lit(1)).alias("suspects"), F.sum("retained_kb").alias("retained_kb"), F.max("score").alias("max_score"))


@query("w05_call_edges_by_window", sql(CALL_SQL, body="SELECT source, time_ms // 5000 AS window_ix, caller, callee, CAST(sum(n) AS BIGINT) AS count, CAST(sum(total_ms) AS BIGINT) AS total_ms, max(dur) AS max_ms FROM calls GROUP BY ALL"))
def w05(spark, d):
    return src.calls(spark, d).groupBy("source", F.expr("time_ms div 5000").alias("window_ix"), "caller", "callee").agg(F.sum("n").cast("bigint").alias("count"), F.sum("total_ms").alias("total_ms"), F.max("dur").alias("max_ms"))


@query("w15_screen_transitions", sql(UI_SQL, body="""
SELECT from_screen, to_screen, count(*) AS n, CAST(sum(gap) AS BIGINT) AS gap_ms FROM (SELECT lag(screen) OVER w AS from_screen, screen AS to_screen, time_ms - lag(time_ms) OVER w AS gap FROM ui WINDOW w AS (PARTITION BY user_id ORDER BY ord)) WHERE from_screen <> to_screen GROUP BY ALL"""))
def w15(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ord")
    r = src.ui_windows(spark, d).select(F.lag("screen").over(w).alias("from_screen"), F.col("screen").alias("to_screen"), (F.col("time_ms") - F.lag("time_ms").over(w)).alias("gap"))
    return r.filter("from_screen <> to_screen").groupBy("from_screen", "to_screen").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gap_ms"))


@query("w19_wrapped_problems", sql(body=f"SELECT source, owner, count(*) AS calls, count(*) FILTER (failed OR dur >= 250) AS problems, max(dur) AS max_ms FROM ctx WHERE {HTTP} GROUP BY ALL"))
def w19(spark, d):
    return src.of_type(spark, d, "http").groupBy("source", "owner").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("failed") | (F.col("dur") >= 250)).alias("problems"), F.max("dur").alias("max_ms"))
