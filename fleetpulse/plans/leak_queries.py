"""Queries of heap evidence and of the leak report: J08-J11, P19, P24-P29, L06-L15, H07, V07."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import text
from fleetpulse.operators import evidence as ev
from fleetpulse.operators import leaks as op
from fleetpulse.operators import resolve
from fleetpulse.plans.evidence_queries import KIND, LEAKS, MEMORY_SQL, PLAIN, SUSPECTS, leaks, memory
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import DEVICE_SQL, HEAP_SQL, RETAINED_SQL, sql

APP = "(contains({c}, '.') AND NOT regexp_matches(lower({c}), '^(android|androidx|java|javax|kotlin|kotlinx|com[.]android|dalvik|libcore|sun)[.]'))"
CATEGORY = """CASE WHEN trim({c}) = '' THEN '' WHEN contains(lower({c}), 'sticky class') THEN 'class/static' WHEN contains(lower({c}), 'jni') THEN 'jni'
  WHEN regexp_matches(lower({c}), 'thread|java frame|native stack') THEN 'thread' WHEN contains(lower({c}), 'monitor') THEN 'monitor' WHEN regexp_matches(lower({c}), 'reference|finalizing') THEN 'reference'
  WHEN regexp_matches(lower({c}), 'vm|debugger') THEN 'vm/internal' ELSE 'unknown' END"""


def tok(c: str) -> str:
    return f"translate(regexp_replace(lower({c}), '^gc root: ', ''), '/$', '..')"


RULES_SQL = f"""evidence AS (SELECT *, {tok('class')} || '|' || {tok('holder')} || '|' || {tok('field')} || '|' || {tok('category')} || CASE WHEN len(path) = 0 THEN '' ELSE '|' || array_to_string(list_transform(path, lambda s: {tok('s.class')} || '.' || {tok('s.field')} || '.' || s.kind), '|') END AS fingerprint,
    CASE WHEN len(path) = 0 THEN [] ELSE list_filter(['androidx.viewmodel_store', 'listener_or_callback', CASE WHEN contains(lower(field), 'mcontext') THEN 'context_reference' END], lambda x: x IS NOT NULL) END AS matchers,
    CASE WHEN class = 'com.app.FeedActivity' AND contains(lower(field), 'mcontext') THEN 'context_chain' WHEN class = 'com.app.FeedActivity' AND category = 'class/static' THEN 'static_activity' WHEN class = 'com.app.OrdersFragment' AND category = 'class/static' THEN 'static_fragment'
      WHEN category = 'thread' THEN 'thread_or_queue' WHEN contains(lower(field), 'listener') THEN 'listener' ELSE 'strong_chain' END AS pattern
  FROM (SELECT * REPLACE (CASE WHEN objects = 0 AND kb > 0 THEN 1 ELSE objects END AS objects), {CATEGORY.format(c='root')} AS category FROM heap)),
  ruled AS (SELECT *, CASE WHEN {APP.format(c='holder')} THEN 8 ELSE 0 END + CASE WHEN field <> '' THEN 5 ELSE 0 END + CASE WHEN field <> '' AND {APP.format(c='field')} THEN 2 ELSE 0 END
    + CASE category WHEN 'class/static' THEN 5 WHEN 'thread' THEN 4 WHEN 'jni' THEN 2 WHEN 'monitor' THEN 2 ELSE 0 END + CASE WHEN pattern <> 'strong_chain' THEN 4 ELSE 0 END + CASE WHEN len(matchers) > 0 THEN 3 ELSE 0 END
    + CASE WHEN len(path) > 0 THEN 3 ELSE 0 END + CASE WHEN alternatives > 0 THEN 1 ELSE 0 END + CASE WHEN len(path) BETWEEN 1 AND 8 THEN 1 ELSE 0 END AS actionability FROM evidence)"""
ORDER = "CASE WHEN kb >= 4096 THEN floor(log2(kb)) ELSE 0 END DESC, actionability DESC, kb DESC, len(path)"
HEAP = [HEAP_SQL, RULES_SQL]


def evidence(spark, d) -> DataFrame:
    raw = src.heap_leaks(spark, d).withColumns({"category": F.lit(""), "fingerprint": F.lit(""), "bytes": F.lit(0), "source": F.lit("dump")})
    return op.with_rules(op.normal_evidence(raw))


@query("s11_heap_evidence", sql(*HEAP, body="SELECT run_set, class, holder, field, root, category, fingerprint, kb, objects FROM evidence"))
def s11(spark, d):
    return evidence(spark, d).select("run_set", "class", "holder", "field", "root", "category", "fingerprint", "kb", "objects")


@query("s12_evidence_merge", sql(HEAP_SQL, body="""
SELECT run_set, array_to_string(list_sort(list(DISTINCT 'dump ' || (objects % 3))), '|') AS sources, array_to_string(list_sort(list(DISTINCT root)), '|') AS warnings, count(*) AS leaks FROM heap GROUP BY run_set"""))
def s12(spark, d):
    return op.merged_evidence(src.heap_leaks(spark, d).select("run_set", "class", F.concat(F.lit("dump "), (F.col("objects") % 3).cast("string")).alias("source"), F.col("root").alias("warning")))


HEAP_NAMES = [("com.app.FeedActivity", "a.Feed"), ("com.app.Holder", "h.Any"), ("com.app.Holder1", "h.One"), ("com.app.Cached", "c.Cached"), ("java.util.HashMap", "java.util.HashMap"), ("clickListener", "onClick")]
NAMES_SQL = "mapping AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in HEAP_NAMES) + ") t(obfuscated, original))"
#: Each name once, resolved.
PLAIN_NAMES = """names AS (SELECT DISTINCT unnest([class, holder, field, root] || list_transform(path, lambda s: s.class)) AS v FROM heap),
  plain AS (SELECT v, """ + PLAIN.format(v="v") + " AS p FROM names), said AS (SELECT map(list(v), list(p)) AS m FROM plain)"


@query("j06_plain_heap_evidence", sql(HEAP_SQL, NAMES_SQL, PLAIN_NAMES, body=f"""
SELECT run_set, class, holder, field, kb, {tok('class')} || '|' || {tok('holder')} || '|' || {tok('field')} || '|' || {tok('category')} || CASE WHEN len(path) = 0 THEN '' ELSE '|' || array_to_string(list_transform(path, lambda s: {tok('s.class')} || '.' || {tok('s.field')} || '.' || s.kind), '|') END AS fingerprint FROM (
  SELECT run_set, m[class] AS class, m[holder] AS holder, m[field] AS field, m[root] AS root, kb, list_transform(path, lambda s: {{'class': m[s.class], 'field': s.field, 'kind': s.kind}}) AS path, {CATEGORY.format(c='m[root]')} AS category FROM heap, said)"""))
def j06_heap(spark, d):
    raw = src.heap_leaks(spark, d).withColumns({"category": F.lit(""), "fingerprint": F.lit(""), "bytes": F.lit(0), "source": F.lit("dump")})
    return resolve.plain_heap_evidence(raw, spark.createDataFrame(HEAP_NAMES, "obfuscated string, original string")).select("run_set", "class", "holder", "field", "kb", "fingerprint")


@query("p27_path_rules", sql(*HEAP, body="SELECT run_set, class, holder, field, root, array_to_string(matchers, '|') AS matchers, pattern, actionability::BIGINT AS actionability FROM ruled"))
def p27(spark, d):
    return evidence(spark, d).select("run_set", "class", "holder", "field", "root", F.array_join("matchers", "|").alias("matchers"), "pattern", F.col("actionability").cast("bigint").alias("actionability"))


@query("p28_path_parties", sql(HEAP_SQL, body=f"""
SELECT run_set, class, field, root AS label, CASE WHEN root = '' OR holder = '' THEN '' ELSE holder END AS holder, CASE WHEN root = '' OR field = '' THEN '' ELSE CASE WHEN holder = '' THEN 'java.util.HashMap' ELSE holder END || '.' || field END AS held_by, count(*) AS n FROM heap GROUP BY ALL"""))
def p28(spark, d):
    h = src.heap_leaks(spark, d)
    path, c = F.col("path"), F.col("class")
    return h.select("run_set", "class", "field", F.coalesce(op.path_root(path), F.lit("")).alias("label"), op.path_holder(path, c).alias("holder"), op.path_field(path, c).alias("held_by")).groupBy(
        "run_set", "class", "field", "label", "holder", "held_by").agg(F.count(F.lit(1)).alias("n"))


EDGES_SQL = """heap_edges AS (SELECT run_set, CASE k % 4 WHEN 0 THEN 'java.lang.ref.WeakReference' WHEN 1 THEN 'com.app.Ref' WHEN 2 THEN 'java.lang.ref.Reference' ELSE 'com.app.Node' END AS node_class,
  CASE k % 3 WHEN 0 THEN 'java.lang.ref.Reference' ELSE '' END AS field_owner, CASE WHEN k % 2 = 0 THEN 'referent' ELSE 'next' END AS field FROM ctx WHERE type = 'call')"""


@query("p29_strong_edges", sql(EDGES_SQL, body="""
SELECT run_set, node_class, field_owner, field, count(*) AS n FROM heap_edges WHERE NOT (field = 'referent' AND (starts_with(lower(node_class), 'java.lang.ref.') OR lower(field_owner) = 'java.lang.ref.reference')) GROUP BY ALL"""))
def p29(spark, d):
    k = F.col("k")
    e = src.of_type(spark, d, "call").select("run_set", F.when(k % 4 == 0, "java.lang.ref.WeakReference").when(k % 4 == 1, "com.app.Ref").when(k % 4 == 2, "java.lang.ref.Reference").otherwise("com.app.Node").alias("node_class"),
                                             F.when(k % 3 == 0, "java.lang.ref.Reference").otherwise("").alias("field_owner"), F.when(k % 2 == 0, "referent").otherwise("next").alias("field"))
    return op.strong(e).groupBy("run_set", "node_class", "field_owner", "field").agg(F.count(F.lit(1)).alias("n"))


@query("h07_best_per_class", sql(*HEAP, body=f"""
SELECT run_set, class, holder, field, root, kb, actionability::BIGINT AS actionability FROM (SELECT *, row_number() OVER (PARTITION BY run_set, class ORDER BY {ORDER}, holder, field, root) AS rn FROM ruled) WHERE rn = 1"""))
def h07(spark, d):
    return op.best_per_class(evidence(spark, d)).select("run_set", "class", "holder", "field", "root", "kb", F.col("actionability").cast("bigint").alias("actionability"))


BEST = f"""best AS (SELECT * FROM (SELECT s.run_set, s.class, s.holder, s.screen, s.flow, s.step, h.holder AS heap_holder, h.field, h.root, h.kb, h.path, h.alternatives, h.fingerprint, row_number() OVER (PARTITION BY s.run_set, s.class, s.holder, s.screen, s.flow, s.step
    ORDER BY CASE WHEN h.holder <> '' AND contains(lower(h.holder), lower(s.holder)) THEN 1000 ELSE 0 END + CASE WHEN h.field <> '' AND contains(lower(h.field), lower(s.holder)) THEN 800 ELSE 0 END + actionability * 100 + floor(least(kb, 524288) / 1024)
      + CASE WHEN len(path) BETWEEN 1 AND 47 THEN 48 - len(path) ELSE 0 END DESC, {ORDER}, h.holder, h.field, h.root) AS rn FROM suspects s JOIN ruled h ON h.run_set = s.run_set AND h.class = s.class) WHERE rn = 1)"""


def best(spark, d) -> DataFrame:
    return op.best_evidence(ev.suspects(src.retained(spark, d)), evidence(spark, d))


@query("j10_best_evidence", sql(RETAINED_SQL, SUSPECTS, *HEAP, BEST, body="SELECT run_set, class, holder, screen, flow, step, heap_holder, field, root, kb FROM best"))
def j10(spark, d):
    return best(spark, d).select("run_set", "class", "holder", "screen", "flow", "step", "heap_holder", "field", "root", "kb")


@query("j08_target_classes", sql(RETAINED_SQL, HEAP_SQL, body="SELECT run_set, class, count(*) AS nodes FROM retained WHERE class IN (SELECT class FROM heap) GROUP BY ALL"))
def j08(spark, d):
    return op.target_classes(src.heap_leaks(spark, d), src.retained(spark, d)).groupBy("run_set", "class").agg(F.count(F.lit(1)).alias("nodes"))


@query("j09_heap_only", sql(RETAINED_SQL, *HEAP, body="""
SELECT run_set, class, CASE WHEN holder <> '' THEN holder WHEN field <> '' THEN field ELSE 'unknown' END AS holder, CAST(sum(greatest(objects, 1)) AS BIGINT) AS count FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM retained r WHERE r.run_set = e.run_set AND r.class = e.class) GROUP BY ALL"""))
def j09(spark, d):
    return op.heap_only(evidence(spark, d), src.retained(spark, d))


#: The score's SQL with a heap: the suspect's best evidence replaces size and holder, a path adds to the score.
HEAP_SCORED = LEAKS[-1].replace("hs AS (SELECT run_set, class, holder, screen, flow, step, NULL::BIGINT AS heap_kb, NULL::VARCHAR AS heap_holder, false AS heap_path, NULL::VARCHAR AS chain FROM suspects)",
                                "hs AS (SELECT s.run_set, s.class, s.holder, s.screen, s.flow, s.step, b.kb AS heap_kb, nullif(coalesce(nullif(b.heap_holder, ''), b.field), '') AS heap_holder, coalesce(len(b.path) >= 2, false) AS heap_path, b.fingerprint AS chain FROM suspects s LEFT JOIN best b USING (run_set, class, holder, screen, flow, step))")
HEAP_LEAKS = [RETAINED_SQL, DEVICE_SQL, SUSPECTS, MEMORY_SQL, *HEAP, BEST, HEAP_SCORED]


def heap_scored(spark, d) -> DataFrame:
    named = F.when(F.col("heap_holder") != "", F.col("heap_holder")).when(F.col("field") != "", F.col("field"))
    b = best(spark, d).select(*ev.SUSPECT, F.col("kb").alias("heap_kb"), named.alias("heap_holder"), (F.size("path") >= 2).alias("heap_path"), F.col("fingerprint").alias("chain"))
    return ev.leak_scores(ev.suspects(src.retained(spark, d)), memory(spark, d), b)


@query("l03_leak_scores_heap", sql(*HEAP_LEAKS, body="SELECT * FROM scored"))
def l03_heap(spark, d):
    return heap_scored(spark, d)


UNKNOWN = "{c} = 'unknown'"
CONTEXT = "(CASE WHEN screen <> 'unknown' THEN 1 ELSE 0 END + 1 + 1)"


@query("h08_evidence_confidence", sql(*HEAP, body="""
SELECT run_set, class, holder, field, root, concat_ws(';', CASE WHEN partial THEN CASE WHEN exact THEN 'medium' ELSE 'low_plus' END WHEN exact THEN 'high' ELSE 'medium_plus' END,
  CASE WHEN NOT exact THEN 'bounded_size' END, CASE WHEN len(m) > 0 THEN 'matchers=' || array_to_string(m, ',') END, CASE WHEN partial THEN 'partial_dump' END) AS confidence FROM (
  SELECT *, objects % 3 > 0 AS exact, run_set = 'candidate' AND root LIKE '%JNI%' AS partial, matchers AS m FROM evidence)"""))
def h08(spark, d):
    """Every third size counts as bounded, dumps with native roots as read in part: all four levels occur."""
    partial = (F.col("run_set") == "candidate") & F.contains("root", F.lit("JNI"))
    return evidence(spark, d).select("run_set", "class", "holder", "field", "root", op.evidence_confidence(F.col("objects") % 3 > 0, F.col("matchers"), partial).alias("confidence"))


@query("l06_confidences", sql(RETAINED_SQL, DEVICE_SQL, SUSPECTS, MEMORY_SQL, body=f"""
SELECT run_set, class, holder, screen, flow, step, 'context' AS holder_quality, CASE WHEN coalesce(max_pss_kb, 0) = 0 THEN 'low_no_pss' WHEN count >= 3 OR max_age_ms >= 30000 THEN 'medium' ELSE 'rough' END AS size_confidence,
  CASE WHEN count >= 2 THEN 'medium_plus' ELSE 'medium_context' END AS attribution, 'medium_context' AS path_confidence FROM suspects LEFT JOIN memory USING (run_set)"""))
def l06(spark, d):
    s = ev.suspects(src.retained(spark, d)).join(F.broadcast(memory(spark, d)), "run_set", "left")
    return op.confidences(s).select(*ev.SUSPECT, "holder_quality", "size_confidence", "attribution", "path_confidence")


@query("l07_holder_path", sql(RETAINED_SQL, body="""
SELECT path, CAST(sum(n) AS BIGINT) AS objects FROM (SELECT n, concat_ws(' > ', CASE WHEN screen <> 'unknown' THEN 'screen:' || screen END, 'flow:' || flow, 'step:' || step, CASE WHEN holder <> 'unknown' THEN 'holder:com.app' END,
  CASE WHEN holder <> 'unknown' THEN 'method:' || substr(holder, 9) END, 'object:' || class) AS path FROM retained) GROUP BY path"""))
def l07(spark, d):
    return src.retained(spark, d).select(op.holder_path().alias("path"), "n").groupBy("path").agg(F.sum("n").cast("bigint").alias("objects"))


ACT = "CASE kind WHEN 'activity' THEN '{}' WHEN 'fragment' THEN '{}' WHEN 'view' THEN '{}' WHEN 'system' THEN '{}' ELSE '{}' END"
ADVISED = [ACT.format(*[op.ADVICE[k][i] for k in ("activity", "fragment", "view", "system", "user")]) for i in range(3)]


@query("l08_advice", sql(*LEAKS, body=f"""
SELECT run_set, class, holder, screen, flow, step, concat_ws('|', 'check_holder', {ADVISED[0]}, CASE WHEN max_age_ms >= 30000 THEN 'old' END, CASE WHEN count >= 3 THEN 'repeats' END) AS actions,
  concat_ws('|', 'first_app_class', CASE WHEN screen <> 'unknown' THEN 'replay_screen' END, {ADVISED[1]}) AS investigation, {ADVISED[2]} || '|test_holder' AS fix_examples, 'repeat|compare|take_dump' AS verification FROM scored"""))
def l08(spark, d):
    return op.advice(leaks(spark, d)).select(*ev.SUSPECT, "actions", "investigation", "fix_examples", "verification")


@query("l15_ordered", sql(*LEAKS, body="""
SELECT run_set, class, holder, screen, flow, step, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, max_age_ms DESC, class, holder, screen, flow, step) AS rn FROM scored WHERE score > 0) WHERE rn <= 80"""))
def l15(spark, d):
    return op.ordered(leaks(spark, d)).select(*ev.SUSPECT, "score", "rank")


FINGERPRINT = "CASE WHEN chain <> '' THEN 'chain|' || chain ELSE lower(concat_ws('|', class, holder, screen, flow, step)) END"
DELTAS = """deltas AS (SELECT *, CASE WHEN effect = 'high' AND coalesce(c_evidence IN ('time_only', 'unconfirmed_heap'), false) THEN 'medium' ELSE effect END AS severity FROM (
  SELECT *, CASE WHEN b_score IS NULL THEN 'new' WHEN c_score IS NULL THEN 'resolved' WHEN much OR more THEN 'worse' WHEN less THEN 'better' ELSE 'same' END AS status,
    CASE WHEN b_score IS NULL THEN CASE WHEN c_severity = 'high' THEN 'high' ELSE 'medium' END WHEN c_score IS NULL THEN 'ok' WHEN much THEN 'high' WHEN more THEN CASE WHEN c_severity = 'high' THEN 'high' ELSE 'medium' END WHEN less THEN 'ok' ELSE c_severity END AS effect FROM (
    SELECT *, c_score - b_score >= 8 OR c_count - b_count >= 5 OR c_max_age_ms - b_max_age_ms >= 30000 OR c_retained_kb - b_retained_kb >= 8192 AS much,
      c_score - b_score >= 3 OR c_count > b_count OR c_max_age_ms > b_max_age_ms OR c_retained_kb > b_retained_kb AS more, c_score - b_score <= -3 OR c_count < b_count OR c_max_age_ms < b_max_age_ms OR c_retained_kb < b_retained_kb AS less FROM (
      SELECT fingerprint, coalesce(c.class, b.class) AS class, b.class AS b_class, c.class AS c_class, c.severity AS c_severity, """ + ", ".join(f"{p}.{v} AS {p}_{v}" for p in "bc" for v in ("score", "count", "max_age_ms", "retained_kb", "evidence", "holder", "chain")) + " FROM (SELECT fingerprint, " + ", ".join(
    f"arg_max(side, (score, count, max_age_ms, retained_kb, class, holder, screen, flow, step)) FILTER (run_set = '{s}') AS {p}" for p, s in (("b", "baseline"), ("c", "candidate"))) + f" FROM (SELECT *, {FINGERPRINT} AS fingerprint, {{'score': score, 'count': count, 'max_age_ms': max_age_ms, 'retained_kb': retained_kb, 'evidence': evidence, 'severity': severity, 'class': class, 'holder': holder, 'chain': chain}} AS side FROM scored) GROUP BY fingerprint)))))"


@query("l10_leak_compare", sql(*LEAKS, DELTAS, body="SELECT fingerprint, class, status, severity, " + ", ".join(f"coalesce({p}_{v}, 0) AS {p}_{v}" for p in "bc" for v in ("score", "count", "max_age_ms", "retained_kb")) +
                               ", b_evidence, c_evidence, b_holder, c_holder, b_chain, c_chain, b_class, c_class, b_score IS NOT NULL AS has_baseline, c_score IS NOT NULL AS has_candidate FROM deltas"))
def l10(spark, d):
    return ev.leak_compare(leaks(spark, d))


MATCH = """CASE WHEN b_score IS NOT NULL AND c_score IS NOT NULL AND b_evidence <> c_evidence THEN 'low_evidence_differs' WHEN (b_score IS NULL OR c_score IS NULL) AND (coalesce(b_evidence = 'confirmed_path', false) OR coalesce(c_evidence = 'confirmed_path', false)) THEN 'medium_chain_one_side'
  WHEN b_score IS NULL OR c_score IS NULL THEN 'medium_one_side' WHEN b_chain <> '' AND b_chain = c_chain AND b_evidence = 'confirmed_path' THEN 'high_heap_chain' WHEN b_chain <> '' AND b_chain = c_chain THEN 'high_chain'
  WHEN b_class = c_class AND b_holder <> '' AND b_holder = c_holder THEN 'medium_class_holder' WHEN b_class = c_class THEN 'low_class_only' ELSE 'low_fallback' END"""


@query("l11_match_confidence", sql(*LEAKS, DELTAS, body=f"SELECT match, count(*) AS n FROM (SELECT {MATCH} AS match FROM deltas) GROUP BY match"))
def l11(spark, d):
    return op.match_confidence(ev.leak_compare(leaks(spark, d))).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


@query("l11_heap_match_confidence", sql(*HEAP_LEAKS, DELTAS, body=f"SELECT fingerprint, {MATCH} AS match FROM deltas"))
def l11_heap(spark, d):
    return op.match_confidence(ev.leak_compare(heap_scored(spark, d))).select("fingerprint", "match")


@query("l10_heap_leak_compare", sql(*HEAP_LEAKS, DELTAS, body="SELECT fingerprint, class, status, severity, b_score IS NOT NULL AS has_baseline, c_score IS NOT NULL AS has_candidate FROM deltas"))
def l10_heap(spark, d):
    return ev.leak_compare(heap_scored(spark, d)).select("fingerprint", "class", "status", "severity", "has_baseline", "has_candidate")


@query("l12_compare_statistics", sql(*LEAKS, DELTAS, body="""
SELECT *, CASE WHEN "new" > 0 OR worse > 0 THEN 'worse' WHEN better > 0 OR resolved > 0 THEN 'better' ELSE 'same' END AS overall FROM (
  SELECT count(b_score) AS baseline_total, count(c_score) AS candidate_total, count(*) FILTER (status = 'new') AS "new", count(*) FILTER (status = 'worse') AS worse, count(*) FILTER (status = 'same') AS same, count(*) FILTER (status = 'better') AS better, count(*) FILTER (status = 'resolved') AS resolved FROM deltas)"""))
def l12(spark, d):
    return op.compare_statistics(ev.leak_compare(leaks(spark, d)))


@query("l13_explanation_graph", sql(RETAINED_SQL, DEVICE_SQL, SUSPECTS, *HEAP, BEST, body="""
SELECT run_set, class, holder, screen, flow, step, CAST(i - 1 AS INTEGER) AS ix, path[i].class AS node, CASE WHEN i < len(path) THEN path[i + 1].class END AS next FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM best)"""))
def l13(spark, d):
    return op.explanation_graph(best(spark, d).withColumn("nodes", F.transform("path", lambda s: s["class"]))).select(*ev.SUSPECT, "ix", "node", "next")


@query("v07_leak_gate", sql(*HEAP_LEAKS, DELTAS, body="""
, t AS (SELECT count(*) FILTER (status = 'new') AS n, count(*) FILTER (status = 'worse') AS w, count(c_score) AS c FROM deltas), h AS (SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (evidence <> 'confirmed_path') AS ro FROM scored WHERE run_set = 'candidate')
SELECT 'candidate_total' AS rule, '' AS class, c AS value FROM t WHERE c > 3 UNION ALL SELECT 'worse', '', w FROM t WHERE w > 2 UNION ALL SELECT 'high', '', high FROM h WHERE high > 1 UNION ALL SELECT 'runtime_only', '', ro FROM h WHERE ro > 1 UNION ALL SELECT 'fail_on_new', '', n FROM t WHERE n > 0
UNION ALL SELECT 'new_high', class, count(*) FROM deltas WHERE status = 'new' AND severity = 'high' GROUP BY class UNION ALL SELECT 'high_without_heap', class, count(*) FROM scored WHERE run_set = 'candidate' AND severity = 'high' AND evidence <> 'confirmed_path' GROUP BY class""".strip()))
def v07(spark, d):
    s = heap_scored(spark, d)
    limits = {"candidate_total": 3, "worse": 2, "high": 1, "runtime_only": 1, "fail_on_new": 1, "fail_on_new_high": 1, "require_heap_for_high": 1}
    return op.leak_gate(ev.leak_compare(s), s.filter("run_set = 'candidate'"), limits)


WARNING = """warnings AS (SELECT run_set, CASE k % 4 WHEN 0 THEN 'heap dump truncated ' ELSE 'slow disk ' END || (k % 3) AS warning FROM ctx WHERE type = 'memory')"""


@query("l14_leak_warnings", sql(WARNING, body="SELECT run_set, warning, count(*) AS n FROM warnings WHERE regexp_matches(warning, 'leak|retain|heap|hprof|memory|gc|dictionary') GROUP BY ALL"))
def l14(spark, d):
    k = F.col("k")
    w = src.of_type(spark, d, "memory").select("run_set", F.concat(F.when(k % 4 == 0, "heap dump truncated ").otherwise("slow disk "), (k % 3).cast("string")).alias("warning"))
    return op.warnings_about_leaks(w).groupBy("run_set", "warning").agg(F.count(F.lit(1)).alias("n"))
