"""Queries of quality counters, filters, build-time side data and code-problem details."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import text
from fleetpulse.operators import evidence as ev
from fleetpulse.operators import inspect as ins
from fleetpulse.operators import sidedata as op
from fleetpulse.operators import problems as prob
from fleetpulse.plans.evidence_queries import EDGES, INFLUENCE, REGISTRY, SIG, influence, signals
from fleetpulse.plans.inspect_queries import ROUTES
from fleetpulse.register import query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import CALL_SQL, sql

IDS = [*range(1, 18), *range(0x2000, 0x200B), 0x1000 + 8 * 16 + 1, 0x1000 + 8 * 16 + 4, 0x1000 + 4 * 16 + 2, 99]
TOTALS = f"totals AS (SELECT run_set, [{', '.join(map(str, IDS))}][k % {len(IDS)} + 1] AS id, CAST(sum(dur % 3) AS BIGINT) AS value FROM ctx WHERE type = 'memory' GROUP BY ALL)"
NAMES = {**{i + 1: n for i, n in enumerate(op.COUNTERS)}, **{0x2000 + i: n for i, n in enumerate(op.REGISTRY_COUNTERS)}}
NAME_SQL = "CASE id " + " ".join(f"WHEN {i} THEN '{n}_total'" for i, n in NAMES.items()) + " ELSE CASE WHEN id >= 4096 AND id < 8192 THEN 'event_' || ((id - 4096) // 16) || '_reason_' || ((id - 4096) % 16) || '_total' ELSE 'quality_' || id END END"


def totals(spark, d):
    ids = F.element_at(F.array(*map(F.lit, IDS)), (F.col("k") % len(IDS) + 1).cast("int"))
    return src.of_type(spark, d, "memory").groupBy("run_set", ids.alias("id")).agg(F.sum(F.col("dur") % 3).alias("value"))


@query("q11_counter_names", sql(TOTALS, body=f"SELECT id, {NAME_SQL} AS name, CAST(sum(value) AS BIGINT) AS value FROM totals GROUP BY ALL"))
def q11(spark, d):
    return totals(spark, d).groupBy("id").agg(F.sum("value").alias("value")).withColumn("name", op.counter_name(F.col("id")))


LOUD = ", ".join(str(i) for i, n in NAMES.items() if n not in op.SILENT)


@query("q06_quality_warnings", sql(TOTALS, body=f"""
SELECT run_set, {NAME_SQL} AS warning, value FROM totals WHERE id IN ({LOUD}) AND value > 0 UNION ALL SELECT run_set, 'accepted_not_written', a - w FROM (
  SELECT run_set, CAST(coalesce(sum(value) FILTER (id = 1), 0) AS BIGINT) AS a, CAST(coalesce(sum(value) FILTER (id = 2), 0) AS BIGINT) AS w FROM totals GROUP BY run_set) WHERE a > w"""))
def q06(spark, d):
    return op.quality_warnings(totals(spark, d))


@query("q07_segment_ends", sql(body="""
SELECT source, warning, count(*) AS n FROM (SELECT source, CASE k % 6 WHEN 1 THEN 'normal' WHEN 2 THEN 'shutdown' WHEN 3 THEN 'size_limit' WHEN 4 THEN 'io_error' ELSE 'unknown_' || (k % 6) END AS warning FROM ctx) WHERE warning NOT IN ('normal', 'shutdown') GROUP BY ALL"""))
def q07(spark, d):
    return op.segment_end_warnings(src.events(spark, d).select("source", (F.col("k") % 6).alias("reason"))).groupBy("source", "warning").agg(F.count(F.lit(1)).alias("n"))


@query("q08_retention_quality", sql(TOTALS, body="""
SELECT run_set, CAST(l + w AS BIGINT) AS runtime_loss, l > 0 OR w > 0 OR c > 0 AS may_be_incomplete, o > 0 AS dictionary_degraded FROM (SELECT run_set, coalesce(sum(value) FILTER (id BETWEEN 4225 AND 4229), 0) AS l, coalesce(sum(value) FILTER (id = 8200), 0) AS w,
  coalesce(sum(value) FILTER (id = 8199), 0) AS c, coalesce(sum(value) FILTER (id = 10), 0) AS o FROM totals GROUP BY run_set)"""))
def q08(spark, d):
    return op.retention_quality(totals(spark, d))


DIAG = "diag AS (SELECT run_set, owner AS class, k % 4 AS hooks, k % 3 AS annotated, 1 + k % 9 AS methods, CASE k % 5 WHEN 0 THEN 'unsupported' ELSE 'hooked' END AS kind, CASE k % 7 WHEN 0 THEN 'unsupported_signature' ELSE 'ok' END AS reason, n AS count FROM calls)"


def diagnostics(spark, d):
    k = F.col("k")
    return src.calls(spark, d).select("run_set", F.col("owner").alias("class"), (k % 4).alias("hooks"), (k % 3).alias("annotated"), (1 + k % 9).alias("methods"), F.when(k % 5 == 0, "unsupported").otherwise("hooked").alias("kind"),
                                      F.when(k % 7 == 0, "unsupported_signature").otherwise("ok").alias("reason"), F.col("n").alias("count"))


@query("q10_instrumentation_quality", sql(CALL_SQL, DIAG, body="""
SELECT 'unsupported_signatures' AS warning, CAST(sum(count) AS BIGINT) AS value FROM diag WHERE kind = 'unsupported' OR reason = 'unsupported_signature' HAVING sum(count) > 0
UNION ALL SELECT 'no_hooks', count(*) FROM diag HAVING count(*) > 0 AND sum(hooks) = 0 AND sum(annotated) = 0"""))
def q10(spark, d):
    x = diagnostics(spark, d)
    return op.instrumentation_quality(x, x)


@query("e01_diagnostics", sql(CALL_SQL, DIAG, body="""
SELECT 'hook' AS dimension, class || '|' || kind AS key, CAST(sum(count) AS BIGINT) AS count FROM diag GROUP BY ALL UNION ALL SELECT 'decision', kind || '|' || reason, CAST(sum(count) AS BIGINT) FROM diag GROUP BY ALL"""))
def e01(spark, d):
    x = diagnostics(spark, d)
    both = x.withColumn("dimension", F.explode(F.array(F.lit("hook"), F.lit("decision"))))
    return op.diagnostics_rollup(both, {"hook": ["class", "kind"], "decision": ["kind", "reason"]})


@query("e02_class_ranking", sql(CALL_SQL, DIAG, body="""
SELECT run_set, class, hooks, annotated, methods, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY hooks DESC, annotated DESC, methods DESC, class) AS rn FROM (
  SELECT run_set, class, CAST(sum(hooks) AS BIGINT) AS hooks, CAST(sum(annotated) AS BIGINT) AS annotated, CAST(sum(methods) AS BIGINT) AS methods FROM diag GROUP BY ALL)) WHERE rn <= 200"""))
def e02(spark, d):
    return op.class_ranking(diagnostics(spark, d).groupBy("run_set", "class").agg(*[F.sum(c).alias(c) for c in ("hooks", "annotated", "methods")]))


DI = """di AS (SELECT 'com.app.Owner' || (user_id % 13) || CASE WHEN k % 3 = 0 THEN '$Inner' ELSE '' END AS name, CASE k % 2 WHEN 0 THEN 'hilt' ELSE 'koin' END AS framework, ['role' || (k % 3), 'role' || (k % 2)] AS roles, k % 11 = 0 AS generated,
  'com.app.Service' || (k % 9) AS dependency, 'site' || (k % 2) AS site FROM ctx WHERE type = 'call')"""


def di(spark, d):
    k, u = F.col("k"), F.col("user_id")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return src.of_type(spark, d, "call").select(F.concat(s("com.app.Owner", u % 13), F.when(k % 3 == 0, "$Inner").otherwise("")).alias("name"), F.when(k % 2 == 0, "hilt").otherwise("koin").alias("framework"), F.array(s("role", k % 3), s("role", k % 2)).alias("roles"), (k % 11 == 0).alias("generated"),
                                                s("com.app.Service", k % 9).alias("dependency"), s("site", k % 2).alias("site"))


@query("s10_catalogue", sql(DI, body="""
SELECT name, framework, array_to_string(list_sort(list_distinct(flatten(list(roles)))), '|') AS roles, bool_or(generated) AS generated, count(*) AS records FROM di GROUP BY ALL"""))
def s10(spark, d):
    return op.merged_catalogue(di(spark, d))


DI_EDGES = "di_edges AS (SELECT DISTINCT name AS consumer, dependency, framework, site FROM di WHERE name <> dependency)"


@query("s10_catalogue_edges", sql(DI, DI_EDGES, body="SELECT * FROM di_edges"))
def s10_edges(spark, d):
    return op.catalogue_edges(di(spark, d).select(F.col("name").alias("consumer"), "dependency", "framework", "site"))


OBSERVED = "observed AS (SELECT DISTINCT class, label FROM (SELECT regexp_extract(owner, '^(.*)[.]', 1) || CASE WHEN user_id % 4 = 0 THEN '$Row' ELSE '' END AS class, 'call' AS label FROM ctx WHERE type = 'http' AND user_id % 13 < 6 UNION ALL SELECT 'com.app.Service' || (k % 4), 'owner' FROM ctx WHERE type = 'call'))"


def observed(spark, d):
    e, u = src.events(spark, d), F.col("user_id")
    one = e.filter((F.col("type") == "http") & (u % 13 < 6)).select(F.concat(text.class_of_owner(F.col("owner")), F.when(u % 4 == 0, "$Row").otherwise("")).alias("class"), F.lit("call").alias("label"))
    return one.unionByName(e.filter("type = 'call'").select(F.concat(F.lit("com.app.Service"), (F.col("k") % 4).cast("string")).alias("class"), F.lit("owner").alias("label"))).distinct()


SEEN = "seen AS (SELECT DISTINCT at, label FROM (SELECT unnest([class, split_part(class, '$', 1)]) AS at, label FROM observed)), asked AS (SELECT name, unnest([name, split_part(name, '$', 1)]) AS at FROM (SELECT DISTINCT name FROM di))".replace(" AS at", " AS place").replace("DISTINCT at,", "DISTINCT place,")


@query("j23_observations", sql(DI, OBSERVED, SEEN, body="SELECT name, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM asked JOIN seen USING (place) GROUP BY name"))
def j23(spark, d):
    return op.observations(di(spark, d).select("name").distinct(), observed(spark, d))


@query("e03_injection_report", sql(DI, DI_EDGES, OBSERVED, "base AS (SELECT DISTINCT split_part(class, '$', 1) AS b FROM observed), cls AS (SELECT DISTINCT name, framework FROM di)", body="""
SELECT framework, classes, classes_seen, edges, edges_seen FROM (SELECT framework, count(*) AS classes, count(*) FILTER (split_part(name, '$', 1) IN (SELECT b FROM base)) AS classes_seen FROM cls GROUP BY framework) JOIN (
  SELECT framework, count(*) AS edges, count(*) FILTER (split_part(consumer, '$', 1) IN (SELECT b FROM base) OR dependency IN (SELECT b FROM base)) AS edges_seen FROM di_edges GROUP BY framework) USING (framework)"""))
def e03(spark, d):
    x = di(spark, d)
    return op.injection_report(x.select("name", "framework").distinct(), op.catalogue_edges(x.select(F.col("name").alias("consumer"), "dependency", "framework", "site")), observed(spark, d))


@query("s20_merged_shards", sql(CALL_SQL, body="SELECT DISTINCT caller || ' -> ' || callee AS line FROM calls"))
def s20(spark, d):
    return op.merged_shards(src.calls(spark, d).select(F.concat_ws(" -> ", "caller", "callee").alias("line")))


@query("s21_owner_map")
def s21(spark, d):
    """Ids of all owners' methods; 64-bit FNV has no SQL here, tests hold it against known values."""
    return op.owner_map(src.calls(spark, d).select(text.class_of_owner(F.col("owner")).alias("class"), text.method_of_owner(F.col("owner")).alias("method"), F.concat(F.lit("(I"), (F.col("k") % 3).cast("string"), F.lit(")V")).alias("descriptor")))


STABLE = """refs AS (SELECT source, 'ns' || (user_id % 3) AS namespace, k % 20 AS id FROM ctx WHERE type = 'call'), embedded AS (SELECT source, k % 20 AS id, min('own' || dur) AS value FROM ctx WHERE type = 'memory' AND k % 20 < 8 GROUP BY ALL),
  owners AS (SELECT 'ns' || (user_id % 2) AS namespace, k % 20 AS id, min(owner) AS owner FROM ctx WHERE type = 'ui' AND k % 20 < 15 GROUP BY ALL)"""


def stable(spark, d):
    e, k = src.events(spark, d), F.col("k")
    ns = lambda n: F.concat(F.lit("ns"), (F.col("user_id") % n).cast("string")).alias("namespace")
    refs = e.filter("type = 'call'").select("source", ns(3), (k % 20).alias("id"))
    own = e.filter("type = 'memory' and k % 20 < 8").groupBy("source", (k % 20).alias("id")).agg(F.min(F.concat(F.lit("own"), F.col("dur").cast("string"))).alias("value"))
    return refs, own, e.filter("type = 'ui' and k % 20 < 15").groupBy(ns(2), (k % 20).alias("id")).agg(F.min("owner").alias("owner"))


@query("j02_stable_symbols", sql(STABLE, body="""
SELECT namespace, id, name, by, count(*) AS n FROM (SELECT r.namespace, r.id, coalesce(e.value, o.owner) AS name, CASE WHEN e.value IS NOT NULL THEN 'embedded' WHEN o.owner IS NOT NULL THEN 'owner_map' ELSE 'unresolved' END AS "by" FROM refs r LEFT JOIN embedded e USING (source, id) LEFT JOIN owners o ON o.namespace = r.namespace AND o.id = r.id) GROUP BY ALL""".replace(" by,", ' "by",')))
def j02(spark, d):
    return op.resolved(*stable(spark, d)).groupBy("namespace", "id", "name", "by").agg(F.count(F.lit(1)).alias("n"))


@query("j03_unresolved", sql(STABLE, body="SELECT DISTINCT namespace, id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM embedded e WHERE e.source = r.source AND e.id = r.id) AND NOT EXISTS (SELECT 1 FROM owners o WHERE o.namespace = r.namespace AND o.id = r.id)"))
def j03(spark, d):
    return op.resolved(*stable(spark, d)).filter("by = 'unresolved'").select("namespace", "id").distinct()


@query("j04_namespaces", sql(STABLE, body="SELECT namespace, count(*) AS refs FROM refs WHERE namespace NOT IN (SELECT namespace FROM owners) GROUP BY namespace"))
def j04(spark, d):
    refs, _, owners = stable(spark, d)
    return op.namespace_conflicts(refs, owners).groupBy("namespace").agg(F.count(F.lit(1)).alias("refs"))


OPTIONS = op.Options(route="r3", screen="screen2", owner="owner1")


@query("p03_maths_filter", sql(body="""
SELECT run_set, type, count(*) AS n FROM ctx WHERE CASE type WHEN 'http' THEN contains(lower(route), 'r3') AND contains(lower(owner), 'owner1') WHEN 'ui' THEN contains(lower(screen), 'screen2') WHEN 'call' THEN contains(lower(owner), 'owner1') ELSE true END GROUP BY ALL"""))
def p03(spark, d):
    return op.maths_filter(src.events(spark, d), OPTIONS).groupBy("run_set", "type").agg(F.count(F.lit(1)).alias("n"))


@query("p02_filter_warnings", sql(body="SELECT run_set, concat_ws('|', CASE WHEN bool_or(type = 'call') THEN 'custom_metrics' END, CASE WHEN bool_or(type = 'memory') THEN 'device_context' END) AS untouched FROM ctx GROUP BY run_set"))
def p02(spark, d):
    return op.filter_warnings(src.events(spark, d), OPTIONS)


@query("p04_metric_filter", sql(body="SELECT run_set, route, count(*) AS n FROM (SELECT run_set, replace(lower(route), ' /', '_') AS route FROM ctx WHERE type = 'http') WHERE contains(route, 'get_r1') GROUP BY ALL"))
def p04(spark, d):
    flat = src.of_type(spark, d, "http").select("run_set", text.collapsed(F.col("route")).alias("route"))
    return flat.filter(op.metric_contains(F.col("route"), "GET /r1")).groupBy("run_set", "route").agg(F.count(F.lit(1)).alias("n"))


@query("p11_names", sql(body=f"""
SELECT k % 20 AS id, CASE WHEN k % 20 BETWEEN 1 AND 16 THEN ['{"', '".join(op.EVENT_TYPES)}'][k % 20] ELSE 'event_' || (k % 20) END AS type_name, count(*) AS n FROM ctx GROUP BY ALL"""))
def p11(spark, d):
    i = F.col("k") % 20
    return src.events(spark, d).groupBy(i.alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("type_name", op.event_type_name(F.col("id")))


@query("x01_redacted_routes", sql(body="SELECT redacted, count(*) AS n FROM (SELECT 'GET /r/{id}/' || (k % 3) || 'x' AS redacted FROM ctx WHERE type = 'http') GROUP BY redacted"))
def x01(spark, d):
    """Any redactor of the options; here the default one over routes with user ids."""
    route = F.concat(F.lit("GET /r/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 3).cast("string"), F.lit("x"))
    return src.of_type(spark, d, "http").groupBy(OPTIONS.redact(route).alias("redacted")).agg(F.count(F.lit(1)).alias("n"))


@query("t06_limited_routes", sql("routes AS (" + ROUTES + ")", body="SELECT run_set, route, count, CAST(rn AS INTEGER) AS rank, total FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY count DESC, route) AS rn, count(*) OVER (PARTITION BY run_set) AS total FROM routes) WHERE rn <= 3"))
def t06(spark, d):
    return op.limited(ins.route_stats(src.of_type(spark, d, "http")), [F.desc("count"), F.col("route")], 3).select("run_set", "route", "count", "rank", "total")


@query("a23_sampling_warnings", sql("routes AS (" + ROUTES + ")", body="SELECT run_set, count(*) AS routes, CAST(sum(count) AS BIGINT) AS calls FROM routes WHERE count > 10 GROUP BY run_set"))
def a23(spark, d):
    """With a limit of 10 calls, so that small tables have rows."""
    return op.sampling_warnings(ins.route_stats(src.of_type(spark, d, "http")), 10)


@query("m01_run_key", sql(body="""
SELECT key, count(*) AS n FROM (SELECT CASE WHEN user_id % 4 > 0 THEN 'run' || (user_id % 4) WHEN k % 3 > 0 THEN 'ses' || (k % 3) ELSE source END AS key FROM ctx) GROUP BY key"""))
def m01(spark, d):
    u, k = F.col("user_id") % 4, F.col("k") % 3
    rows = src.events(spark, d).select("source", F.when(u > 0, F.concat(F.lit("run"), u.cast("string"))).otherwise("0000").alias("run_id"), F.when(k > 0, F.concat(F.lit("ses"), k.cast("string"))).otherwise("").alias("session_id"))
    return rows.groupBy(op.run_key().alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("r05_sample_quality", sql(body="SELECT run_set, route, owner, CASE WHEN n < 5 THEN 'small' WHEN n < 20 THEN 'limited' WHEN n < 50 THEN 'enough' ELSE 'good' END AS quality, n FROM (SELECT run_set, route, owner, count(*) AS n FROM ctx WHERE type = 'http' GROUP BY ALL)"))
def r05(spark, d):
    n = src.of_type(spark, d, "http").groupBy("run_set", "route", "owner").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("quality", op.sample_quality(F.col("n")))


@query("p30_data_sizes", sql(body="""
SELECT size, count(*) AS n FROM (SELECT CASE WHEN kb >= 1048576 THEN format('{:.1f} GB', kb / 1048576.0::DOUBLE) WHEN kb >= 1024 THEN format('{:.1f} MB', kb / 1024.0::DOUBLE) ELSE kb || ' KB' END AS size FROM (SELECT dur * (1 + k % 3 * 512) AS kb FROM ctx)) GROUP BY size"""))
def p30(spark, d):
    kb = (F.col("dur") * (1 + F.col("k") % 3 * 512)).alias("kb")
    return src.events(spark, d).select(kb).groupBy(op.data_size(F.col("kb")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("b05_drill_down", sql(body="""
SELECT run_set, class, method, flow, screen, step, route, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set, class, method ORDER BY flow, screen, step, route) AS rn FROM (
  SELECT run_set, class, method, unnest(flows[1:12]) AS flow, screen, step, route FROM (SELECT run_set, class, method, flows, unnest(screens[1:3]) AS screen, steps, routes, step, route FROM (SELECT *, unnest(steps[1:3]) AS step FROM (SELECT *, unnest(routes[1:3]) AS route FROM (
    SELECT run_set, regexp_extract(owner, '^(.*)[.]', 1) AS class, 'run' AS method, list_sort(list(DISTINCT flow)) AS flows, list_sort(list(DISTINCT screen)) AS screens, list_sort(list(DISTINCT step)) AS steps, list_sort(list(DISTINCT route)) AS routes FROM ctx WHERE type = 'http' GROUP BY ALL)))))) WHERE rn <= 12"""))
def b05(spark, d):
    h = src.of_type(spark, d, "http").select("run_set", text.class_of_owner(F.col("owner")).alias("class"), text.method_of_owner(F.col("owner")).alias("method"), "flow", "screen", "step", "route")
    return op.drill_down(h)


@query("b06_impacts", sql(*SIG, REGISTRY, "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in op.IMPACT.items()) + ") t(category, impact, advice))", body="""
SELECT run_set, class, method, string_agg(impact, '|' ORDER BY category, impact) AS impact, string_agg(advice, '|' ORDER BY category, advice) AS advice FROM (SELECT DISTINCT run_set, class, method, unnest([category] || extra) AS category FROM sig JOIN reg USING (run_set, class, method) WHERE rank <= 200) JOIN rules USING (category) GROUP BY ALL"""))
def b06(spark, d):
    return op.impacts(prob.registry(signals(spark, d)))


@query("u06_method_graph", sql(CALL_SQL, body="""
SELECT run_set, regexp_extract(caller, '^(.*)[.]', 1) AS from_class, regexp_extract(caller, '([^.]*)$', 1) AS from_method, regexp_extract(callee, '^(.*)[.]', 1) AS to_class, regexp_extract(callee, '([^.]*)$', 1) AS to_method, CAST(sum(greatest(n, 1)) AS BIGINT) AS count FROM calls GROUP BY ALL"""))
def u06(spark, d):
    return op.method_graph(src.calls(spark, d))


@query("u03_relevant_edges", sql(*SIG, EDGES, INFLUENCE, "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, class) AS r FROM infl) WHERE r <= 5), targets AS (SELECT DISTINCT run_set, class FROM sig WHERE category = 'memory')", body="""
SELECT run_set, from_class, to_class, count, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY count DESC, from_class, to_class) AS rn FROM edges e WHERE EXISTS (SELECT 1 FROM top t WHERE t.run_set = e.run_set AND t.class IN (e.from_class, e.to_class)) OR EXISTS (SELECT 1 FROM targets t WHERE t.run_set = e.run_set AND t.class = e.to_class)) WHERE rn <= 2500"""))
def u03(spark, d):
    s = signals(spark, d)
    top = op.influence_findings(influence(spark, d), 5).select("run_set", "class")
    return op.relevant_edges(ev.class_edges(src.calls(spark, d)), top, s.filter("category = 'memory'").select("run_set", "class").distinct())


@query("u10_influence_findings", sql(*SIG, INFLUENCE, body="SELECT run_set, class, score, severity, CAST(r AS INTEGER) AS rank, same AS same_severity FROM (SELECT *, row_number() OVER (PARTITION BY run_set ORDER BY score DESC, class) AS r, count(*) OVER (PARTITION BY run_set, severity) AS same FROM infl) WHERE r <= 60"))
def u10(spark, d):
    return op.influence_findings(influence(spark, d))
