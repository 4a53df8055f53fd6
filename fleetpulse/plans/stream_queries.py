"""Queries that run the streaming jobs' own functions over the event table as a batch (W family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.functions import text
from fleetpulse.plans.evidence_queries import segments
from fleetpulse.plans.inspect_queries import problems
from fleetpulse.register import ORACLES, query
from fleetpulse.sources import adapter as src
from fleetpulse.sources.adapter import METRIC_SQL, SPAM_SQL, sql
from fleetpulse.streaming import incremental
from fleetpulse.streaming import windows as op



def ts():
    return F.timestamp_millis("time_ms").alias("ts")


def process():
    return F.col("user_id").cast("bigint").alias("process_id")


def flat(windows):
    return windows.withColumn("window_ms", F.unix_millis("w.start")).drop("w")


@query("w03_metric_windows", sql(METRIC_SQL, body="""
SELECT (time_ms // 5000) * 5000 AS window_ms, user_id AS process_id, mode AS kind, name, CAST(sum(CASE WHEN v - 3 >= 0 THEN v - 3 ELSE 0 END) AS BIGINT) AS sum, count(*) FILTER (v - 3 >= 0) AS count, max(v - 3) FILTER (v - 3 >= 0) AS max, count(*) FILTER (v - 3 < 0) AS invalid FROM metrics GROUP BY ALL"""))
def w03(spark, d):
    m = src.metrics(spark, d).select(process(), ts(), F.col("mode").alias("kind"), "name", (F.col("v") - 3).alias("value"))
    return flat(op.metric_windows(m)).drop("last")


@query("w04_log_windows_job", sql(SPAM_SQL, body="SELECT (time_ms // 5000) * 5000 AS window_ms, user_id AS process_id, screen, owner, flow, step, log_source AS source, level, count(*) AS count FROM spam GROUP BY ALL"))
def w04(spark, d):
    return flat(op.log_windows(src.log_spam(spark, d).select(process(), ts(), "screen", "owner", "flow", "step", F.col("log_source").alias("source"), "level")))


@query("w06_method_counters", sql(body="SELECT (time_ms // 5000) * 5000 AS window_ms, user_id AS process_id, k AS method_id, count(*) AS calls FROM ctx WHERE type = 'call' AND k % 2 = 0 GROUP BY ALL"))
def w06(spark, d):
    return flat(op.method_counters(src.of_type(spark, d, "call").select(process(), ts(), F.when(F.col("k") % 2 == 0, "enter").otherwise("exit").alias("op"), F.col("k").alias("method_id"))))


@query("w11_retained_objects", sql(body="""
SELECT w.ord AS object_id, w.owner AS class FROM ctx w WHERE type = 'call' AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.type = 'call' AND c.ord = w.ord AND c.k % 3 > 0 AND (c.k % 9) * 1000 <= 5000)"""))
def w11(spark, d):
    c = src.of_type(spark, d, "call")
    cleared = c.filter("k % 3 > 0").select(F.col("ord").alias("object_id"), F.timestamp_millis(F.col("time_ms") + F.col("k") % 9 * 1000).alias("ts"))
    return op.retained_objects(c.select(F.col("ord").alias("object_id"), ts(), F.col("owner").alias("class")), cleared).select("object_id", "class")


@query("w09_stall_episodes_job", sql(body="""
SELECT user_id AS process_id, beat AS start_ms, nxt - beat AS duration_ms FROM (SELECT user_id, time_ms AS beat, lead(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, ord) AS nxt FROM ctx) WHERE nxt - beat >= 700"""))
def w09(spark, d):
    return op.stall_episodes(src.events(spark, d).select(process(), F.col("time_ms").alias("ms"), "ord"))


#: Phase events of each call: two DNS attempts with one key in every sixth, connections, first byte, end.
PHASE_EVENTS = """ph AS (SELECT ord AS call_id, unnest(['call', 'dns', 'dns', 'dns', 'dns', 'connect', 'connect', 'first_byte', 'call']) AS phase, unnest(['start', 'start', 'start', 'end', 'end', 'start', 'end', 'end', 'end']) AS part, unnest(['', 'h', 'h', 'h', 'h', 'a', 'a', '', '']) AS key,
  unnest([0, 1, 2, 4 + k % 3, 9 + k % 5, 12, 13 + k % 40, 60 + dur % 50, dur + 130]) + time_ms AS ms, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS o, unnest([0, 0, 0, 0, 0, 0, 0, dur, dur * 2]) AS bytes, unnest([false, false, false, false, k % 7 = 0, false, false, false, failed]) AS failed, k FROM ctx WHERE type = 'http'),
  phs AS (SELECT * FROM ph WHERE NOT (phase = 'dns' AND k % 6 > 0) AND NOT (phase = 'connect' AND k % 4 = 3) AND NOT (phase = 'call' AND part = 'end' AND k % 13 = 0))"""


@query("w07_http_calls", sql(PHASE_EVENTS, """prs AS (SELECT call_id, phase, max(ms) FILTER (part = 'end') - max(ms) FILTER (part = 'start') AS took FROM (SELECT *, row_number() OVER (PARTITION BY call_id, phase, key, part ORDER BY ms, o) AS a FROM phs WHERE phase IN ('dns', 'connect')) GROUP BY call_id, phase, key, a)""", body="""
SELECT call_id, s AS start_ms, e - s AS duration_ms, CAST(coalesce(d, 0) AS BIGINT) AS dns_ms, CAST(coalesce(c, 0) AS BIGINT) AS connect_ms, coalesce(greatest(f - s, 0), 0) AS ttfb_ms, bytes, attempts, attempts <= 1 AS single_attempt, failed FROM (
  SELECT call_id, min(ms) AS s, min(ms) FILTER (phase = 'call' AND part = 'end') AS e, min(ms) FILTER (phase = 'first_byte') AS f, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (phase = 'connect' AND part = 'start') AS attempts, bool_or(failed) AS failed FROM phs GROUP BY call_id)
  LEFT JOIN (SELECT call_id, sum(greatest(took, 0)) FILTER (phase = 'dns') AS d, sum(greatest(took, 0)) FILTER (phase = 'connect') AS c FROM prs WHERE took IS NOT NULL GROUP BY call_id) USING (call_id) WHERE e IS NOT NULL"""))
def w07(spark, d):
    k, dur, no = F.col("k"), F.col("dur"), F.lit(False)
    ev = [("call", "start", "", F.lit(0), F.lit(0), no), ("dns", "start", "h", F.lit(1), F.lit(0), no), ("dns", "start", "h", F.lit(2), F.lit(0), no), ("dns", "end", "h", 4 + k % 3, F.lit(0), no), ("dns", "end", "h", 9 + k % 5, F.lit(0), k % 7 == 0),
          ("connect", "start", "a", F.lit(12), F.lit(0), no), ("connect", "end", "a", 13 + k % 40, F.lit(0), no), ("first_byte", "end", "", 60 + dur % 50, dur, no), ("call", "end", "", dur + 130, dur * 2, F.col("failed"))]
    rows = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(a).alias("part"), F.lit(key).alias("key"), (F.col("time_ms") + at).alias("ms"), F.lit(i).alias("ord"), b.cast("bigint").alias("bytes"), f.alias("failed")) for i, (p, a, key, at, b, f) in enumerate(ev)])
    ph = src.of_type(spark, d, "http").select(F.col("ord").alias("call_id"), "k", F.inline(rows))
    return op.http_calls(ph.filter(~((F.col("phase") == "dns") & (k % 6 > 0)) & ~((F.col("phase") == "connect") & (k % 4 == 3)) & ~((F.col("phase") == "call") & (F.col("part") == "end") & (k % 13 == 0))))


@query("w10_dispatches", sql(body="""
SELECT process_id, p_ms AS start_ms, ms - p_ms AS duration_ms, target FROM (SELECT user_id AS process_id, time_ms AS ms, k % 2 AS done, lag(time_ms) OVER w AS p_ms, lag(k % 2) OVER w AS p_done, lag(CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'Handler' || (k % 5) END) OVER w AS target
  FROM ctx WHERE type = 'call' WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, ord)) WHERE done = 1 AND p_done = 0 AND ms - p_ms >= 16"""))
def w10(spark, d):
    k = F.col("k")
    start = F.when(k % 3 == 0, ">>>>> Dispatching soon").otherwise(F.concat(F.lit(">>>>> Dispatching to Handler"), (k % 5).cast("string"), F.lit(" {a1} null: 0")))
    return op.dispatches(src.of_type(spark, d, "call").select(process(), F.col("time_ms").alias("ms"), "ord", F.when(k % 2 == 0, start).otherwise("<<<<< Finished to Handler").alias("line")))


@query("w16_sockets", sql(body="""
SELECT socket, count(*) FILTER (event = 'open') AS opens, count(*) FILTER (event = 'open' AND again) AS reconnects, count(*) FILTER (event = 'failure') AS failures, count(DISTINCT code) FILTER (event IN ('closing', 'closed')) AS close_codes, CAST(coalesce(sum(greatest(ms - opened, 0)) FILTER (event IN ('closed', 'failure')), 0) AS BIGINT) AS lifetime_ms FROM (
  SELECT *, coalesce(bool_or(event = 'open') OVER w, false) AS again, last_value(CASE WHEN event = 'open' THEN ms END IGNORE NULLS) OVER w AS opened FROM (SELECT user_id AS socket, time_ms AS ms, ord, ['open', 'message', 'closing', 'closed', 'failure'][k % 5 + 1] AS event, 1000 + k % 4 AS code FROM ctx WHERE type = 'http')
  WINDOW w AS (PARTITION BY socket ORDER BY ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY socket"""))
def w16(spark, d):
    k = F.col("k")
    event = F.element_at(F.array(*map(F.lit, ["open", "message", "closing", "closed", "failure"])), (k % 5 + 1).cast("int"))
    return op.sockets(src.of_type(spark, d, "http").select(F.col("user_id").alias("socket"), F.col("time_ms").alias("ms"), "ord", event.alias("event"), (1000 + k % 4).alias("code")))


@query("w17_counter_rates_job", sql(body="""
SELECT user_id AS process_id, time_ms AS ms, ord, greatest(gc - p_gc, 0) AS d_gc, greatest(bytes - p_bytes, 0) AS d_bytes, greatest(bytes - p_bytes, 0) * 1000 // greatest(time_ms - p_ms, 1) AS per_second FROM (
  SELECT *, lag(gc) OVER w AS p_gc, lag(bytes) OVER w AS p_bytes, lag(time_ms) OVER w AS p_ms FROM (SELECT *, (ord * 3) % 700 AS gc, (ord * 977) % 900000 AS bytes FROM ctx WHERE type = 'memory') WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, ord)) WHERE p_gc IS NOT NULL"""))
def w17(spark, d):
    rows = src.of_type(spark, d, "memory").select(process(), F.col("time_ms").alias("ms"), "ord", (F.col("ord") * 3 % 700).alias("gc"), (F.col("ord") * 977 % 900000).alias("bytes"))
    return op.counter_rates(rows, ["gc", "bytes"], "bytes")


@query("w18_cpu_shares", sql(body="""
SELECT user_id AS process_id, time_ms AS ms, ord, o * 10000 // t AS of_device, o * 80000 // t AS of_core, least(greatest(t - i, 0) * 10000 // t, 10000) AS busy FROM (
  SELECT *, own - lag(own) OVER w AS o, total - lag(total) OVER w AS t, idle - lag(idle) OVER w AS i FROM (SELECT *, (ord * 5) % 3000 AS own, ord * 40 % 90000 AS total, ord * 20 % 40000 AS idle FROM ctx WHERE type = 'memory') WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, ord)) WHERE o >= 0 AND t > 0 AND i >= 0"""))
def w18(spark, d):
    o = F.col("ord")
    return op.cpu_shares(src.of_type(spark, d, "memory").select(process(), F.col("time_ms").alias("ms"), "ord", (o * 5 % 3000).alias("own"), (o * 40 % 90000).alias("total"), (o * 20 % 40000).alias("idle")))


@query("w15_screen_durations", sql(body="""
SELECT activity, span, count(*) AS n, CAST(sum(took) AS BIGINT) AS total_ms, max(took) AS max_ms FROM (
  SELECT activity, 'created_resumed' AS span, ms - c AS took FROM e WHERE event = 'resumed' AND c IS NOT NULL UNION ALL SELECT activity, 'resumed_paused', ms - r FROM e WHERE event = 'paused' AND r IS NOT NULL
  UNION ALL SELECT activity, 'started_stopped', ms - s FROM e WHERE event = 'stopped' AND s IS NOT NULL UNION ALL SELECT activity, 'created_destroyed', ms - c FROM e WHERE event = 'destroyed' AND c IS NOT NULL) GROUP BY ALL""").replace("\nSELECT activity, span", """, e AS (SELECT *, last_value(CASE WHEN event = 'created' THEN ms END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN event = 'resumed' THEN ms END IGNORE NULLS) OVER w AS r, last_value(CASE WHEN event = 'started' THEN ms END IGNORE NULLS) OVER w AS s FROM (
  SELECT user_id, screen AS activity, time_ms AS ms, ord, ['created', 'started', 'resumed', 'paused', 'stopped', 'destroyed'][k % 6 + 1] AS event FROM ctx WHERE type = 'ui') WINDOW w AS (PARTITION BY user_id, activity ORDER BY ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT activity, span""", 1))
def w15(spark, d):
    event = F.element_at(F.array(*map(F.lit, ["created", "started", "resumed", "paused", "stopped", "destroyed"])), (F.col("k") % 6 + 1).cast("int"))
    return op.screen_durations(src.of_type(spark, d, "ui").select(process(), F.col("screen").alias("activity"), F.col("time_ms").alias("ms"), "ord", event.alias("event")))


@query("w20_live_snapshots", sql(body="SELECT source, sequence, bytes, sealed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sequence DESC, bytes DESC) AS r FROM (SELECT DISTINCT owner || '/' || source AS source, k AS sequence, ord AS bytes, k % 2 = 0 AS sealed FROM ctx)) WHERE r = 1"))
def w20(spark, d):
    return op.latest_snapshots(src.events(spark, d).select(F.concat_ws("/", "owner", "source").alias("source"), F.col("k").alias("sequence"), F.col("ord").alias("bytes"), (F.col("k") % 2 == 0).alias("sealed")).distinct())


@query("w19_wrapped_problems_job", sql(body="SELECT source, owner, count(*) AS calls, count(*) FILTER (failed OR dur >= 250) AS problems, count(*) FILTER (dur >= 1000) AS slow FROM ctx WHERE type = 'http' GROUP BY ALL"))
def w19(spark, d):
    h = src.of_type(spark, d, "http").withColumn("duration_ms", F.col("dur"))
    return h.groupBy("source", "owner").agg(F.count(F.lit(1)).alias("calls"), F.count_if(op.wrapped_problem()).alias("problems"), F.count_if(op.slow_request()).alias("slow"))


#: Processes of the event table are silent for hours; only after a day they are over.
DAY_MS = 86_400_000


@query("w01_frame_windows")
def w01(spark, d):
    """Windows close by arrival, which has no SQL; tests hold batch against stream."""
    ui = src.ui_windows(spark, d).select(process(), F.col("time_ms").alias("ms"), "ord", "screen", F.col("p95_ms").cast("bigint").alias("duration_ms"), (F.col("jank") > 0).alias("is_jank"))
    return op.frame_windows(ui, DAY_MS)


@query("w05_call_graph")
def w05(spark, d):
    """Stacks of enter and exit have no SQL; tests hold them against worked cases."""
    k = F.col("k")
    spans = src.of_type(spark, d, "call").select(process(), (k % 3).cast("bigint").alias("thread_id"), F.col("time_ms").alias("ms"), "ord", F.when(k % 2 == 0, "enter").otherwise("exit").alias("op"), (k % 7).cast("bigint").alias("method_id"))
    return op.call_graph(spans, DAY_MS)


@query("w12_kept_samples")
def w12(spark, d):
    """What is kept depends on what was kept before, which has no SQL; tests hold the rule against worked cases."""
    device = src.device(spark, d).select(process(), F.col("time_ms").alias("ms"), "ord", "pss_kb", "battery", "network", "low_memory")
    return op.kept_samples(device, {"pss_kb": 4096, "battery": 2}, ["network"], ["low_memory"], DAY_MS)


@query("w13_context_changes", sql(body="""
SELECT user_id AS process_id, time_ms AS ms, ord, context FROM (
  SELECT *, lag(context) OVER (PARTITION BY user_id ORDER BY time_ms, ord) AS was, lag(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, ord) AS p_ms FROM (SELECT *, screen || '/' || owner || '/' || flow || '/' || step AS context FROM ctx))
WHERE p_ms IS NULL OR time_ms - p_ms > 86400000 OR was <> context"""))
def w13(spark, d):
    rows = src.events(spark, d).select(process(), F.col("time_ms").alias("ms"), "ord", F.concat_ws("/", "screen", "owner", "flow", "step").alias("context"))
    return op.replay(rows, ["process_id"], op.steps.Changes(), DAY_MS)


@query("w04_capped_log_windows", sql(SPAM_SQL, body="""
SELECT process_id, window_ms, key, CAST(sum(n) AS BIGINT) AS sum, count(*) AS count, max(n) AS max, 0::BIGINT AS lost, 0::BIGINT AS invalid FROM r WHERE nth <= 3 GROUP BY ALL
UNION ALL SELECT process_id, window_ms, NULL, 0::BIGINT, 0::BIGINT, NULL, count(*), 0::BIGINT FROM r WHERE nth > 3 GROUP BY process_id, window_ms""").replace("\nSELECT process_id, window_ms, key", """,
f AS (SELECT user_id AS process_id, time_ms // 86400000 * 86400000 AS window_ms, log_source || '/' || level AS key, min({'a': time_ms, 'b': ord}) AS first FROM spam GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY process_id, window_ms ORDER BY first) AS nth FROM f),
r AS (SELECT g.process_id, g.window_ms, g.key, g.nth, s.n FROM spam s JOIN g ON s.user_id = g.process_id AND s.time_ms // 86400000 * 86400000 = g.window_ms AND s.log_source || '/' || s.level = g.key)
SELECT process_id, window_ms, key""", 1))
def w04_capped(spark, d):
    """Windows of a day and three keys, so that the table has windows with losses."""
    spam = src.log_spam(spark, d).select(process(), F.col("time_ms").alias("ms"), "ord", F.concat_ws("/", "log_source", "level").alias("key"), F.col("n").cast("bigint").alias("value"))
    return op.capped_windows(spam, 3, DAY_MS, DAY_MS)


@query("w14_flow_scopes")
def w14(spark, d):
    """Scopes are stacks, which have no SQL; tests hold them against worked cases."""
    k = F.col("k")
    rows = src.events(spark, d).select(process(), (k % 2).cast("bigint").alias("thread_id"), F.col("time_ms").alias("ms"), "ord", F.when(k % 3 == 0, "start").when(k % 3 == 1, "step").otherwise("end").alias("op"), F.concat(F.lit("n"), (k % 5).cast("string")).alias("name"))
    return op.flow_scopes(rows, DAY_MS)


def views(raw):
    """The views that incremental inspection reads, over rows of the event table (all, or a batch)."""
    spark = raw.sparkSession
    spam = src.log_spam(spark, raw)
    return {"events": src.events(spark, raw), "http": src.of_type(spark, raw, "http"), "ui": src.ui_windows(spark, raw), "stalls": src.stalls(spark, raw), "retained": src.retained(spark, raw), "spam": spam,
            "spam_named": spam.withColumn("level", text.level_name(F.col("level"))), "calls": src.calls(spark, raw), "device": src.device(spark, raw), "metrics": src.metrics(spark, raw), "problems": problems(spark, raw), "segments": segments(spark, raw)}


def _incremental(name):
    @query(f"w21_{name}", ORACLES[name])
    def w21(spark, d):
        """Three batches, told apart by event number, merge to what one pass gives."""
        raw = spark.read.parquet(f"{d}/events.parquet")
        family = incremental.FAMILIES[name]
        parts = [incremental.merged(family.partial(name, views(raw.filter(F.col("event_id") % 3 == i)))) for i in range(3)]
        return incremental.result(incremental.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])), name)

    return w21


for _name in incremental.FAMILIES:
    _incremental(_name)
