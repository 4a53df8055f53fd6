"""Telemetry views of the driver's tables, with the same definitions as DataFrames and as SQL.

``events`` plays the event stream: purchases are HTTP calls, errors failed ones, views UI windows, clicks runtime
calls, signups memory and device-context samples.  Signals that the table lacks are derived from the same rows by
plain expressions, so each operator's input grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEL_SQL = """tel AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'candidate' END AS run_set,
         'log_' || (user_id % 5) AS source, event_id AS ord, epoch_us(ts) // 1000 AS time_ms,
         CASE event_type WHEN 'purchase' THEN 'http' WHEN 'error' THEN 'http' WHEN 'view' THEN 'ui' WHEN 'click' THEN 'call' ELSE 'memory' END AS type,
         event_type = 'error' AS failed, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(floor(value * 10) AS BIGINT) AS dur, user_id
  FROM events)"""
CTX_SQL = """ctx AS (
  SELECT *, 'GET /r' || (k % 7) AS route, CASE WHEN k % 11 = 0 THEN 'unknown' ELSE 'Screen' || (k % 5) END AS screen,
         'com.app.Owner' || (user_id % 13) || '.run' AS owner, 'flow' || (user_id % 3) AS flow, 's' || (k % 2) AS step
  FROM tel)"""
SQL = f"WITH {TEL_SQL}, {CTX_SQL}"


def events(spark: SparkSession, sf_dir: str | DataFrame) -> DataFrame:
    """run_set, source, ord, time_ms, type, failed, k, dur, user_id, route, screen, owner, flow, step.

    ``sf_dir`` is the tables' folder or, here as in all views, rows of the event table themselves (a batch of a stream).
    """
    raw = sf_dir if isinstance(sf_dir, DataFrame) else spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "http").when(F.col("event_type") == "view", "ui").when(F.col("event_type") == "click", "call").otherwise("memory")
    tel = raw.select(
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "baseline").otherwise("candidate").alias("run_set"),
        F.concat(F.lit("log_"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.col("event_id").alias("ord"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("time_ms"),
        kind.alias("type"), (F.col("event_type") == "error").alias("failed"), k.alias("k"),
        F.floor(F.col("value") * 10).cast("bigint").alias("dur"), "user_id",
    )
    text = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    return tel.select(
        "*", text("GET /r", "k", 7).alias("route"),
        F.when(F.col("k") % 11 == 0, "unknown").otherwise(text("Screen", "k", 5)).alias("screen"),
        F.concat(text("com.app.Owner", "user_id", 13), F.lit(".run")).alias("owner"),
        text("flow", "user_id", 3).alias("flow"), text("s", "k", 2).alias("step"),
    )


def of_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("type") == kind)


#: A UI window's frames, janky frames and frame times.
UI_SQL = """ui AS (SELECT *, 1000 AS window_ms, 60 AS frames, k % 7 AS jank, dur % 50 AS p95_ms, dur % 90 AS p99_ms FROM ctx WHERE type = 'ui')"""


def ui_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_type(spark, sf_dir, "ui").select("*", F.lit(1000).alias("window_ms"), F.lit(60).alias("frames"), (F.col("k") % 7).alias("jank"),
                                              (F.col("dur") % 50).alias("p95_ms"), (F.col("dur") % 90).alias("p99_ms"))


#: Main-thread stalls stand behind every fourth click.
STALL_SQL = """stalls AS (SELECT *, 'stack' || (k % 3) AS stack FROM ctx WHERE type = 'call' AND k % 4 = 0)"""


def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_type(spark, sf_dir, "call").filter(F.col("k") % 4 == 0).select("*", F.concat(F.lit("stack"), (F.col("k") % 3).cast("string")).alias("stack"))


#: Retained objects stand behind every third click.
RETAINED_SQL = """retained AS (
  SELECT *, CASE k % 5 WHEN 0 THEN 'com.app.FeedActivity' WHEN 1 THEN 'com.app.FeedPresenter' WHEN 2 THEN 'com.app.PhotoBitmap'
                       WHEN 3 THEN 'android.view.TextView' ELSE 'com.app.OrdersFragment' END AS class,
         CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'com.app.Holder' || (user_id % 4) END AS holder,
         dur * 20 AS age_ms, 1 + k % 3 AS n, CASE WHEN k % 4 = 2 THEN 'confirmed' ELSE 'time_only' END AS evidence
  FROM ctx WHERE type = 'call' AND k % 3 = 0)"""


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = (F.when(k % 5 == 0, "com.app.FeedActivity").when(k % 5 == 1, "com.app.FeedPresenter").when(k % 5 == 2, "com.app.PhotoBitmap")
            .when(k % 5 == 3, "android.view.TextView").otherwise("com.app.OrdersFragment"))
    return of_type(spark, sf_dir, "call").filter(k % 3 == 0).select(
        "*", name.alias("class"), F.when(k % 2 == 0, "unknown").otherwise(F.concat(F.lit("com.app.Holder"), (F.col("user_id") % 4).cast("string"))).alias("holder"),
        (F.col("dur") * 20).alias("age_ms"), (1 + k % 3).alias("n"), F.when(k % 4 == 2, "confirmed").otherwise("time_only").alias("evidence"))


#: Log bursts stand behind every second view.
SPAM_SQL = """spam AS (SELECT *, 'Logger' || (user_id % 6) AS log_source, k % 6 AS level, 20 + dur % 60 AS n FROM ctx WHERE type = 'ui' AND k % 2 = 0)"""


def log_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_type(spark, sf_dir, "ui").filter(F.col("k") % 2 == 0).select(
        "*", F.concat(F.lit("Logger"), (F.col("user_id") % 6).cast("string")).alias("log_source"), (F.col("k") % 6).alias("level"), (20 + F.col("dur") % 60).alias("n"))


#: Runtime calls: the owner calls a service.
CALL_SQL = """calls AS (SELECT *, owner AS caller, 'com.app.Service' || (k % 9) || '.go' AS callee, 1 + k % 5 AS n, dur * (1 + k % 5) AS total_ms FROM ctx WHERE type = 'call')"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 1 + F.col("k") % 5
    return of_type(spark, sf_dir, "call").select(
        "*", F.col("owner").alias("caller"), F.concat(F.lit("com.app.Service"), (F.col("k") % 9).cast("string"), F.lit(".go")).alias("callee"),
        n.alias("n"), (F.col("dur") * n).alias("total_ms"))


#: Device context and memory samples; traffic counters grow with the row and reset now and then.
DEVICE_SQL = """device AS (
  SELECT *, k % 101 AS battery, CASE WHEN k % 13 = 0 THEN 0 ELSE 200000 + dur * 50 END AS ram_kb, 100000 + dur * 100 AS pss_kb,
         (ord * 7) % 100000 AS rx, (ord * 3) % 50000 AS tx, CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'wifi' WHEN 2 THEN 'cellular' ELSE 'other' END AS network,
         k % 17 = 0 AS low_memory FROM ctx WHERE type = 'memory')"""


def device(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return of_type(spark, sf_dir, "memory").select(
        "*", (k % 101).alias("battery"), F.when(k % 13 == 0, F.lit(0)).otherwise(200000 + F.col("dur") * 50).alias("ram_kb"), (100000 + F.col("dur") * 100).alias("pss_kb"),
        ((F.col("ord") * 7) % 100000).alias("rx"), ((F.col("ord") * 3) % 50000).alias("tx"),
        F.when(k % 4 == 0, "none").when(k % 4 == 1, "wifi").when(k % 4 == 2, "cellular").otherwise("other").alias("network"), (k % 17 == 0).alias("low_memory"))


#: Counters and gauges stand behind all clicks.
METRIC_SQL = """metrics AS (
  SELECT *, CASE k % 5 WHEN 0 THEN 'feed.load.avg' WHEN 1 THEN 'queue.depth.last' WHEN 2 THEN 'sync.enabled' WHEN 3 THEN 'jankstats.frames' ELSE 'app.state' END AS name,
         CASE k % 5 WHEN 0 THEN 'average' WHEN 1 THEN 'last' WHEN 2 THEN 'boolean' WHEN 3 THEN 'counter' ELSE 'state' END AS mode,
         CASE WHEN k % 5 = 2 THEN k % 2 ELSE dur END AS v, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 3 END AS n FROM ctx WHERE type = 'call')"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("k") % 5
    pick = lambda *xs: F.when(m == 0, xs[0]).when(m == 1, xs[1]).when(m == 2, xs[2]).when(m == 3, xs[3]).otherwise(xs[4])
    return of_type(spark, sf_dir, "call").select(
        "*", pick("feed.load.avg", "queue.depth.last", "sync.enabled", "jankstats.frames", "app.state").alias("name"),
        pick("average", "last", "boolean", "counter", "state").alias("mode"),
        F.when(m == 2, (F.col("k") % 2).cast("bigint")).otherwise(F.col("dur")).alias("v"), (F.col("k") % 3).alias("n"))


def sql(*views: str, body: str) -> str:
    """The oracle's SQL: the views it needs, then its body."""
    return f"WITH {', '.join([TEL_SQL, CTX_SQL, *views])}\n{body}"


#: All signals of an event side by side, null where the type doesn't have them.
WIDE_SQL = """wide AS (
  SELECT *, CASE WHEN type = 'ui' THEN 60 END AS frames, CASE WHEN type = 'ui' THEN k % 7 END AS jank, CASE WHEN type = 'call' AND k % 4 = 0 THEN dur END AS stall_ms,
         CASE WHEN type = 'memory' THEN 100000 + dur * 100 END AS pss_kb, CASE WHEN type = 'memory' THEN CASE WHEN k % 13 = 0 THEN 0 ELSE 200000 + dur * 50 END END AS ram_kb,
         CASE WHEN type = 'memory' THEN (ord * 7) % 100000 END AS rx, CASE WHEN type = 'memory' THEN (ord * 3) % 50000 END AS tx FROM ctx)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ui, mem, k = F.col("type") == "ui", F.col("type") == "memory", F.col("k")
    return events(spark, sf_dir).select(
        "*", F.when(ui, 60).alias("frames"), F.when(ui, k % 7).alias("jank"), F.when((F.col("type") == "call") & (k % 4 == 0), F.col("dur")).alias("stall_ms"),
        F.when(mem, 100000 + F.col("dur") * 100).alias("pss_kb"), F.when(mem, F.when(k % 13 == 0, F.lit(0)).otherwise(200000 + F.col("dur") * 50)).alias("ram_kb"),
        F.when(mem, (F.col("ord") * 7) % 100000).alias("rx"), F.when(mem, (F.col("ord") * 3) % 50000).alias("tx"))


#: Heap evidence stands behind every fifth click: parties, root and path of each distinct leak.
HEAP_SQL = """heap_raw AS (
  SELECT run_set, class, holder, field, root, max(kb) AS kb, CAST(sum(objects) AS BIGINT) AS objects, count(*) - 1 AS alternatives FROM (
    SELECT run_set, CASE k % 4 WHEN 0 THEN 'com.app.FeedActivity' WHEN 1 THEN 'com.app.PhotoBitmap' WHEN 2 THEN 'com.app.OrdersFragment' ELSE 'com.app.Cached$Item' END AS class,
           CASE WHEN user_id % 5 = 4 THEN '' ELSE 'com.app.Holder' || (user_id % 5) END AS holder, CASE k % 3 WHEN 0 THEN 'com.app.Screen.mContext' WHEN 1 THEN 'clickListener' ELSE '' END AS field,
           CASE k % 7 WHEN 0 THEN 'sticky class' WHEN 1 THEN 'JNI global' WHEN 2 THEN 'Java frame' WHEN 3 THEN 'monitor used' WHEN 4 THEN 'reference cleanup' WHEN 5 THEN 'VM internal' ELSE '' END AS root,
           dur * 9 AS kb, k % 4 AS objects FROM ctx WHERE type = 'call' AND k % 5 = 0) GROUP BY ALL),
  heap AS (SELECT *, CASE WHEN root = '' THEN [] ELSE [{'class': 'GC root: ' || root, 'field': '', 'kind': 'gc_root'}, {'class': 'androidx.lifecycle.ViewModelStore', 'field': 'map', 'kind': 'field'},
    {'class': CASE WHEN holder = '' THEN 'java.util.HashMap' ELSE holder END, 'field': 'callback', 'kind': 'static'}, {'class': class, 'field': field, 'kind': 'field'}] END AS path FROM heap_raw)"""


def heap_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    raw = of_type(spark, sf_dir, "call").filter(k % 5 == 0).select(
        "run_set", pick(4, "com.app.FeedActivity", "com.app.PhotoBitmap", "com.app.OrdersFragment", "com.app.Cached$Item").alias("class"),
        F.when(u % 5 == 4, "").otherwise(F.concat(F.lit("com.app.Holder"), (u % 5).cast("string"))).alias("holder"), pick(3, "com.app.Screen.mContext", "clickListener", "").alias("field"),
        pick(7, "sticky class", "JNI global", "Java frame", "monitor used", "reference cleanup", "VM internal", "").alias("root"), (F.col("dur") * 9).alias("kb"), (k % 4).alias("objects"))
    raw = raw.groupBy("run_set", "class", "holder", "field", "root").agg(F.max("kb").alias("kb"), F.sum("objects").alias("objects"), (F.count(F.lit(1)) - 1).alias("alternatives"))
    step = lambda c, f, kind: F.struct(c.alias("class"), f.alias("field"), F.lit(kind).alias("kind"))
    path = F.array(step(F.concat(F.lit("GC root: "), "root"), F.lit(""), "gc_root"), step(F.lit("androidx.lifecycle.ViewModelStore"), F.lit("map"), "field"),
                   step(F.when(F.col("holder") == "", "java.util.HashMap").otherwise(F.col("holder")), F.lit("callback"), "static"), step(F.col("class"), F.col("field"), "field"))
    return raw.withColumn("path", F.when(F.col("root") == "", F.array().cast("array<struct<class:string,field:string,kind:string>>")).otherwise(path))


#: Phases of HTTP calls, as expressions of the row.
PHASES = "CASE WHEN k % 6 = 0 THEN 10 + dur % 240 ELSE 0 END AS dns_ms, CASE WHEN k % 5 = 0 THEN 20 + dur % 300 ELSE 0 END AS connect_ms, dur // 2 AS ttfb_ms, failed AND k % 3 = 0 AS server_error"


def phases(rows: DataFrame) -> DataFrame:
    k, dur = F.col("k"), F.col("dur")
    return rows.select("*", F.when(k % 6 == 0, 10 + dur % 240).otherwise(0).alias("dns_ms"), F.when(k % 5 == 0, 20 + dur % 300).otherwise(0).alias("connect_ms"),
                       F.floor(dur / 2).cast("bigint").alias("ttfb_ms"), (F.col("failed") & (k % 3 == 0)).alias("server_error"))


#: Names of network metrics, as an expression of the row.
NET_NAMES = ["network.route.get_r1.dns.lookup.count", "network.route.post_x.connect.attempt.count", "network.retry_or_reconnect.count", "websocket.chat.reconnect.count",
             "websocket.get_feed.failure.count", "network.route.get_a.started.count", "network.failed.count.5xx", "app.other", "network.dns_attempts.max"]
NET_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in NET_NAMES) + f"][k % {len(NET_NAMES)} + 1]"


def net_metrics(rows: DataFrame) -> DataFrame:
    """Clicks as samples of network metrics; every other one is a gauge."""
    k = F.col("k")
    return rows.filter("type = 'call'").select("*", F.element_at(F.array(*map(F.lit, NET_NAMES)), (k % len(NET_NAMES) + 1).cast("int")).alias("name"), (k % 2 == 0).alias("gauge"), (k % 4).alias("value"))
