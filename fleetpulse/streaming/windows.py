"""Pre-aggregators of raw signals: the W family as Structured Streaming jobs and as batches.

Each function takes and returns a DataFrame, streaming or not; event time is ``ts``.  Late rows beyond the watermark are
dropped by Spark and show in the query's progress as numRowsDroppedByWatermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.streaming import steps
from fleetpulse.streaming.stateful import IDLE_MS, replay

#: Fixed values of the collectors: metric and log windows, retention delay, slow HTTP, wrapped work.
WINDOW, DELAY_S, HTTP_SLOW_MS, WRAPPED_MS = "5 seconds", 5, 1000, 250


def metric_windows(samples: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Counters and gauges (process_id, ts, kind, name, value, mode) per window; invalid values are counted apart."""
    valid = F.col("value") >= 0
    last = F.max_by("value", "ts")
    return samples.withWatermark("ts", late).groupBy(F.window("ts", WINDOW).alias("w"), "process_id", "kind", "name").agg(
        F.sum(F.when(valid, F.col("value")).otherwise(0)).alias("sum"), F.count_if(valid).alias("count"), F.max(F.when(valid, F.col("value"))).alias("max"), last.alias("last"), F.count_if(~valid).alias("invalid"))


def log_windows(calls: DataFrame, late: str = "10 seconds") -> DataFrame:
    """W04."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", WINDOW).alias("w"), "process_id", "screen", "owner", "flow", "step", "source", "level").agg(F.count(F.lit(1)).alias("count"))


def method_counters(spans: DataFrame, late: str = "10 seconds") -> DataFrame:
    """W06."""
    return spans.filter("op = 'enter'").withWatermark("ts", late).groupBy(F.window("ts", WINDOW).alias("w"), "process_id", "method_id").agg(F.count(F.lit(1)).alias("calls"))


def first_watches(watched: DataFrame, late: str = "10 seconds") -> DataFrame:
    """An object that is watched again while it is watched counts once."""
    if watched.isStreaming:
        return watched.withWatermark("ts", late).dropDuplicatesWithinWatermark(["object_id"])
    return watched.groupBy("object_id").agg(F.min_by(F.struct(*watched.columns), "ts").alias("w")).select("w.*").withWatermark("ts", late)


def retained_objects(watched: DataFrame, cleared: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Objects that were not cleared within the delay after they were watched: a left outer stream join.

    watched has object_id, ts and its class and owner; cleared has object_id and ts.
    """
    w = first_watches(watched, late).alias("w")
    c = cleared.select(F.col("object_id").alias("c_id"), F.col("ts").alias("c_ts")).withWatermark("c_ts", late).alias("c")
    on = (F.col("w.object_id") == F.col("c_id")) & F.col("c_ts").between(F.col("w.ts"), F.col("w.ts") + F.expr(f"interval {DELAY_S} seconds"))
    return w.join(c, on, "leftOuter").filter("c_id is null").drop("c_id", "c_ts")


#: Evidence of retention, weakest first.
EVIDENCE = ["time_only", "gc_requested", "confirmed"]


def retained_groups(objects: DataFrame, keys: int = steps.WINDOW_KEYS) -> DataFrame:
    """Retained objects (ts, process_id, class, owner, evidence) of a window by class and owner: count and weakest evidence.

    A window reports the first ``keys`` groups by name; the objects of all others are its losses, in a row without a class.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EVIDENCE)), F.col("evidence")), F.lit(0))
    w = objects.groupBy(F.window("ts", WINDOW).alias("w"), "process_id", "class", "owner").agg(F.count(F.lit(1)).alias("count"), F.min_by("evidence", rank).alias("evidence"))
    group = F.struct("class", "owner", "count", "evidence")
    whole = w.groupBy("w", "process_id").agg(F.sort_array(F.collect_list(group)).alias("groups"))  # an object is one row, so a window of 5 s bounds the list
    lost = F.aggregate(F.slice("groups", keys + 1, 1 << 30), F.lit(0).cast("bigint"), lambda n, g: n + g["count"])
    rest = F.when(F.size("groups") > keys, F.array(F.struct(F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("owner"), lost.alias("count"), F.lit(None).cast("string").alias("evidence")))).otherwise(F.array().cast("array<struct<class:string,owner:string,count:bigint,evidence:string>>"))
    return whole.select("w", "process_id", F.inline(F.concat(F.slice("groups", 1, keys), rest)))


def ui_problem() -> Column:
    """Windows that count as janky."""
    return (F.col("jank") > 0) | (F.col("p95_ms") >= 32)


def slow_request() -> Column:
    """W08."""
    return F.col("duration_ms") >= HTTP_SLOW_MS


def wrapped_problem() -> Column:
    """W19."""
    return F.col("failed") | (F.col("duration_ms") >= WRAPPED_MS)


# ---- in order of arrival: batches of the steps; ``stateful.follow`` runs the same steps over streams --------------------


def frame_windows(frames: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """W01 over a batch (process_id, ms, ord, screen, duration_ms, is_jank)."""
    return replay(frames, ["process_id"], steps.Frames(), idle_ms)


def call_graph(spans: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """W05 over a batch (process_id, thread_id, ms, ord, op, method_id): edges with count, total and largest duration; exits
    that matched no top frame are counted in a row without a caller."""
    key = ["process_id", "thread_id"]
    seen = replay(spans, key, steps.Calls(), idle_ms)
    return seen.groupBy(*key, "caller", F.when(~F.col("mismatch"), F.col("callee")).alias("callee")).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("took_ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.max("took_ms"), F.lit(0)).alias("max_ms"))


def capped_windows(rows: DataFrame, keys: int = steps.WINDOW_KEYS, window_ms: int = steps.WINDOW_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """W03, W04 over a batch (process_id, ms, ord, key, value) with the cap on keys of a window and the row of its losses."""
    return replay(rows, ["process_id"], steps.CappedWindows(keys, window_ms), idle_ms)


# ---- pairings and deltas by order of arrival ---------------------------------------------------------------------------


def stall_episodes(beats: DataFrame, least_ms: int = 700) -> DataFrame:
    """W09 over a batch (process_id, ms, ord): gaps between heartbeats of ``least_ms`` at least."""
    w = Window.partitionBy("process_id").orderBy("ms", "ord")
    gap = F.lead("ms").over(w) - F.col("ms")
    return beats.select("process_id", F.col("ms").alias("start_ms"), gap.alias("duration_ms")).filter(F.col("duration_ms") >= least_ms)


def http_calls(phases: DataFrame) -> DataFrame:
    """One row for each call of its phase events (call_id, phase, part, key, ms, ord, bytes, failed).

    part is start or end.  DNS and connect attempts pair first in, first out by their key; the call starts with its first
    event, ends with its first terminal one (phase ``call``, part ``end``), and failed if that or a phase did.  What comes
    after that end is ignored.  ``steps.HttpCalls`` is the same over a stream, with calls that never end.
    """
    over = F.min(F.when((F.col("phase") == "call") & (F.col("part") == "end"), F.struct("ms", "ord"))).over(Window.partitionBy("call_id"))
    phases = phases.withColumn("over", over).filter(F.col("over").isNull() | (F.struct("ms", "ord") <= F.col("over"))).drop("over")
    attempt = F.row_number().over(Window.partitionBy("call_id", "phase", "key", "part").orderBy("ms", "ord"))
    pairs = phases.filter(F.col("phase").isin("dns", "connect")).withColumn("attempt", attempt)
    at = lambda part: F.max(F.when(F.col("part") == part, F.col("ms")))
    pairs = pairs.groupBy("call_id", "phase", "key", "attempt").agg((at("end") - at("start")).alias("took")).filter("took is not null")
    spent = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.greatest("took", F.lit(0)))), F.lit(0))
    paired = pairs.groupBy("call_id").agg(spent("dns").alias("dns_ms"), spent("connect").alias("connect_ms"))
    is_end = (F.col("phase") == "call") & (F.col("part") == "end")
    tries = F.count_if((F.col("phase") == "connect") & (F.col("part") == "start"))
    whole = phases.groupBy("call_id").agg(F.min("ms").alias("start_ms"), F.min(F.when(is_end, F.col("ms"))).alias("end_ms"), F.min(F.when(F.col("phase") == "first_byte", F.col("ms"))).alias("first_byte"),
                                          F.sum("bytes").alias("bytes"), tries.alias("attempts"), F.bool_or("failed").alias("failed"))
    out = whole.filter("end_ms is not null").join(paired, "call_id", "left").fillna(0, ["dns_ms", "connect_ms"])
    ttfb = F.coalesce(F.greatest(F.col("first_byte") - F.col("start_ms"), F.lit(0)), F.lit(0))
    return out.select("call_id", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "dns_ms", "connect_ms", ttfb.alias("ttfb_ms"), "bytes", "attempts", (F.col("attempts") <= 1).alias("single_attempt"), "failed")


def dispatches(lines: DataFrame, least_ms: int = 16) -> DataFrame:
    """W10 of (process_id, ms, ord, line): start and end lines in pairs of ``least_ms`` at least, with what was dispatched."""
    w = Window.partitionBy("process_id").orderBy("ms", "ord")
    start = F.startswith("line", F.lit(">>>>> Dispatching"))
    rows = lines.filter(start | F.startswith("line", F.lit("<<<<< Finished"))).select("*", F.lag("ms").over(w).alias("p_ms"), F.lag("line").over(w).alias("p_line"))
    target = F.trim(F.regexp_extract("p_line", " to ([^{}:]*)", 1))
    took = F.greatest(F.col("ms") - F.col("p_ms"), F.lit(0))
    pairs = rows.filter(F.startswith("line", F.lit("<<<<<")) & F.startswith("p_line", F.lit(">>>>>")) & (took >= least_ms))
    return pairs.select("process_id", F.col("p_ms").alias("start_ms"), took.alias("duration_ms"), F.when(target == "", "unknown").otherwise(target).alias("target"))


def sockets(rows: DataFrame) -> DataFrame:
    """W16 of (socket, ms, ord, event, code): opens, reconnects (opened again, or after a failure), failures, distinct close
    codes and the lifetime of each socket's key."""
    w = Window.partitionBy("socket").orderBy("ms", "ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_open, ends = F.col("event") == "open", F.col("event").isin("closed", "failure")
    opened = F.last(F.when(is_open, F.col("ms")), ignorenulls=True).over(before)
    r = rows.select("*", F.coalesce(F.max(is_open).over(before), F.lit(False)).alias("again"), opened.alias("opened"))
    return r.groupBy("socket").agg(F.count_if(is_open).alias("opens"), F.count_if(is_open & F.col("again")).alias("reconnects"), F.count_if(F.col("event") == "failure").alias("failures"),
                                   F.count_distinct(F.when(F.col("event").isin("closing", "closed"), F.col("code"))).alias("close_codes"), F.coalesce(F.sum(F.when(ends, F.greatest(F.col("ms") - F.col("opened"), F.lit(0)))), F.lit(0)).alias("lifetime_ms"))


def counter_rates(rows: DataFrame, counters: list[str], rate: str) -> DataFrame:
    """W17 of (process_id, ms, ord, cumulative counters): growth since the sample before (0 after a reset), and the growth
    of ``rate`` for each second."""
    w = Window.partitionBy("process_id").orderBy("ms", "ord")
    grown = {c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in counters}
    elapsed = F.greatest(F.col("ms") - F.lag("ms").over(w), F.lit(1))
    out = rows.select("process_id", "ms", "ord", *[g.alias(f"d_{c}") for c, g in grown.items()], elapsed.alias("elapsed"), F.lag("ms").over(w).alias("before")).filter("before is not null")
    return out.withColumn("per_second", F.floor(F.col(f"d_{rate}") * 1000 / F.col("elapsed")).cast("bigint")).drop("elapsed", "before")


def cpu_shares(rows: DataFrame, cores: int = 8) -> DataFrame:
    """W18 of (process_id, ms, ord, own, total, idle) cumulative ticks: hundredths of a percent of the device, of a core,
    and how busy the device was; samples with invalid growth are dropped, but the next one counts from them."""
    w = Window.partitionBy("process_id").orderBy("ms", "ord")
    d = {c: F.col(c) - F.lag(c).over(w) for c in ("own", "total", "idle")}
    r = rows.select("process_id", "ms", "ord", *[x.alias(f"d_{c}") for c, x in d.items()]).filter("d_own >= 0 and d_total > 0 and d_idle >= 0")
    part = lambda x: F.floor(x * 10000 / F.col("d_total")).cast("bigint")
    return r.select("process_id", "ms", "ord", part(F.col("d_own")).alias("of_device"), part(F.col("d_own") * cores).alias("of_core"), F.least(part(F.greatest(F.col("d_total") - F.col("d_idle"), F.lit(0))), F.lit(10000)).alias("busy"))


def screen_durations(rows: DataFrame) -> DataFrame:
    """W15 of (process_id, activity, ms, ord, event): time from created to resumed, resumed to paused, started to stopped and
    created to destroyed, each end counted from the last such start before it."""
    pairs = [("created", "resumed"), ("resumed", "paused"), ("started", "stopped"), ("created", "destroyed")]
    before = Window.partitionBy("process_id", "activity").orderBy("ms", "ord").rowsBetween(Window.unboundedPreceding, -1)
    last = {s: F.last(F.when(F.col("event") == s, F.col("ms")), ignorenulls=True).over(before).alias(f"l_{s}") for s in ("created", "resumed", "started")}
    r = rows.select("*", *last.values())
    spans = F.array_compact(F.array(*[F.when((F.col("event") == e) & F.col(f"l_{s}").isNotNull(), F.struct(F.lit(f"{s}_{e}").alias("span"), (F.col("ms") - F.col(f"l_{s}")).alias("took"))) for s, e in pairs]))
    return r.select("activity", F.inline(spans)).groupBy("activity", "span").agg(F.count(F.lit(1)).alias("n"), F.sum("took").alias("total_ms"), F.max("took").alias("max_ms"))


def latest_snapshots(segments: DataFrame) -> DataFrame:
    """W20 of (source, sequence, bytes, sealed, ...): what is known last of each file; a later read supersedes an open one."""
    w = Window.partitionBy("source").orderBy(F.desc("sequence"), F.desc("bytes"))
    return segments.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def kept_samples(rows: DataFrame, limits: dict[str, int], marks: list[str] = [], flags: list[str] = [], idle_ms: int = IDLE_MS) -> DataFrame:  # noqa: B006
    """W12 over a batch (process_id, ms, ord and the named columns): samples that differ from the last kept one."""
    return replay(rows, ["process_id"], steps.Samples(limits, marks, flags), idle_ms)


def flow_scopes(rows: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """W14 over a batch (process_id, thread_id, ms, ord, op, name): the flow and step after each start, step or end."""
    return replay(rows, ["process_id", "thread_id"], steps.Scopes(), idle_ms)
