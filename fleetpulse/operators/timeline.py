"""Run-relative, gap-filled timelines and what is computed on them: M, I, K and C families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import counter_delta, int_div, nearest_rank

#: Bucket sizes in seconds to choose from, and the most buckets of a run set.
SCALES = [1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600]
MOST_BUCKETS = 50_000
#: Latency that hurts, low memory and growth over the PSS floor, as in the load scores.
PAIN_MS, LOW_RAM_KB, GROWTH_KB = 300, 256 * 1024, 32 * 1024


def relative(events: DataFrame, run: str = "source") -> DataFrame:
    """Time since the first event of the event's run, over all of its types."""
    starts = events.groupBy("run_set", run).agg(F.min("time_ms").alias("t0"))
    return events.join(starts, ["run_set", run]).withColumn("rel_ms", F.greatest(F.col("time_ms") - F.col("t0"), F.lit(0))).drop("t0")


def bucket_size(duration_ms: Column) -> Column:
    """The least scale with at most MOST_BUCKETS buckets, beyond an hour whole hours."""
    out = F.ceil(duration_ms / (3_600_000.0 * MOST_BUCKETS)) * 3_600_000
    for s in reversed(SCALES):
        out = F.when(F.floor(duration_ms / (s * 1000)) + 1 <= MOST_BUCKETS, F.lit(s * 1000)).otherwise(out)
    return out.cast("bigint")


def timeline(events: DataFrame) -> DataFrame:
    """All buckets of each run set with HTTP, UI, stall and memory figures.

    Takes the adapter's events with rel_ms and, where they apply, jank, frames, stall_ms, pss_kb, ram_kb, rx, tx.
    """
    scale = events.groupBy("run_set").agg(F.max("rel_ms").alias("span")).select("run_set", bucket_size(F.col("span")).alias("size"), "span")
    by_log = Window.partitionBy("run_set", "source").orderBy("ord")
    counted = [F.when(F.col("type") == "memory", F.col(c)) for c in ("rx", "tx")]
    before = [F.last(c, ignorenulls=True).over(by_log.rowsBetween(Window.unboundedPreceding, -1)) for c in counted]
    rows = events.select("*", *[F.when(b.isNotNull(), F.coalesce(counter_delta(c, b), F.lit(0))).otherwise(0).alias(f"d_{n}") for c, b, n in zip(counted, before, ("rx", "tx"))])
    rows = rows.join(F.broadcast(scale), "run_set").withColumn("bucket", int_div(F.col("rel_ms"), F.col("size")))
    http = F.when(F.col("type") == "http", F.col("dur"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    some = rows.groupBy("run_set", "bucket").agg(
        F.count(http).alias("http"), F.count_if((F.col("type") == "http") & F.col("failed")).alias("http_failed"), zero(int_div(F.sum(http), F.count(http))).alias("http_avg_ms"),
        zero(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY case when type = 'http' then dur end)")).alias("http_p95_ms"),
        zero(F.sum("frames")).alias("frames"), zero(F.sum("jank")).alias("jank"), F.count("stall_ms").alias("stalls"), zero(F.max("stall_ms")).alias("stall_max_ms"),
        zero(F.max("pss_kb")).alias("pss_kb"), zero(F.min(F.when(F.col("ram_kb") > 0, F.col("ram_kb")))).alias("ram_kb"), zero(F.sum("d_rx")).alias("rx"), zero(F.sum("d_tx")).alias("tx"))
    every = scale.select("run_set", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(F.col("span"), F.col("size")))).alias("bucket"))
    out = every.join(some, ["run_set", "bucket"], "left")
    return out.fillna(0, [c for c in out.columns if c not in ("run_set", "bucket", "size")])


def top_sample(events: DataFrame, col: str) -> DataFrame:
    """The most frequent value of each bucket, the least one on ties."""
    n = events.groupBy("run_set", "bucket", col).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("run_set", "bucket").agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias(col))


SERIES = ["http", "http_failed", "http_avg_ms", "http_p95_ms", "frames", "jank", "stalls", "stall_max_ms", "pss_kb", "ram_kb", "rx", "tx"]


def series(buckets: DataFrame) -> DataFrame:
    """Long form of the signals; a signal that is 0 everywhere is left out."""
    long = buckets.unpivot(["run_set", "bucket"], SERIES, "signal", "value")
    live = long.groupBy("run_set", "signal").agg(F.max(F.abs("value")).alias("m")).filter("m > 0").select("run_set", "signal")
    return long.join(F.broadcast(live), ["run_set", "signal"])


def jank_pct() -> Column:
    return F.when(F.col("frames") > 0, F.col("jank") * 100.0 / F.col("frames")).otherwise(0.0)


def with_floor(buckets: DataFrame) -> DataFrame:
    """The least PSS above 0 of a run set, 0 where there is none."""
    floor = buckets.groupBy("run_set").agg(F.coalesce(F.min(F.when(F.col("pss_kb") > 0, F.col("pss_kb"))), F.lit(0)).alias("pss_floor"))
    return buckets.join(F.broadcast(floor), "run_set")


def with_loops(buckets: DataFrame, loops: DataFrame | None) -> DataFrame:
    """The largest confidence (0.35 at least) of the loops (run_set, first_ms, last_ms, confidence) around a bucket's
    start, else 0.  A run set keeps eight loops at most, so they ride along as one small array."""
    if loops is None:
        return buckets.withColumn("loop_confidence", F.lit(0.0))
    few = loops.filter("confidence >= 0.35").groupBy("run_set").agg(F.collect_list(F.struct("first_ms", "last_ms", "confidence")).alias("loops"))
    at = F.col("bucket") * F.col("size")
    around = F.filter("loops", lambda x: (x["first_ms"] <= at) & (at <= x["last_ms"]))
    best = F.array_max(F.transform(around, lambda x: x["confidence"]))
    return buckets.join(F.broadcast(few), "run_set", "left").withColumn("loop_confidence", F.coalesce(best, F.lit(0.0))).drop("loops")


def symptoms(b: DataFrame) -> DataFrame:
    """The weighted symptoms of each bucket in order of dominance, as an array (rank, state, weight).

    Takes a timeline with pss_floor and loop_confidence; dns_ms and connect_ms (averages) where they are known.
    """
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.05), c))
    of = lambda rank, state, when, weight: F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(state).alias("state"), weight.alias("weight")))
    at_most = lambda *pairs: F.greatest(*[F.when(w, clamp(v)).otherwise(0.0) for w, v in pairs])
    grown = (F.col("pss_floor") > 0) & (F.col("pss_kb") >= F.col("pss_floor") + GROWTH_KB)
    short = (F.col("ram_kb") > 0) & (F.col("ram_kb") < LOW_RAM_KB)
    memory = at_most((grown, (F.col("pss_kb") - F.col("pss_floor")) / (128.0 * 1024)), (short, (LOW_RAM_KB - F.col("ram_kb")) / float(LOW_RAM_KB)))
    slow = [(F.col("http_failed") > 0, 0.75 + F.col("http_failed") * 0.1), ((F.col("http") > 0) & (F.col("http_p95_ms") >= 500), (F.col("http_p95_ms") - 300) / 1000.0)]
    if "dns_ms" in b.columns:
        slow += [(F.col("dns_ms") >= 100, (F.col("dns_ms") - 50) / 500.0), (F.col("connect_ms") >= 150, (F.col("connect_ms") - 100) / 700.0)]
    every = F.array(of(0, "network_loop", F.col("loop_confidence") >= 0.35, clamp(F.col("loop_confidence"))), of(1, "stalled", F.col("stalls") > 0, clamp(0.65 + F.col("stalls") * 0.1 + F.col("stall_max_ms") / 3000.0)),
                    of(2, "memory_pressure", grown | short, memory), of(3, "janky", jank_pct() >= 5, clamp(jank_pct() / 20)), of(4, "network_slow", at_most(*slow) > 0, at_most(*slow)))
    return b.withColumn("symptoms", F.array_compact(every))


def states(buckets: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """The dominant symptom's state of each bucket and its weight, and recovering right after a bad bucket.

    loops (run_set, first_ms, last_ms, confidence) and the timeline's dns_ms and connect_ms count where they are given.
    """
    b = symptoms(with_loops(with_floor(buckets), loops)).withColumn("first", F.get("symptoms", F.lit(0)))
    b = b.withColumns({"raw": F.coalesce("first.state", F.lit("healthy")), "weight": F.coalesce("first.weight", F.lit(0.0))})
    after_bad = F.coalesce(F.lag(F.col("raw") != "healthy").over(Window.partitionBy("run_set").orderBy("bucket")), F.lit(False))
    return b.withColumns({"state": F.when((F.col("raw") == "healthy") & after_bad, "recovering").otherwise(F.col("raw")), "bad": F.col("raw") != "healthy"}).drop("first")


def transitions(s: DataFrame) -> DataFrame:
    """How often one state follows another, with the share of its row."""
    nxt = F.lead("state").over(Window.partitionBy("run_set").orderBy("bucket"))
    n = s.select("run_set", F.col("state").alias("from_state"), nxt.alias("to_state")).filter("to_state is not null").groupBy("run_set", "from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("probability", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("run_set", "from_state")), 6))


def transition_summary(t: DataFrame) -> DataFrame:
    """Healthy to bad moves, and how likely a bad state ends (1 where there is none)."""
    ok = lambda c: F.col(c).isin("healthy", "recovering")
    bad = F.sum(F.when(~ok("from_state"), F.col("count")).otherwise(0))
    end = F.sum(F.when(~ok("from_state") & ok("to_state"), F.col("count")).otherwise(0))
    return t.groupBy("run_set").agg(F.sum(F.when(ok("from_state") & ~ok("to_state"), F.col("count")).otherwise(0)).alias("healthy_to_bad"), F.round(F.when(bad > 0, end / bad).otherwise(1.0), 6).alias("recovery_probability"))


def episodes(s: DataFrame) -> DataFrame:
    """Runs of bad buckets; those that touch the end are open and don't count for the expected recovery."""
    seq = Window.partitionBy("run_set").orderBy("bucket")
    island = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(seq)
    rows = s.withColumn("island", island).withColumn("last", F.max("bucket").over(Window.partitionBy("run_set")))
    each = rows.filter("bad").groupBy("run_set", "island").agg(F.count(F.lit(1)).alias("n"), F.max("bucket").alias("end"), F.max("last").alias("last"), F.max("size").alias("size"))
    closed = F.when(F.col("end") < F.col("last"), F.col("n"))
    return each.groupBy("run_set").agg(F.count(F.lit(1)).alias("episodes"), F.round(F.coalesce(F.avg(closed), F.lit(0.0)), 6).alias("recovery_windows"),
                                       F.round(F.coalesce(F.avg(closed * F.col("size")), F.lit(0.0)), 6).alias("recovery_ms"), F.max("n").alias("longest"))


def exposure(s: DataFrame) -> DataFrame:
    """Share of time in each bad state."""
    total = s.groupBy("run_set").agg(F.count(F.lit(1)).alias("total"))
    return s.filter("bad").groupBy("run_set", "state").agg(F.count(F.lit(1)).alias("windows")).join(total, "run_set").select("run_set", "state", "windows", F.round(F.col("windows") / F.col("total"), 6).alias("share"))


def divergence(t: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits of the transition pairs of baseline and candidate."""
    share = F.col("count") / F.sum("count").over(Window.partitionBy("run_set"))
    p = t.withColumn("p", share).groupBy("from_state", "to_state").agg(*[F.coalesce(F.max(F.when(F.col("run_set") == s, F.col("p"))), F.lit(0.0)).alias(a) for s, a in (("baseline", "p"), ("candidate", "q"))])
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return p.agg(F.round(F.sum(half("p") + half("q")) / 2, 6).alias("divergence"), F.count(F.lit(1)).alias("pairs"))


def context_sticky(s: DataFrame, most: int = 5) -> DataFrame:
    """How often a bad state goes on in the same context (owner, route, screen, network; empty where unknown)."""
    w = Window.partitionBy("run_set").orderBy("bucket")
    context = F.concat_ws("|", *[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), c)) for c in ("owner", "route", "screen", "network")])
    rows = s.withColumn("context", context)
    rows = rows.withColumns({"n_state": F.lead("state").over(w), "n_context": F.lead("context").over(w)}).filter("n_state is not null and bad and context <> ''")
    same = (F.col("state") == F.col("n_state")) & (F.col("context") == F.col("n_context"))
    n = rows.groupBy("run_set", "state", "context").agg(F.count_if(same).alias("count"), F.count(F.lit(1)).alias("total")).filter("count > 0")
    n = n.withColumn("probability", F.round(F.col("count") / F.col("total"), 6))
    rank = F.row_number().over(Window.partitionBy("run_set").orderBy(F.desc("probability"), F.desc("count"), "state", "context"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= most).select("run_set", "state", "context", "count", "probability", "rank")


def model_summary(s: DataFrame) -> DataFrame:
    """One row per run set: windows, transitions, recovery, exposure, and how far the model can be trusted."""
    t = transitions(s)
    own = s.groupBy("run_set").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.when(F.col("bad"), 1.0).otherwise(0.0)), 6).alias("exposure"))
    sticky = F.max(F.when((F.col("from_state") == F.col("to_state")) & ~F.col("from_state").isin("healthy", "recovering"), F.col("probability")))
    moves = t.groupBy("run_set").agg(F.sum("count").alias("transitions"), F.coalesce(sticky, F.lit(0.0)).alias("stickiest"))
    j = own.join(moves, "run_set", "left").join(transition_summary(t), "run_set", "left").join(episodes(s).drop("longest"), "run_set", "left")
    j = j.fillna({"transitions": 0, "stickiest": 0.0, "healthy_to_bad": 0, "recovery_probability": 1.0, "episodes": 0, "recovery_windows": 0.0, "recovery_ms": 0.0})
    n, bad = F.col("windows"), F.col("episodes")
    j = j.withColumn("confidence", F.when((n < 4) | (F.col("transitions") < 3), "low").when((bad == 0) & (n >= 10), "high").when((bad == 0) | (n < 10) | (bad < 2), "medium").otherwise("high"))
    moved = F.col("healthy_to_bad") > 0
    status = (F.when(n < 2, "medium").when(moved & (F.col("recovery_probability") < 0.35), "high").when(F.col("stickiest") >= 0.70, "high").when(F.col("confidence") == "low", "medium")
              .when(moved | (F.col("recovery_windows") >= 3), "medium").otherwise("ok"))
    return j.withColumn("status", status)


#: Metric of the model, how its severity is told, whether more is worse.
MODEL_METRICS = [("healthy_to_bad", "count", True), ("recovery_probability", "share", False), ("recovery_windows", "count", True), ("recovery_ms", "duration", True), ("exposure", "share", True)]


def _change_severity(kind: str, change: Column, before: Column) -> Column:
    pct = F.when(before > 0, change * 100 / before).otherwise(0.0)
    if kind == "count":
        return F.when(change >= 3, "high").when(change >= 1, "medium").otherwise("ok")
    much, some = (25, 10) if kind == "share" else (5000, 1000)
    return F.when(change <= 0, "ok").when((change >= much) | (pct >= 50), "high").when((change >= some) | (pct >= 20), "medium").otherwise("ok")


def model_compare(s: DataFrame) -> DataFrame:
    """The model's metrics and the stickiness of each state (the three stickiest of a side), with severities; shares in percent."""
    m, t = model_summary(s), transitions(s)
    rows = m.select("run_set", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(k).alias("kind"), F.lit(w).alias("more_is_worse"), (F.col(n) * (100.0 if k == "share" else 1.0)).cast("double").alias("v")) for n, k, w in MODEL_METRICS])))
    stay = t.filter("from_state = to_state").withColumn("rank", F.row_number().over(Window.partitionBy("run_set").orderBy(F.desc("probability"), F.desc("count"), "from_state"))).filter("rank <= 3")
    rows = rows.unionByName(stay.select("run_set", F.concat(F.lit("sticky:"), "from_state").alias("metric"), F.lit("share").alias("kind"), F.lit(True).alias("more_is_worse"), (F.col("probability") * 100).alias("v")))
    j = rows.groupBy("metric", "kind", "more_is_worse").agg(*[F.coalesce(F.max(F.when(F.col("run_set") == side, F.col("v"))), F.lit(0.0)).alias(a) for side, a in (("baseline", "b"), ("candidate", "c"))])
    delta = F.round(F.col("c") - F.col("b"), 6)
    worse = F.when(F.col("more_is_worse"), delta).otherwise(-delta)
    severity = F.when(F.col("kind") == "count", _change_severity("count", worse, F.col("b"))).when(F.col("kind") == "share", _change_severity("share", worse, F.col("b"))).otherwise(_change_severity("duration", worse, F.col("b")))
    return j.select("metric", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("candidate"), delta.alias("delta"), severity.alias("severity"))


#: Medium and high limits of the load scores.
LIMITS = {"jank_pressure_area": (60, 180), "latency_pain_area": (500, 2000), "network_failure_burn": (5, 20), "memory_pressure_area": (128, 1024), "recovery_debt": (8, 30)}


def sore() -> Column:
    """Buckets that count for the recovery debt: jank, slow or failed calls, memory; stalls and loops don't."""
    grown = (F.col("pss_floor") > 0) & (F.col("pss_kb") >= F.col("pss_floor") + GROWTH_KB)
    short = (F.col("ram_kb") > 0) & (F.col("ram_kb") < LOW_RAM_KB)
    return (jank_pct() >= 5) | ((F.col("http") > 0) & (F.col("http_p95_ms") >= 500)) | (F.col("http_failed") > 0) | grown | short


def integrals(s: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """I01-I06 of ``states``: areas over time in seconds, one row per score, with severity.

    Failures burn with a quarter of each call that looked a name up or connected (dns, connect, where the timeline has
    them) and with the burn of the run set's loops (run_set, burn).
    """
    seq = Window.partitionBy("run_set").orderBy("bucket")
    rows = s.withColumns({"sore": sore(), "dt": F.col("size") / 1000.0})
    rows = rows.withColumn("island", F.sum(F.when(F.col("sore"), 0).otherwise(1)).over(seq))
    streak = F.sum("dt").over(Window.partitionBy("run_set", "island", "sore").orderBy("bucket"))
    rows = rows.withColumn("streak", F.when(F.col("sore"), streak).otherwise(0.0))
    grown = F.when((F.col("pss_floor") > 0) & (F.col("pss_kb") > F.col("pss_floor")), F.col("pss_kb") - F.col("pss_floor")).otherwise(0)
    short = F.when((F.col("ram_kb") > 0) & (F.col("ram_kb") < LOW_RAM_KB), LOW_RAM_KB - F.col("ram_kb")).otherwise(0)
    phases = [0.25 * F.col(c) if c in s.columns else F.lit(0.0) for c in ("dns", "connect")]
    areas = rows.groupBy("run_set").agg(
        F.sum(jank_pct() * F.col("dt")).alias("jank_pressure_area"), F.sum(F.greatest(F.col("http_p95_ms") - PAIN_MS, F.lit(0)) * F.col("dt")).alias("latency_pain_area"),
        F.sum((F.col("http_failed") + phases[0] + phases[1]) * F.col("dt")).alias("network_failure_burn"), F.sum((grown + short) / 1024.0 * F.col("dt")).alias("memory_pressure_area"), F.sum(F.col("streak") * F.col("dt")).alias("recovery_debt"))
    if loops is not None:
        areas = areas.join(loops.groupBy("run_set").agg(F.sum("burn").alias("burn")), "run_set", "left").withColumn("network_failure_burn", F.col("network_failure_burn") + F.coalesce("burn", F.lit(0.0)))
    long = areas.unpivot("run_set", list(LIMITS), "score", "value")
    severity = F.lit("ok")
    for name, (medium, high) in LIMITS.items():
        severity = F.when(F.col("score") == name, F.when(F.col("value") >= high, "high").when(F.col("value") >= medium, "medium").otherwise("ok")).otherwise(severity)
    return long.select("run_set", "score", F.round("value", 4).alias("value"), severity.alias("severity"))


#: The share of a score's limits at which its growth counts, and its growth in percent (medium, high).
GROWTH_SHARE, GROWTH_PCT = 0.35, (15, 50)


def integral_compare(scores: DataFrame) -> DataFrame:
    """Growth of each load score, with severity by growth and percent."""
    j = scores.groupBy("score").agg(*[F.coalesce(F.max(F.when(F.col("run_set") == side, F.col("value"))), F.lit(0.0)).alias(side) for side in ("baseline", "candidate")])
    delta = F.round(F.col("candidate") - F.col("baseline"), 4)
    pct = F.when(F.col("baseline") != 0, delta * 100 / F.col("baseline")).otherwise(0.0)
    severity = F.lit("ok")
    for name, (medium, high) in LIMITS.items():
        own = F.when((delta >= high * GROWTH_SHARE) | (pct >= GROWTH_PCT[1]), "high").when((delta >= medium * GROWTH_SHARE) | (pct >= GROWTH_PCT[0]), "medium").otherwise("ok")
        severity = F.when((F.col("score") == name) & (delta > 0), own).otherwise(severity)
    return j.select("score", "baseline", "candidate", delta.alias("delta"), F.round(pct, 4).alias("delta_pct"), severity.alias("severity"))


def phase_buckets(rows: DataFrame) -> DataFrame:
    """Calls with a DNS or connection phase and their averages, and the average time to the first byte; phases of 0
    don't count.  rows: run_set, bucket, dns_ms, connect_ms, ttfb_ms."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    mean = lambda c: F.coalesce(int_div(F.sum(some(c)), F.count(some(c))), F.lit(0)).cast("bigint")
    return rows.groupBy("run_set", "bucket").agg(F.count(some("dns_ms")).alias("dns"), mean("dns_ms").alias("dns_ms"), F.count(some("connect_ms")).alias("connect"), mean("connect_ms").alias("connect_ms"), mean("ttfb_ms").alias("ttfb_ms"))


def sufficiency(buckets: DataFrame) -> DataFrame:
    """Whether a run set has the three buckets that any further analysis needs."""
    n = buckets.groupBy("run_set").agg(F.count(F.lit(1)).alias("buckets"), F.max("size").alias("size"))
    return n.withColumn("status", F.when(F.col("buckets") < 3, "medium").otherwise("ok"))


def described_changes(points: DataFrame, nearby: DataFrame) -> DataFrame:
    """Direction, percent and severity of change points, with the route, owner, screen and network of their bucket."""
    pct = F.when(F.col("before") != 0, F.col("delta") * 100 / F.col("before")).otherwise(0.0)
    severity = F.when(F.col("delta") <= 0, "ok").when(F.col("score") >= 6, "high").otherwise("medium")
    return points.join(nearby, ["run_set", "bucket"], "left").withColumns({"direction": F.when(F.col("delta") >= 0, "up").otherwise("down"), "delta_pct": F.round(pct, 4), "severity": severity})


#: Signal, least change that counts, noise floor.
SIGNALS = [("http_p95_ms", 100.0, 50.0), ("jank_pct", 5.0, 2.0), ("pss_kb", 10240.0, 4096.0), ("http_failed", 2.0, 1.0)]
HALF, KEPT = 3, 5


def signal_points(buckets: DataFrame) -> DataFrame:
    """The points of each signal that exist, with its limits."""
    def part(name: str, value: Column, when: Column | bool, least: float, noise: float) -> DataFrame:
        return buckets.filter(when).select("run_set", F.lit(name).alias("signal"), "bucket", "size", value.cast("double").alias("value"), F.lit(least).alias("least"), F.lit(noise).alias("noise"))

    parts = [(F.col("http_p95_ms"), (F.col("http") > 0) & (F.col("http_p95_ms") > 0)), (jank_pct(), F.col("frames") > 0), (F.col("pss_kb"), F.col("pss_kb") > 0), (F.col("http_failed"), F.lit(True))]
    out = None
    for (name, least, noise), (value, when) in zip(SIGNALS, parts):
        p = part(name, value, when, least, noise)
        out = p if out is None else out.unionByName(p)
    return out


def change_candidates(points: DataFrame) -> DataFrame:
    """Points whose three values from there on differ from the three before by more than their spread."""
    seq = Window.partitionBy("run_set", "signal").orderBy("bucket")
    middle = lambda a: F.get(F.array_sort(a), F.lit(HALF // 2))
    spread = lambda a, m: middle(F.transform(a, lambda x: F.abs(x - m)))
    w = points.select("*", F.collect_list("value").over(seq.rowsBetween(-HALF, -1)).alias("a"), F.collect_list("value").over(seq.rowsBetween(0, HALF - 1)).alias("b"))
    w = w.filter((F.size("a") == HALF) & (F.size("b") == HALF)).withColumns({"before": middle(F.col("a")), "after": middle(F.col("b"))})
    noise = F.greatest(F.col("noise"), (spread(F.col("a"), F.col("before")) + spread(F.col("b"), F.col("after"))) / 2)
    w = w.withColumn("delta", F.col("after") - F.col("before")).withColumn("score", F.abs("delta") / noise)
    return w.filter((F.abs("delta") >= F.col("least")) & (F.col("score") >= 3)).select("run_set", "signal", "bucket", "size", "before", "after", "delta", "score")


def change_points(candidates: DataFrame) -> DataFrame:
    """Greedy choice by score; a choice bars what lies within three buckets; at most five per signal.

    A signal has at most MOST_BUCKETS candidates, so they are ordered in one array and chosen in one pass over it.
    """
    rest = ["bucket", "size", "before", "after", "delta", "score"]
    entry = F.struct((-F.col("score")).alias("order"), *rest)
    kind = "array<struct<order:double,bucket:bigint,size:bigint,before:double,after:double,delta:double,score:double>>"
    near = lambda acc, x: F.exists(acc, lambda y: F.abs(y["bucket"] - x["bucket"]) <= HALF)
    chosen = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) < KEPT) & ~near(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    grouped = candidates.groupBy("run_set", "signal").agg(F.array_sort(F.collect_list(entry)).cast(kind).alias("all"))
    return grouped.select("run_set", "signal", F.inline(chosen)).drop("order")


def change_compare(points: DataFrame, tolerance_ms: int = 2000) -> DataFrame:
    """Candidate points without a baseline point in reach appeared, with one of score +2 strengthened; baseline
    points without a candidate one disappeared."""
    side = lambda s, p: points.filter(F.col("run_set") == s).select("signal", (F.col("bucket") * F.col("size")).alias(f"{p}_ms"), F.col("score").alias(f"{p}_score"))
    b, c = side("baseline", "b"), side("candidate", "c")
    reach = (F.col("b.signal") == F.col("c.signal")) & (F.abs(F.col("b_ms") - F.col("c_ms")) <= tolerance_ms)
    matched = c.alias("c").join(b.alias("b"), reach, "left").groupBy(F.col("c.signal").alias("signal"), "c_ms", "c_score").agg(F.min_by("b_score", F.struct(F.abs(F.col("b_ms") - F.col("c_ms")), "b_ms")).alias("b_score"))
    kind = F.when(F.col("b_score").isNull(), "appeared").when(F.col("c_score") >= F.col("b_score") + 2, "strengthened")
    gone = b.alias("b").join(c.alias("c"), reach, "left_anti").select("signal", F.col("b_ms").alias("time_ms"), F.lit("disappeared").alias("change"), F.round("b_score", 6).alias("score"))
    return matched.withColumn("change", kind).filter("change is not null").select("signal", F.col("c_ms").alias("time_ms"), "change", F.round("c_score", 6).alias("score")).unionByName(gone)
