"""Aggregations over one or many run sets (the A family).

Each takes the columns that ``sources.adapter`` defines and groups by ``run_set``; arrival order is the column ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.flags import http_failed
from fleetpulse.functions.numbers import counter_delta, int_div, nearest_rank, share

CONTEXT = ["screen", "flow", "step", "owner"]
#: Slow HTTP and UI limits in ms, log bursts that count as a problem.
HTTP_SLOW_MS, UI_SLOW_MS, SPAM_COUNT = 1000, 32, 50


def run_totals(events: DataFrame) -> DataFrame:
    """Events, sources, and the summed time span of the sources."""
    per_log = events.groupBy("run_set", "source").agg(F.count(F.lit(1)).alias("n"), (F.max("time_ms") - F.min("time_ms")).alias("span"))
    return per_log.groupBy("run_set").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("logs"), F.sum("span").alias("duration_ms"))


def http_totals(http: DataFrame) -> DataFrame:
    """A02."""
    return http.groupBy("run_set").agg(F.count(F.lit(1)).alias("http_count"), F.count_if("failed").alias("http_failed"), nearest_rank("dur", 0.95).alias("http_p95_ms"))


def route_stats(http: DataFrame) -> DataFrame:
    """Count, failures, p50, p95, max and the first owner seen of each route."""
    return http.groupBy("run_set", "route").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("failed").alias("failures"), nearest_rank("dur", 0.5).alias("p50_ms"), nearest_rank("dur", 0.95).alias("p95_ms"),
        F.max("dur").alias("max_ms"), int_div(F.sum("dur"), F.count(F.lit(1))).alias("avg_ms"), F.min_by("owner", "ord").alias("owner_sample"))


def _ui(by: list[str], ui: DataFrame) -> DataFrame:
    fps = F.col("frames") * 1000.0 / F.col("window_ms")
    sums = ui.groupBy("run_set", *by).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("window_ms").cast("bigint").alias("window_ms"), F.sum("frames").cast("bigint").alias("frames"), F.sum("jank").cast("bigint").alias("jank"),
        F.min(F.when(fps > 0, fps)).alias("min_fps"), F.max("p95_ms").alias("max_p95_ms"), F.max("p99_ms").alias("max_p99_ms"))
    return sums.withColumn("jank_pct", F.round(share(F.col("jank"), F.col("frames")), 6)).withColumn("avg_fps", F.round(share(F.col("frames"), F.col("window_ms"), 1000.0), 6))


def screen_stats(ui: DataFrame) -> DataFrame:
    """A04."""
    return _ui(["screen"], ui)


def ui_totals(ui: DataFrame) -> DataFrame:
    """A05."""
    return _ui([], ui).drop("max_p95_ms", "max_p99_ms")


def owner_stats(http: DataFrame, stalls: DataFrame, retained: DataFrame) -> DataFrame:
    """By owner (for retained objects the class) and kind; count, total, largest, first stack."""
    rows = (http.select("run_set", "owner", F.lit("http").alias("kind"), F.col("dur").alias("v"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("stack"), "ord")
            .unionByName(stalls.select("run_set", "owner", F.lit("main_thread_stall").alias("kind"), F.col("dur").alias("v"), F.lit(1).alias("n"), "stack", "ord"))
            .unionByName(retained.select("run_set", F.col("class").alias("owner"), F.lit("retained_object").alias("kind"), F.col("age_ms").alias("v"), F.col("n"), F.lit(None).cast("string").alias("stack"), "ord")))
    return rows.groupBy("run_set", "owner", "kind").agg(F.sum("n").cast("bigint").alias("count"), F.sum("v").alias("total_ms"), F.max("v").alias("max_ms"), F.min_by("stack", "ord").alias("stack"))


def stall_totals(stalls: DataFrame) -> DataFrame:
    """A07."""
    return stalls.groupBy("run_set").agg(F.count(F.lit(1)).alias("stall_count"), F.max("dur").alias("stall_max_ms"))


def problem_rows(http: DataFrame, ui: DataFrame, stalls: DataFrame, retained: DataFrame, spam: DataFrame) -> DataFrame:
    """The problems that signals imply, one row each: context, kind, count, window, largest value.

    Calls and windows that their client classified (http_classified, ui_classified) count by its flags slow and ui_problem;
    durations and frames decide for the others, and for all where the rows don't have these flags.
    """
    said = lambda df, c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    def rows(df: DataFrame, kind: str, when: Column | bool, n: Column, window: Column, top: Column) -> DataFrame:
        return df.filter(when).select("run_set", "source", *CONTEXT, F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), window.cast("bigint").alias("window_ms"), top.cast("bigint").alias("max_ms"))

    one, zero = F.lit(1), F.lit(0)
    return (rows(http, "http_problem", http_failed(http) | said(http, "slow") | (~said(http, "http_classified") & (F.col("dur") >= HTTP_SLOW_MS)), one, F.col("dur"), F.col("dur"))
            .unionByName(rows(ui, "ui_jank", said(ui, "ui_problem") | (~said(ui, "ui_classified") & ((F.col("jank") > 0) | (F.col("p95_ms") >= UI_SLOW_MS))), F.greatest("jank", one), F.col("window_ms"), F.col("p95_ms")))
            .unionByName(rows(stalls, "main_thread_stall", F.lit(True), one, F.col("dur"), F.col("dur")))
            .unionByName(rows(retained, "retained_object", F.lit(True), F.col("n"), zero, F.col("age_ms")))
            .unionByName(rows(spam, "log_spam", F.col("n") >= SPAM_COUNT, F.col("n"), F.lit(5000), zero)))


#: By type of event, what of its payload stands for a part of its context.
OVERRIDES = {"http": {"owner": "p_owner"}, "stall": {"owner": "p_owner"}, "ui": {"screen": "p_screen"}, "retained": {"screen": "p_screen", "owner": "p_owner", "flow": "p_flow", "step": "p_step"}, "call": {"owner": "caller"}}


def with_overrides(events: DataFrame) -> DataFrame:
    """The context of each event, where its payload (p_screen, p_owner, p_flow, p_step, caller) has a say by its type."""
    out = {}
    for part in CONTEXT:
        value = F.col(part)
        for kind, fields in OVERRIDES.items():
            if part in fields and fields[part] in events.columns:
                value = F.when((F.col("type") == kind) & (F.coalesce(F.trim(fields[part]), F.lit("")) != ""), F.col(fields[part])).otherwise(value)
        out[part] = value
    return events.withColumns(out)


def without_legacy(canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """Problems that clients logged themselves count only where the same log derived none of that kind there."""
    on = ["run_set", "source", *CONTEXT, "kind"]
    return canonical.unionByName(legacy.join(canonical.select(*on).distinct(), on, "left_anti"))


def problem_stats(problems: DataFrame) -> DataFrame:
    """A10."""
    return problems.groupBy("run_set", *CONTEXT, "kind").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("count"), F.sum("window_ms").alias("window_ms"), F.max("max_ms").alias("max_ms"))


def flow_stats(http: DataFrame, ui: DataFrame, stalls: DataFrame, spam: DataFrame, device: DataFrame, problems: DataFrame) -> DataFrame:
    """Everything known of one screen, flow, step and owner, from one union and one shuffle."""
    def part(df: DataFrame, **values: Column) -> DataFrame:
        names = ["http", "failed", "http_ms", "stall", "windows", "frames", "jank", "spam", "problems", "problem_max", "pss"]
        return df.select("run_set", *CONTEXT, *[values.get(n, F.lit(None)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    rows = (part(http, http=one, failed=F.col("failed").cast("int"), http_ms=F.col("dur")).unionByName(part(ui, windows=one, frames=F.col("frames"), jank=F.col("jank")))
            .unionByName(part(stalls, stall=one)).unionByName(part(spam, spam=F.col("n"))).unionByName(part(device, pss=F.col("pss_kb")))
            .unionByName(part(problems, problems=F.col("n"), problem_max=F.col("max_ms"))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy("run_set", *CONTEXT).agg(
        total("http"), total("failed"), F.coalesce(nearest_rank("http_ms", 0.95), F.lit(0)).alias("http_p95_ms"), total("stall"), total("windows"), total("frames"), total("jank"),
        total("spam"), total("problems"), F.coalesce(F.max("problem_max"), F.lit(0)).alias("problem_max_ms"), F.coalesce(F.max("pss"), F.lit(0)).alias("pss_kb"))


def flow_severity() -> Column:
    """T02."""
    return (F.col("problems") * 10000 + F.col("stall") * 5000 + F.col("jank") * 100 + F.col("spam") * 10 + F.col("failed") * 500 + F.col("http_p95_ms") + F.col("problem_max_ms"))


def spam_stats(spam: DataFrame) -> DataFrame:
    """A09."""
    return spam.groupBy("run_set", *CONTEXT, "log_source", "level").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("windows"))


def call_stats(calls: DataFrame) -> DataFrame:
    """A11."""
    return calls.groupBy("run_set", *CONTEXT, "caller", "callee").agg(F.sum("n").cast("bigint").alias("count"), F.sum("total_ms").alias("total_ms"), F.max("dur").alias("max_ms"))


def counters(metrics: DataFrame) -> DataFrame:
    """A12."""
    return metrics.filter(F.col("mode") == "counter").groupBy("run_set", "name").agg(F.sum("v").alias("value"))


def gauges(metrics: DataFrame) -> DataFrame:
    """Average, last, state or share of true by the mode that arrived last; a count of 0 is one sample."""
    n = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("n"))
    g = metrics.filter(F.col("mode") != "counter").select("run_set", "name", "mode", "v", "ord", n.alias("n"), (F.col("v") * n).alias("total"))
    g = g.groupBy("run_set", "name").agg(F.max_by("mode", "ord").alias("mode"), F.max_by("v", "ord").alias("last"), F.sum("total").alias("total"), F.sum("n").cast("bigint").alias("samples"), F.max("v").alias("max"))
    value = F.when(F.col("mode") == "average", int_div(F.col("total"), F.col("samples"))).when(F.col("mode") == "boolean", int_div(F.col("total") * 100, F.col("samples"))).otherwise(F.col("last"))
    return g.select("run_set", "name", "mode", value.alias("value"), "max", "samples")


def device_context(device: DataFrame) -> DataFrame:
    """Last known state and lowest levels; a level of 0 means unset."""
    last = F.max_by(F.struct("battery", "network", "ram_kb"), "ord").alias("l")
    out = device.groupBy("run_set").agg(last, F.min(F.when(F.col("battery") != 0, F.col("battery"))).alias("min_battery"), F.min(F.when(F.col("ram_kb") != 0, F.col("ram_kb"))).alias("min_ram_kb"),
                                        F.count_if("low_memory").alias("low_memory"), F.count(F.lit(1)).alias("contexts"))
    return out.select("run_set", F.col("l.battery").alias("battery"), F.col("l.network").alias("network"), F.col("l.ram_kb").alias("ram_kb"), "min_battery", "min_ram_kb", "low_memory", "contexts")


def memory(device: DataFrame) -> DataFrame:
    """A15."""
    return device.groupBy("run_set").agg(F.count(F.lit(1)).alias("samples"), F.max("pss_kb").alias("max_pss_kb"))


def traffic(device: DataFrame) -> DataFrame:
    """Growth of cumulative traffic from the first to the last sample of each log, summed."""
    per_log = device.groupBy("run_set", "source").agg(*[f(c, "ord").alias(f"{n}_{c}") for c in ("rx", "tx") for n, f in (("first", F.min_by), ("last", F.max_by))])
    return per_log.groupBy("run_set").agg(*[F.sum(counter_delta(F.col(f"last_{c}"), F.col(f"first_{c}"))).alias(f"{c}_bytes") for c in ("rx", "tx")])


def retained_by_class(retained: DataFrame) -> DataFrame:
    """A17, by class."""
    return retained.groupBy("run_set", "class").agg(F.sum("n").cast("bigint").alias("count"), F.max("age_ms").alias("max_age_ms"))


def age_bucket(a: Column) -> Column:
    return F.when(a < 10000, "<10s").when(a < 30000, "10-30s").when(a < 60000, "30-60s").otherwise(">=60s")


def retained_by_age(retained: DataFrame) -> DataFrame:
    """A17, by age."""
    return retained.groupBy("run_set", age_bucket(F.col("age_ms")).alias("age")).agg(F.sum("n").cast("bigint").alias("count"))


def mix(rows: DataFrame, col: str) -> DataFrame:
    """How often each value of a dimension occurs."""
    return rows.groupBy("run_set", F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def cohorts(events: DataFrame, device: DataFrame) -> DataFrame:
    """Events by the network last seen before them, carried on across logs in file order.

    Each log fills forward on its own; what a log begins with comes from the last value of the logs before it, so no
    window holds a whole run set.
    """
    seen = events.join(device.select(F.col("ord").alias("d_ord"), F.col("network")), F.col("ord") == F.col("d_ord"), "left")
    within = Window.partitionBy("run_set", "source").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = seen.select("run_set", "source", "ord", F.last("network", ignorenulls=True).over(within).alias("net"))
    ends = device.groupBy("run_set", "source").agg(F.max_by("network", "ord").alias("end"))
    logs = events.select("run_set", "source").distinct().join(ends, ["run_set", "source"], "left")
    before = Window.partitionBy("run_set").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    starts = logs.select("run_set", "source", F.last("end", ignorenulls=True).over(before).alias("start"))
    out = filled.join(starts, ["run_set", "source"]).withColumn("network", F.coalesce("net", "start", F.lit("unknown")))
    return out.groupBy("run_set", "network").agg(F.count(F.lit(1)).alias("events"))


def size_profile(events: DataFrame) -> DataFrame:
    """Records and bytes by type, share of all bytes, and in how many logs the type occurs."""
    by_type = events.groupBy("run_set", "type").agg(F.count(F.lit(1)).alias("records"), F.sum("dur").alias("bytes"), F.count_distinct("source").alias("logs"))
    whole = F.sum("bytes").over(Window.partitionBy("run_set"))
    return by_type.select("run_set", "type", "records", "bytes", int_div(F.col("bytes"), F.col("records")).alias("avg_bytes"), F.round(F.col("bytes") * 100.0 / whole, 6).alias("share_pct"), "logs")


def top(df: DataFrame, k: int, *order: Column, by: str = "run_set") -> DataFrame:
    """The first k rows of each group, with their rank; ``order`` has to be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
