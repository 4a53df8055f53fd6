"""Baseline against candidate: full outer joins on the grouping key, deltas, severities, gates (J12-J18, V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import severity_rank


def sides(stats: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with b_<value> and c_<value>, 0 where a side lacks the key.

    Both sides come from one scan: a conditional aggregate is the full outer join of the two run sets.
    """
    def side(name: str, prefix: str) -> list[Column]:
        return [F.coalesce(F.max(F.when(F.col("run_set") == name, F.col(v))), F.lit(0)).alias(f"{prefix}_{v}") for v in values]

    return stats.groupBy(*keys).agg(*side("baseline", "b"), *side("candidate", "c"))


def latency_severity(before: Column, after: Column) -> Column:
    grown, pct = after - before, (after - before) * 100.0 / before
    return (F.when((before == 0) & (after > 0), F.when(after >= 1000, "high").otherwise("medium")).when(after <= before, "ok")
            .when((grown >= 500) | (pct >= 50), "high").when((grown >= 100) | (pct >= 15), "medium").otherwise("ok"))


def route_compare(routes: DataFrame) -> DataFrame:
    """J12."""
    out = sides(routes, ["route"], ["count", "failures", "p95_ms"])
    return out.withColumn("delta_p95_ms", F.col("c_p95_ms") - F.col("b_p95_ms")).withColumn("severity", latency_severity(F.col("b_p95_ms"), F.col("c_p95_ms")))


def screen_compare(screens: DataFrame) -> DataFrame:
    """J13."""
    out = sides(screens, ["screen"], ["frames", "jank_pct", "avg_fps", "max_p95_ms"])
    jank, fps = F.round(F.col("c_jank_pct") - F.col("b_jank_pct"), 6), F.round(F.col("c_avg_fps") - F.col("b_avg_fps"), 6)
    severity = F.when((jank >= 3) | (fps <= -5), "high").when((jank >= 1) | (fps <= -2), "medium").otherwise("ok")
    return out.withColumns({"delta_jank_pct": jank, "delta_fps": fps, "severity": severity})


def owner_compare(owners: DataFrame) -> DataFrame:
    """J14, by owner and kind."""
    out = sides(owners, ["owner", "kind"], ["count", "total_ms", "max_ms"])
    return out.withColumns({"delta_count": F.col("c_count") - F.col("b_count"), "delta_max_ms": F.col("c_max_ms") - F.col("b_max_ms"),
                            "severity": latency_severity(F.col("b_max_ms"), F.col("c_max_ms"))})


def flow_compare(flows: DataFrame) -> DataFrame:
    """J15."""
    f = flows.withColumn("jank_pct", F.when(F.col("frames") > 0, F.col("jank") * 100.0 / F.col("frames")).otherwise(0.0))
    out = sides(f, ["screen", "flow", "step", "owner"], ["problems", "spam", "http_p95_ms", "stall", "jank_pct"])
    delta = {v: F.col(f"c_{v}") - F.col(f"b_{v}") for v in ("problems", "spam", "http_p95_ms", "stall", "jank_pct")}
    severity = (F.when((delta["problems"] >= 10) | (delta["stall"] >= 500) | (delta["http_p95_ms"] >= 500) | (delta["jank_pct"] >= 3), "high")
                .when((delta["problems"] > 0) | (delta["spam"] >= 50) | (delta["stall"] >= 100) | (delta["http_p95_ms"] >= 100) | (delta["jank_pct"] >= 1), "medium").otherwise("ok"))
    return out.select("screen", "flow", "step", "owner", *[F.round(d, 6).alias(f"delta_{v}") if v == "jank_pct" else d.alias(f"delta_{v}") for v, d in delta.items()], severity.alias("severity"))


#: The metrics of a comparison, whether more is worse, and whether they are rates.
METRICS = [
    ("http_p95_ms", True, False),
    ("http_failed", True, False),
    ("ui_jank_pct", True, True),
    ("ui_avg_fps", False, True),
    ("stall_max_ms", True, False),
    ("max_pss_kb", True, False),
    ("min_ram_kb", False, False),
    ("rx_bytes", True, False),
    ("tx_bytes", True, False),
    ("retained", True, False),
    ("log_spam", True, False),
    ("problems", True, False),
]


def metric_deltas(summary: DataFrame) -> DataFrame:
    """V01, V04 from one summary row per run set: run_set, <metric>, n_<metric> (its sample size), confidence."""
    names = [m for m, _, _ in METRICS]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(worse).alias("more_is_worse"), F.lit(rate).alias("rate"),
                                         F.col(m).cast("double").alias("v"), F.col(f"n_{m}").cast("bigint").alias("n")) for m, worse, rate in METRICS]))
    long = summary.select("run_set", pairs.alias("p")).select("run_set", "p.*")
    wide = sides(long, ["metric", "more_is_worse", "rate"], ["v", "n"])
    before, after, worse, rate = F.col("b_v"), F.col("c_v"), F.col("more_is_worse"), F.col("rate")
    change = after - before
    pct = F.when(before != 0, change * 100.0 / before).otherwise(F.lit(0.0))
    bad = F.when(worse, change).otherwise(-change)
    bad_pct = F.when(worse, pct).otherwise(-pct)
    new = ~rate & (before == 0) & (after > 0)
    effect = (F.when(new, F.when(worse, "medium").otherwise("ok"))
              .when(rate & worse, F.when(bad >= 3, "high").when(bad >= 1, "medium").otherwise("ok"))
              .when(rate, F.when(bad >= 5, "high").when(bad >= 2, "medium").otherwise("ok"))
              .when(before == 0, "ok").otherwise(F.when(bad_pct >= 25, "high").when(bad_pct >= 10, "medium").otherwise("ok")))
    sample = F.least("b_n", "c_n")
    reg_abs = F.when(new, F.when(worse, after).otherwise(0.0)).when(bad > 0, F.abs(change)).otherwise(0.0)
    reg_pct = F.when(new, F.when(worse, 100.0).otherwise(0.0)).when(bad > 0, F.abs(pct)).otherwise(0.0)
    del names
    return wide.select("metric", F.round(before, 6).alias("baseline"), F.round(after, 6).alias("candidate"), F.round(pct, 6).alias("change_pct"), F.round(reg_abs, 6).alias("regression_abs"),
                       F.round(reg_pct, 6).alias("regression_pct"), sample.alias("sample_size"), effect.alias("effect"))


def sample_confidence(totals: DataFrame) -> Column:
    """V03, before the cap: of the smaller side's logs and events."""
    logs, n = F.min("logs"), F.min("events")
    return F.when((logs >= 5) & (n >= 500), "high").when((logs >= 2) & (n >= 80), "medium").otherwise("low")


def comparison_confidence(totals: DataFrame, quality: DataFrame) -> DataFrame:
    """One row ``confidence``, the sample's, capped by the collection quality (run_set, level) of each side; a side
    without a quality is not capped."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    sample = totals.agg(sample_confidence(totals).alias("sample"))
    cap = quality.agg(F.coalesce(F.min(rank(F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("high")))), F.lit(3)).alias("cap"))
    least = F.least(rank(F.col("sample")), F.col("cap"))
    return sample.crossJoin(F.broadcast(cap)).select(F.when(least == 3, "high").when(least == 2, "medium").otherwise("low").alias("confidence"))


def adjusted(deltas: DataFrame, confidence: DataFrame) -> DataFrame:
    """A high effect counts as medium on low confidence or a tiny sample.  ``confidence`` is one row."""
    weak = (F.col("confidence") == "low") | (F.col("sample_size") < 3)
    return deltas.crossJoin(F.broadcast(confidence)).withColumn("severity", F.when((F.col("effect") == "high") & weak, "medium").otherwise(F.col("effect")))


def gate(deltas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of (metric, rule) that fail.  thresholds: metric ('*' for all), max_severity, max_abs, max_pct, each may
    be null; limits of 0 are inactive.  The global row applies where a metric has no own severity limit."""
    own = thresholds.filter("metric <> '*'").withColumnRenamed("max_severity", "own_severity")
    every = thresholds.filter("metric = '*'").select(F.col("max_severity").alias("all_severity"))
    joined = deltas.join(F.broadcast(own), "metric", "left").crossJoin(F.broadcast(every))
    limit = F.coalesce("own_severity", "all_severity")
    rules = F.array(
        F.when(limit.isNotNull() & (severity_rank(F.col("severity")) > severity_rank(limit)), F.lit("severity")),
        F.when((F.col("max_abs") > 0) & (F.col("regression_abs") > F.col("max_abs")), F.lit("regression_abs")),
        F.when((F.col("max_pct") > 0) & (F.col("regression_pct") > F.col("max_pct")), F.lit("regression_pct")))
    return joined.select("metric", "severity", "regression_abs", "regression_pct", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def comparison_gate(deltas: DataFrame, cohort_warnings: DataFrame, min_confidence: str | None, clean_cohorts: bool) -> DataFrame:
    """V06, over the whole comparison: (rule, value) rows for a confidence below the least one and for each cohort that differs.

    deltas has ``confidence`` (the same in all rows); cohort_warnings has ``dimension``.  Without deltas nothing is judged
    by confidence.
    """
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    rules = cohort_warnings.select(F.lit("cohort_mismatch").alias("rule"), F.col("dimension").alias("value")).filter(F.lit(clean_cohorts))
    if not min_confidence:
        return rules
    low = deltas.select("confidence").distinct().filter(rank(F.col("confidence")) < rank(F.lit(min_confidence)))
    return rules.unionByName(low.select(F.lit("confidence").alias("rule"), F.col("confidence").alias("value")))


def mix_deltas(mixes: DataFrame) -> DataFrame:
    """V02 of (run_set, dimension, value, count): the ordered summaries of both sides, medium where they differ."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "value")))
    text = mixes.groupBy("run_set", "dimension").agg(F.array_join(F.transform(ordered, lambda r: F.concat(r["value"], F.lit("="), (-r["o"]).cast("string"))), ", ").alias("summary"))
    both = text.groupBy("dimension").agg(F.max(F.when(F.col("run_set") == "baseline", F.col("summary"))).alias("baseline"), F.max(F.when(F.col("run_set") == "candidate", F.col("summary"))).alias("candidate"))
    return both.withColumn("severity", F.when(F.col("baseline").eqNullSafe(F.col("candidate")), "ok").otherwise("medium"))
