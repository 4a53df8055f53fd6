"""Robust statistics of samples (dimension, name, metric, value, weight): the R family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dimension", "name", "metric"]
#: Resamples, values they are drawn from at most, and the least sample for an interval.
ROUNDS, BASE, LEAST = 200, 512, 20


def samples(http: DataFrame, ui: DataFrame, stalls: DataFrame, metrics: DataFrame, retained: DataFrame | None = None, device: DataFrame | None = None) -> DataFrame:
    """One row per value; gauges weigh as many samples as they stand for, last values and states one.

    Calls count by route and by owner, their phases (dns_ms, connect_ms) where they took time; frames where there were any;
    retained objects by class; memory (pss_kb, java_kb, native_kb) and context (ram_kb, battery, temperature) where the
    device rows have them.  A level of 0 is unset for the battery and its temperature.
    """
    def part(df: DataFrame, dimension: str, name: str | Column, metric: str, value: Column, weight: Column | None = None) -> DataFrame:
        w = F.lit(1) if weight is None else weight
        return df.select("run_set", F.lit(dimension).alias("dimension"), (F.col(name) if isinstance(name, str) else name).alias("name"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), w.cast("int").alias("weight"))

    weight = F.when(F.col("mode").isin("last", "state"), F.lit(1)).otherwise(F.greatest("n", F.lit(1)))
    parts = [part(http, "Route", "route", "http_ms", F.col("dur")), part(http, "Owner", "owner", "http_ms", F.col("dur")), part(ui.filter("p95_ms > 0"), "Screen", "screen", "ui_p95_ms", F.col("p95_ms")),
             part(ui.filter("frames > 0"), "Screen", "screen", "jank_pct", F.col("jank") * 100.0 / F.col("frames")), part(stalls, "Owner", "owner", "stall_ms", F.col("dur")),
             part(metrics.filter("mode <> 'counter'"), "Gauge", "name", "value", F.col("v"), weight)]
    parts += [part(http.filter(F.col(c) > 0), "Route", "route", c, F.col(c)) for c in ("dns_ms", "connect_ms") if c in http.columns]
    if retained is not None:
        parts.append(part(retained, "Owner", "class", "retained_age_ms", F.col("age_ms")))
    if device is not None:
        parts += [part(device, "Memory", F.lit("process"), c, F.col(c)) for c in ("pss_kb", "java_kb", "native_kb") if c in device.columns]
        parts += [part(device.filter(F.col(c) != 0) if c != "ram_kb" else device, "Context", F.lit("device"), c, F.col(c)) for c in ("ram_kb", "battery", "temperature") if c in device.columns]
    return reduce(DataFrame.unionByName, parts)


def _weighted(s: DataFrame) -> DataFrame:
    """Distinct values of each group with their weight and the weight up to and with them; no value is repeated."""
    v = s.groupBy("run_set", *KEY, "value").agg(F.sum("weight").alias("w"))
    up_to = Window.partitionBy("run_set", *KEY).orderBy("value")
    return v.withColumn("cum", F.sum("w").over(up_to)).withColumn("n", F.sum("w").over(Window.partitionBy("run_set", *KEY)))


def _rank_value(rank: Column) -> Column:
    """The value at a rank (1-based) of the weighted order."""
    return F.min(F.when(F.col("cum") >= rank, F.col("value")))


def _median() -> Column:
    n = F.col("n")
    return (_rank_value(F.floor((n + 1) / 2)) + _rank_value(F.floor(n / 2) + 1)) / 2


def distributions(s: DataFrame) -> DataFrame:
    """N, median, p90, p95, p99, MAD, 10 % trimmed mean, min and max, of weighted samples."""
    v = _weighted(s)
    n, cum, w = F.col("n"), F.col("cum"), F.col("w")
    cut = F.floor(n * 0.1)
    kept = F.greatest(F.lit(0), F.least(cum, n - cut) - F.greatest(cum - w, cut))
    by = v.groupBy("run_set", *KEY, "n")
    first = by.agg(_median().alias("median"), *[_rank_value(F.ceil(n * F.lit(p))).alias(a) for a, p in (("p90", .9), ("p95", .95), ("p99", .99))],
                   F.round(F.sum(kept * F.col("value")) / F.sum(kept), 6).alias("trimmed"), F.min("value").alias("min"), F.max("value").alias("max"))
    away = v.join(first.select("run_set", *KEY, "median"), ["run_set", *KEY]).select("run_set", *KEY, F.abs(F.col("value") - F.col("median")).alias("value"), w.alias("weight"))
    mad = _weighted(away).groupBy("run_set", *KEY, "n").agg(_median().alias("mad")).drop("n")
    return first.join(mad, ["run_set", *KEY])


def cliffs_delta(s: DataFrame) -> DataFrame:
    """R06 through average ranks of the union of both sides: n log n, never all pairs."""
    v = s.groupBy(*KEY, "value").agg(*[F.sum(F.when(F.col("run_set") == x, F.col("weight")).otherwise(0)).alias(a) for x, a in (("baseline", "b"), ("candidate", "c"))])
    v = v.withColumn("tied", F.col("b") + F.col("c"))
    below = F.sum("tied").over(Window.partitionBy(*KEY).orderBy("value")) - F.col("tied")
    r = v.withColumn("rank", below + (F.col("tied") + 1) / 2).groupBy(*KEY).agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"), F.sum(F.col("c") * F.col("rank")).alias("rc"))
    nb, nc = F.col("nb"), F.col("nc")
    delta = F.when((nb > 0) & (nc > 0), (2 * F.col("rc") - nc * (nc + 1)) / (nb * nc) - 1).otherwise(0.0)
    return r.select(*KEY, "nb", "nc", F.round(delta, 6).alias("delta"))


def robust_compare(dist: DataFrame, cliff: DataFrame) -> DataFrame:
    """p95 of both sides, effect size, confidence tier and severity."""
    side = lambda x: F.coalesce(F.max(F.when(F.col("run_set") == x, F.col("p95"))), F.lit(0.0))
    j = cliff.join(dist.groupBy(*KEY).agg(side("baseline").alias("before"), side("candidate").alias("after")), KEY)
    pct = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) * 100.0 / F.col("before")).otherwise(0.0)
    d, size = F.col("delta"), F.abs("delta")
    few = F.least("nb", "nc")
    tier = F.when((few >= 50) & (size >= 0.33) & (F.abs(pct) >= 20), 2).when((few >= 20) & (size >= 0.147) & (F.abs(pct) >= 10), 1).otherwise(0)
    effect = F.when(size >= 0.474, "large").when(size >= 0.33, "medium").when(size >= 0.147, "small").otherwise("negligible")
    severity = (F.when((F.col("nb") == 0) | (F.col("nc") == 0), "medium").when((tier >= 2) & (pct >= 50) & (d >= 0.33), "high")
                .when((tier >= 1) & (pct >= 20) & (d >= 0.147), "medium").when((tier == 0) & (pct >= 80) & (d >= 0.474), "medium").otherwise("ok"))
    return j.select(*KEY, "nb", "nc", "before", "after", F.round(pct, 6).alias("delta_pct"), d.alias("cliff"), effect.alias("effect"), tier.alias("tier"), severity.alias("severity"))


def bootstrap_p95(s: DataFrame) -> DataFrame:
    """95 % interval of p95 from ROUNDS resamples of at most BASE evenly spaced order statistics.

    Draws come from a hash of group, round and draw, so they don't depend on partitions.  A group has at most
    ROUNDS * BASE draws, whatever its size.
    """
    v = _weighted(s).filter(F.col("n") >= LEAST)
    m = F.least("n", F.lit(BASE))
    # the i-th base value stands at position round(i * (n - 1) / (m - 1)), a value's positions are cum - w .. cum - 1
    step = (m - 1) / (F.col("n") - 1)
    lo = F.greatest(F.ceil((F.col("cum") - F.col("w") - 0.5) * step), F.lit(0))
    hi = F.least(F.ceil((F.col("cum") - 0.5) * step) - 1, m - 1)
    base = v.select("run_set", *KEY, m.cast("int").alias("m"), "value", lo.alias("lo"), hi.alias("hi")).filter("hi >= lo")
    base = base.select("run_set", *KEY, "m", "value", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("ix"))
    groups = base.select("run_set", *KEY, "m").distinct()
    draws = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    draws = draws.withColumn("ix", F.pmod(F.xxhash64("run_set", *KEY, "round", "i"), F.col("m")).cast("int"))
    p95 = draws.join(base.drop("m"), ["run_set", *KEY, "ix"]).groupBy("run_set", *KEY, "round").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY p95)")
    return p95.groupBy("run_set", *KEY).agg(pick(0.025).alias("low"), pick(0.975).alias("high"))
