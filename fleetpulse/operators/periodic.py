"""Periodicity of series (run_set, signal, ix, value): autocorrelation and spectrum (D family)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most lags, least points, most points of a spectrum, significance of a lag.
LAGS, LEAST, POINTS, SIGNIFICANT = 60, 12, 2048, 0.55


def autocorrelation(series: DataFrame, lags: int = LAGS) -> DataFrame:
    """(run_set, signal, lag, r), centred, with the biased normaliser.

    The values before a point come from one window over the series; no series is joined with itself.
    """
    key = ["run_set", "signal"]
    mean = series.groupBy(*key).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    x = series.join(F.broadcast(mean), key).withColumn("x", F.col("value") - F.col("mean"))
    w = Window.partitionBy(*key).orderBy("ix")
    cols = [F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)]
    sums = x.select(*key, "n", "x", *cols).groupBy(*key, "n").agg(F.sum(F.col("x") * F.col("x")).alias("ss"), *[F.sum(F.col("x") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(1, lags + 1)])).alias("p")
    out = sums.select(*key, "n", "ss", pairs).filter(F.col("p.lag") <= F.floor(F.col("n") / 2))
    return out.select(*key, "p.lag", F.when(F.col("ss") > 0, F.coalesce("p.s", F.lit(0.0)) / F.col("ss")).otherwise(0.0).alias("r"))


def lag_summary(r: DataFrame) -> DataFrame:
    """The best lag, the first significant one, and the first at which correlation has halved."""
    return r.groupBy("run_set", "signal").agg(
        F.max_by("lag", F.struct("r", -F.col("lag"))).alias("top_lag"), F.min(F.when(F.col("r") >= SIGNIFICANT, F.col("lag"))).alias("first_significant"), F.min(F.when(F.col("r") <= 0.5, F.col("lag"))).alias("half_life"))


def spectrum(series: DataFrame) -> DataFrame:
    """(run_set, signal, n, k, power) of the Hann-windowed series without its mean.

    Longer series are thinned evenly to POINTS points, so a series has at most POINTS ** 2 / 2 terms.
    """
    key = ["run_set", "signal"]
    n = series.groupBy(*key).agg(F.count(F.lit(1)).alias("all"), F.avg("value").alias("mean"))
    m = F.least("all", F.lit(POINTS))
    pick = n.select(*key, "all", "mean", m.alias("n"), F.explode(F.sequence(F.lit(0), (m - 1).cast("int"))).alias("i"))
    pick = pick.withColumn("ix", F.when(F.col("n") == F.col("all"), F.col("i")).otherwise(F.round(F.col("i") * (F.col("all") - 1) / (F.col("n") - 1))).cast("bigint"))
    x = pick.join(series, [*key, "ix"]).withColumn("v", (F.col("value") - F.col("mean")) * (0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * F.col("i") / (F.col("n") - 1))))
    terms = x.select(*key, "n", "i", "v", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))).alias("k"))
    angle = F.lit(2 * math.pi) * F.col("k") * F.col("i") / F.col("n")
    return terms.groupBy(*key, "n", "k").agg((F.pow(F.sum(F.col("v") * F.cos(angle)), 2) + F.pow(F.sum(F.col("v") * F.sin(angle)), 2)).alias("power"))


def entropy(power: DataFrame) -> DataFrame:
    """Spectral entropy, normalised to 0..1."""
    w = Window.partitionBy("run_set", "signal")
    p = power.withColumn("p", F.when(F.sum("power").over(w) > 0, F.col("power") / F.sum("power").over(w)).otherwise(0.0)).withColumn("bins", F.count(F.lit(1)).over(w))
    h = F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0))
    return p.groupBy("run_set", "signal", "bins").agg(h.alias("h")).select("run_set", "signal", F.when(F.col("bins") > 1, F.col("h") / F.log2("bins")).otherwise(0.0).alias("entropy"))


def peaks(power: DataFrame, most: int = 3) -> DataFrame:
    """The strongest bins against the median background, with a confidence; period in points of the series."""
    w = Window.partitionBy("run_set", "signal")
    back = power.groupBy("run_set", "signal").agg(F.median("power").alias("med"), F.avg("power").alias("avg"))
    base = F.when(F.col("med") > 0, F.col("med")).when(F.col("avg") > 0, F.col("avg")).otherwise(1.0)
    j = power.join(F.broadcast(back), ["run_set", "signal"]).join(F.broadcast(entropy(power)), ["run_set", "signal"]).withColumn("ratio", F.col("power") / base)
    j = j.withColumn("rank", F.row_number().over(w.orderBy(F.desc("ratio"), "k"))).filter(F.col("rank") <= most)
    conf = 0.65 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ratio") - 2) / 8)) + 0.35 * (1 - F.col("entropy"))
    return j.select("run_set", "signal", "k", (F.col("n") / F.col("k")).alias("period"), "ratio", "entropy", conf.alias("confidence"))


def report(series: DataFrame, lags: DataFrame, found: DataFrame) -> DataFrame:
    """Of each signal its points, lags, entropy, best peak, status and rank; under LEAST points nothing is told."""
    key = ["run_set", "signal"]
    n = series.groupBy(*key).agg(F.count(F.lit(1)).alias("points"))
    best = found.groupBy(*key).agg(F.max_by(F.struct("period", "confidence"), F.struct("confidence", "ratio")).alias("b"), F.max("entropy").alias("entropy"))
    j = n.join(lags, key, "left").join(best, key, "left").select(*key, "points", "top_lag", "first_significant", "half_life", "b.period", "b.confidence", "entropy")
    enough, strong = F.col("points") >= LEAST, (F.coalesce("confidence", F.lit(0.0)) >= 0.6) | F.col("first_significant").isNotNull()
    rank = F.when(strong, 2).when(F.col("period").isNotNull(), 1).otherwise(0)
    return j.withColumns({"status": F.when(enough & strong, "ok").otherwise("medium"), "rank": F.when(enough, rank).otherwise(0)})


def bursts(series: DataFrame) -> DataFrame:
    """Points at or over max(1, median + 3 MAD, 2 median) of their series, and over the median of its positive points
    (if over 1) where the median is 0."""
    key = ["run_set", "signal"]
    med = series.groupBy(*key).agg(F.median("value").alias("med"), F.median(F.when(F.col("value") > 0, F.col("value"))).alias("positive"))
    x = series.join(F.broadcast(med), key)
    mad = x.groupBy(*key).agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    own = F.when((F.col("med") == 0) & (F.col("positive") > 1), F.col("positive")).otherwise(0.0)
    limit = F.greatest(F.lit(1.0), F.col("med") + 3 * F.col("mad"), 2 * F.col("med"), own)
    return x.join(F.broadcast(mad), key).filter((F.col("value") > 0) & (F.col("value") >= limit)).select(*key, "ix", "value")


def regularity(found: DataFrame) -> DataFrame:
    """Bursts, their median gap, and the share of gaps within one bucket of it."""
    key = ["run_set", "signal"]
    gap = F.col("ix") - F.lag("ix").over(Window.partitionBy(*key).orderBy("ix"))
    g = found.select(*key, gap.alias("gap"))
    mid = g.groupBy(*key).agg(F.count(F.lit(1)).alias("bursts"), F.median("gap").alias("period"))
    return g.filter("gap is not null").join(mid, key).groupBy(*key, "bursts", "period").agg(F.avg(F.when(F.abs(F.col("gap") - F.col("period")) <= 1, 1.0).otherwise(0.0)).alias("regularity"))
