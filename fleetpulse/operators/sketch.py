"""Percentiles of bounded memory, exact up to a cap and from a reproducible sample beyond it.

The sample of a key is the ``cap`` rows whose ids have the least digests.  It depends on the rows alone: any split into
partitions or batches, in any order, keeps the same ones, and samples of parts merge into the sample of the whole
(``merged_samples``).  A key with no more rows than the cap keeps all of them, so its percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import nearest_rank

#: Fixed value: rows of a signal that are kept exactly.
CAP = 20_000


def digest(*ids: str) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids]))


def sample(rows: DataFrame, keys: list[str], value: str, ids: list[str], cap: int = CAP) -> DataFrame:
    """(keys, digest, value, seen, top): each key's sample, with how many rows it stands for and their largest value.

    Rows are counted by key and the first three digits of their digests; the class where the cap is reached is the only one
    whose rows are ranked, one in 4096 of a key's rows, so no task sorts a key.
    """
    r = rows.select(*keys, digest(*ids).alias("digest"), F.col(value).alias("value")).withColumn("part", F.substring("digest", 1, 3))
    counts = r.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select(*keys, "part", "n", before.alias("before"), F.sum("n").over(w).alias("seen"), F.max("top").over(w).alias("top")).filter(F.col("before") < cap)
    kept = r.join(parts, [*keys, "part"])
    whole = kept.filter(F.col("before") + F.col("n") <= cap)
    edge = kept.filter(F.col("before") + F.col("n") > cap).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("digest", "value"))).filter(F.col("rank") <= cap - F.col("before"))
    return whole.unionByName(edge.drop("rank")).select(*keys, "digest", "value", "seen", "top")


def merged_samples(parts: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """One sample of several, a column ``batch`` telling them apart; a part's rows are the cap at most."""
    totals = parts.groupBy(*keys, "batch").agg(F.max("seen").alias("seen"), F.max("top").alias("top")).groupBy(*keys).agg(F.sum("seen").alias("seen"), F.max("top").alias("top"))
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("digest", "value"))).filter(F.col("rank") <= cap)
    return ranked.select(*keys, "digest", "value").join(totals, keys)


def sampled_percentiles(samples: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each key's sample; the largest value is always exact; ``approximate`` says if rows are missing."""
    out = samples.groupBy(*keys).agg(*[nearest_rank("value", p).alias(name) for name, p in shares.items()], F.max("top").alias("max"), F.count(F.lit(1)).alias("sampled"), F.max("seen").alias("seen"))
    return out.withColumn("approximate", F.col("seen") > F.col("sampled"))
