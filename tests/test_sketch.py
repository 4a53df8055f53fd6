"""Bounded percentiles: exact to the cap, the same sample for every split beyond it."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import sketch

SHARES = {"p50": 0.5, "p95": 0.95}


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [("big", i, rnd.randint(0, 10_000)) for i in range(9000)] + [("small", i, rnd.randint(0, 50)) for i in range(70)] + [("edge", i, i) for i in range(100)] + [("none", 0, None)]
    return data, spark.createDataFrame(data, "name string, ord bigint, v bigint")


def wanted(data, cap):
    out = {}
    for name in {r[0] for r in data}:
        mine = sorted((hashlib.md5(str(o).encode()).hexdigest(), v) for n, o, v in data if n == name)
        kept = sorted(v for _, v in mine[:cap] if v is not None)
        rank = lambda p: kept[-(-len(kept) * int(p * 100) // 100) - 1] if kept else None
        out[name] = (rank(0.5), rank(0.95), max((v for _, v in mine if v is not None), default=None), min(cap, len(mine)), len(mine), len(mine) > cap)
    return out


@pytest.mark.parametrize("cap", [100, 1000, sketch.CAP])
def test_sample_is_the_same_for_every_split(rows, cap):
    data, df = rows
    for parts in (1, 7):
        got = sketch.sampled_percentiles(sketch.sample(df.repartition(parts), ["name"], "v", ["ord"], cap), ["name"], SHARES).collect()
        assert {r["name"]: (r["p50"], r["p95"], r["max"], r["sampled"], r["seen"], r["approximate"]) for r in got} == wanted(data, cap)


def test_samples_of_batches_merge(rows):
    data, df = rows
    batches = [sketch.sample(df.filter(F.pmod(F.hash("ord"), F.lit(3)) == i), ["name"], "v", ["ord"], 100).withColumn("batch", F.lit(i)) for i in range(3)]
    merged = sketch.merged_samples(batches[0].unionByName(batches[1]).unionByName(batches[2]), ["name"], 100)
    got = sketch.sampled_percentiles(merged, ["name"], SHARES).collect()
    assert {r["name"]: (r["p50"], r["p95"], r["max"], r["sampled"], r["seen"], r["approximate"]) for r in got} == wanted(data, 100)
