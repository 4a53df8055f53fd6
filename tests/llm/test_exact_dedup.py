import hashlib
from collections import defaultdict

import numpy as np

from fleetpulse.llm.exact_dedup import PerfectHash, exact_dedup


def test_perfect_hash_is_minimal_and_rejects_nothing_of_its_own():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2 ** 63, (5000, 4)).astype(np.uint64)
    slots = PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert PerfectHash(keys[:0]).slots(keys).max() == -1


def test_matches_brute_force(hard_docs, hard_rows):
    groups = defaultdict(list)
    for i, t in hard_rows:
        groups[t or ""].append(i)
    expect = []
    for i, t in hard_rows:
        own = groups[t or ""]
        keep = max(x for x in own if x is not None)
        expect.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(hard_docs).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)


def test_history_does_not_matter_and_empty(spark, hard_docs, no_docs):
    from pyspark.sql import functions as F

    a = sorted(map(str, exact_dedup(hard_docs, history=F.col("doc_id") < 100).collect()))
    assert a == sorted(map(str, exact_dedup(hard_docs, history=F.lit(False)).collect()))
    assert exact_dedup(no_docs).count() == 0
