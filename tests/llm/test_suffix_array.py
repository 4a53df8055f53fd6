import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fleetpulse.llm import repeats, suffix_array as m


def brute_force(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s:s + 200] for _, b in raw for s in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s:s + 200]] > 1:
                gone[s:s + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    cut, whole = m.suffix_array_dedup(docs)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in cut.collect()]
    return sorted(got + [(r["doc_id"], r["n_bytes"], 0, 0, r["digest"]) for r in whole.collect()], key=str)


@pytest.mark.parametrize("sigma_limit", [m.MAX_SIGMA, 12])
def test_suffix_arrays_and_prefixes(monkeypatch, sigma_limit):
    monkeypatch.setattr(m, "MAX_SIGMA", sigma_limit)
    rnd = random.Random(2)
    for sigma in (2, 3, 20):
        for n in (0, 1, 2, 5, 40, 200):
            for _ in range(8):
                t = np.array([1 + rnd.randrange(sigma) for _ in range(n)] + [0], np.int16)
                order = m.suffix_array(t, sigma + 1)
                s = t.tolist()
                assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:])
                lcp = m.permuted_prefixes(t, order, 30)
                for a, b in zip(order, order[1:]):
                    k = 0
                    while k < 30 and max(a, b) + k <= n and s[a + k] == s[b + k]:
                        k += 1
                    assert lcp[b] == k


@pytest.mark.parametrize("most", [1 << 20, 3000, 1])
def test_matches_brute_force(hard_docs, hard_rows, monkeypatch, most):
    monkeypatch.setattr(repeats, "SHARD_BYTES", most)
    assert result(hard_docs) == brute_force(hard_rows)


def test_short_segments_change_nothing(hard_docs, hard_rows, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 5000)
    assert result(hard_docs) == brute_force(hard_rows)


def test_table_and_empty(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(no_docs) == []


def test_short_rounds_of_induction_need_no_array_operations(monkeypatch):
    rng = np.random.default_rng(4)
    t = np.append(rng.integers(2, 258, 4000), 0)
    sorts, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or real(*a, **k))
    order = m.suffix_array(t, 258)
    assert len(sorts) < 100
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
