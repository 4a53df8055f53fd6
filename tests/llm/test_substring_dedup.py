import hashlib
import random
import re

import pytest

from fleetpulse.llm import common, repeats
from fleetpulse.llm.substring_dedup import SuffixAutomaton, substring_dedup


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_force(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        w = words(rows[k][1])
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((rows[k][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs):
    cut, whole = substring_dedup(docs)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in cut.collect()]
    return sorted(got + [(r["doc_id"], r["n_words"], 0, r["digest"]) for r in whole.collect()], key=str)


def test_matching_statistics():
    rnd = random.Random(1)
    for _ in range(60):
        texts = [[rnd.randrange(3) for _ in range(rnd.randint(0, 25))] for _ in range(3)]
        a = SuffixAutomaton()
        for t in texts[:2]:
            a.add(t)
        subs = {tuple(t[i:j]) for t in texts[:2] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        q = texts[2]
        expect = [max([0] + [n for n in range(1, i + 2) if tuple(q[i + 1 - n:i + 1]) in subs | {tuple(q[x:y]) for y in range(1, i + 1) for x in range(y)}]) for i in range(len(q))]
        assert a.matching_statistics(q) == [max([0] + [n for n in range(1, i + 2) if tuple(q[i + 1 - n:i + 1]) in subs]) for i in range(len(q))]
        assert a.add(q) == expect


@pytest.mark.parametrize("hot", [2000, 1, 0.1])
@pytest.mark.parametrize("most", [1 << 20, 500, 1])
def test_matches_brute_force(hard_docs, hard_rows, monkeypatch, most, hot):
    """Whatever a task may gather and whichever keys are broadcast, the result is the same."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", most)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    assert result(hard_docs) == brute_force(hard_rows)


def test_short_segments_change_nothing(hard_docs, hard_rows, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 50)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    assert result(hard_docs) == brute_force(hard_rows)


def test_table_and_empty(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(no_docs) == []
