import re
from collections import defaultdict

from fleetpulse.llm.ngram_join import ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[shingles(t)].append(i)
    rep = {s: min(ids) for s, ids in sets.items()}
    links = defaultdict(set)
    every = [s for s in sets if s]
    for x in every:
        for y in every:
            if x != y and len(x & y) >= 0.8 * len(x | y):
                links[x].add(y)
    out = {}
    for s in sets:
        seen, todo = {s}, [s]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        for i in sets[s]:
            out[i] = (min(rep[x] for x in seen), rep[s], len(links[s]))
    return out


def test_matches_brute_force(hard_docs, hard_rows):
    got = ngram_join(hard_docs).collect()
    assert len(got) == sum(i is not None for i, _ in hard_rows)
    assert {r["doc_id"]: (r["class_id"], r["set_id"], r["n_links"]) for r in got} == brute_force(hard_rows)


def test_blocks_and_deeper_splits_change_nothing(hard_docs, hard_rows, monkeypatch):
    from fleetpulse.llm import ngram_join as m

    monkeypatch.setattr(m, "SMALL", 3)
    monkeypatch.setattr(m, "BLOCK", 4)
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_links"]) for r in ngram_join(hard_docs).collect()}
    assert got == brute_force(hard_rows)


def test_recall_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expect = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["class_id"], r["set_id"], r["n_links"]) for r in ngram_join(docs).collect()}
    assert got.keys() == expect.keys()
    assert sum(got[i] == expect[i] for i in got) >= 0.98 * len(got)


def test_empty(no_docs):
    assert ngram_join(no_docs).count() == 0


def test_texts_under_one_id_are_sets_of_their_own(spark):
    """Ids 5 and 6 have a copy of another text and a text of their own; the latter link to each other only."""
    words = [f"w{i}" for i in range(60)]
    copy, own = " ".join(words), " ".join(reversed(words))
    rows = [(9, copy), (5, copy), (5, own), (1, copy + " end"), (6, copy + " end"), (6, own + " end")]
    got = sorted((r["doc_id"], r["class_id"], r["set_id"], r["n_links"]) for r in ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(9, 1, 5, 1), (5, 1, 5, 1), (1, 1, 1, 1), (6, 1, 1, 1), (5, 5, 5, 1), (6, 5, 6, 1)])
