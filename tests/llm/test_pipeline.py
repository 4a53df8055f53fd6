"""run() against brute force on the smallest tables."""

import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from fleetpulse.llm.bpe import read_ranks
from fleetpulse.llm.common import checksum_mod, table
from fleetpulse.llm.toxicity import toxic_scores, train
from tests.llm.test_ngram_join import brute_force

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def tile_cover(item, text):
    """Coverage by repeatedly taking the longest common run of unused words, four at least."""
    used_a, used_b, total = [False] * len(item), [False] * len(text), 0
    for n in range(len(item), 3, -1):
        for i in range(len(item) - n + 1):
            for j in range(len(text) - n + 1):
                if item[i:i + n] == text[j:j + n] and not any(used_a[i:i + n]) and not any(used_b[j:j + n]):
                    used_a[i:i + n], used_b[j:j + n] = [True] * n, [True] * n
                    total += n
    return total / len(item)


def test_run_matches_brute_force(spark):
    docs = table(spark, DIR, "documents")
    model = train(docs, table(spark, DIR, "labels"), checksum_mod("_id", 5) != 0)
    toxic = {r["doc_id"] for r in toxic_scores(docs, model).collect() if r["score"] >= 0.5}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    newest = {}
    for i, t in left.items():
        newest[t] = max(i, newest.get(t, i))
    left = {i: t for i, t in left.items() if newest[t] == i}
    group = brute_force(list(left.items()))
    left = {i: t for i, t in left.items() if group[i][0] == i}
    items = [words(r["text"]) for r in table(spark, DIR, "benchmark").collect()]
    grams = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in items]

    def leaks(t):
        w = words(t)
        own = {tuple(w[k:k + 4]) for k in range(len(w) - 3)}
        return any(len(own & g) * 8 >= len(i) and tile_cover(i, w) >= 0.5 for i, g in zip(items, grams))

    left = {i: t for i, t in left.items() if not leaks(t)}
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in got} == set(left)
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in got:
        assert r["round_trip"] and r["text"] == left[r["doc_id"]]
        assert np.frombuffer(r["ids_le"], "<u4").tolist() == real.encode_ordinary(r["text"])


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 3000, "en", "s", 1), (3, "x" * 3000, "en", "s", 1)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, DIR)
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} >= {None, 3}
        assert step(spark, docs.limit(0), DIR).count() == 0


def test_texts_under_one_id_and_clashing_names(spark):
    """Id 5 has a copy of another document and a text of its own, which has to stay; both texts of id 6 are near copies."""
    rnd = [f"w{i * 7919 % 1009}" for i in range(60)]
    copy, own = " ".join(rnd), " ".join(reversed([f"v{i}" for i in range(60)]))
    near = " ".join([*rnd[:-1], "changed"])
    rows = [(9, copy), (5, copy), (5, own), (1, near), (6, near + " end"), (6, own + " more words of its own here")]
    docs = spark.createDataFrame([(i, t, 7.0, "x", "y") for i, t in rows], "doc_id bigint, text string, _toxicity double, _gone string, _digest string")
    exact = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, docs, DIR).collect())
    assert exact == sorted(r for r in rows if r != (5, copy))
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, DIR).collect()}
    assert {(1, near), (5, own)} <= kept and not {i for i, _ in kept} & {6, 9}
    scored = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert scored.columns == docs.columns and {r["_toxicity"] for r in scored.collect()} <= {7.0}
