"""Quality rules against counting by hand, brute-force covariance estimates and labelled rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import quality_outliers as qo
from fleetpulse.llm.queries import op11_quality_outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words, seen, dups = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_equal_brute_force(spark, hard_docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), r["base_failed"]) for r in qo.text_statistics(hard_docs).collect())
    want = []
    for r in hard_docs.collect():
        n = counted(r["text"])
        want.append(((r["doc_id"] is None, r["doc_id"] or 0), n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(want)


def test_counts_of_slices():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["a", "bé", "c|", "X"], k=rnd.randint(0, 60))) + "\n" * rnd.randint(0, 3) + "a\na\n" for _ in range(50)]
    whole = pa.array(["skip", *texts, None])
    counts = qo.text_counts(whole.slice(1, 50))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(counts[c][i]) for c in names) for i in range(50)] == [counted(t) for t in texts]


def estimates(y):
    """The documented steps over one group, in numpy: three starts, the nearest half by distance class, the least determinant."""
    floor = np.array(list(qo.LEAST_SPREAD.values()), float)
    mad = np.maximum(np.median(np.abs(y), axis=0) * 1.4826, floor)
    starts = [((y / mad) ** 2).sum(1), ((y / floor) ** 2).sum(1), np.abs(y / floor).max(1) ** 2]

    def half(d):
        classes = np.floor(np.log(d + 1e-9) * qo.BINS)
        order = np.sort(classes)
        chosen = y[classes <= order[int(np.ceil((len(y) + qo.P + 1) / 2)) - 1]]
        cov = np.cov(chosen.T, bias=True) + np.diag(floor ** 2)
        return np.linalg.slogdet(cov)[1], chosen.mean(0), np.linalg.inv(cov)

    found = []
    for d in starts:
        best = half(d)
        while True:
            new = half(np.maximum(np.einsum("ni,ij,nj->n", y - best[1], best[2], y - best[1]), 0))
            if new[0] >= best[0] - 1e-12:
                break
            best = new
        found.append(best)
    return min(found, key=lambda b: b[0])


def test_estimates_equal_brute_force(spark):
    rnd = np.random.default_rng(4)
    groups = {"a": rnd.normal(0, 1, (400, qo.P)) * [50, 400, 500, 900, 350, 100], "b": rnd.normal(0, 300, (150, qo.P))}
    groups["b"][:60] += 4000  # two fifths are far off
    rows = [(g, 1, *map(int, np.rint(v))) for g, y in groups.items() for v in y]
    df = spark.createDataFrame(rows, "grp string, n_words int, " + ", ".join(f"{y} bigint" for y in qo.Y)).repartition(5)
    sizes = df.groupBy("grp").agg(F.count("*").alias("n"))
    got = {r["grp"]: r for r in qo.covariance_estimates(df, sizes, len(rows)).collect()}
    for g, y in groups.items():
        _, mu, inv = estimates(np.rint(y))
        assert np.allclose(got[g]["mu"], mu, atol=1e-6)
        assert np.allclose(np.array(got[g]["inv"]).reshape(qo.P, qo.P), inv, rtol=1e-5, atol=1e-12)
    assert np.abs(got["b"]["mu"]).max() < 200  # not drawn to the far rows


def prose(rnd, n):
    return ". ".join(" ".join(rnd.choices(["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "ut"], k=9)).capitalize() + str(rnd.randrange(10**6)) for _ in range(n // 9 + 1))


def test_outliers_go_and_clean_texts_stay(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 80), "en", "s0") for i in range(260)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rnd, 80).split()), "en", "s0") for i in range(40)]
    rows += [(2000 + i, prose(rnd, 80).upper().replace(" ", "!! "), "en", "s0") for i in range(20)]
    rows += [(3000 + i, rows[0][1], "en", "s0") for i in range(200)]  # a hot group of copies
    rows += [(4000 + i, prose(rnd, 60), None, None) for i in range(30)] + [(5000, None, "en", "s0"), (5001, "", None, "s0"), (5002, "few words", "en", None), (None, prose(rnd, 50), "en", "s9")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, lang string, source string, grp string, n string")
    got = [(r["doc_id"], r["kept"], r["base_failed"], r["distance"]) for r in qo.quality_verdicts(df.repartition(3)).collect()]
    assert len(got) == len(rows)
    for doc, kept, failed, _ in got:
        assert kept == (doc is None or doc < 1000 or 3000 <= doc < 5000), doc
        assert failed == (doc is not None and doc >= 5000)
    other = qo.quality_verdicts(df.repartition(11)).collect()
    assert sorted(map(str, got)) == sorted(str((r["doc_id"], r["kept"], r["base_failed"], r["distance"])) for r in other)


def test_empty_table(spark, no_docs):
    assert qo.quality_verdicts(no_docs).count() == 0


def test_query_on_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    got = op11_quality_outliers(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    clean = got.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = got.filter("quality = 0 and not base_failed").agg(F.avg(1 - F.col("kept").cast("int"))).first()[0]
    assert clean >= 0.99 and junk >= 0.9
