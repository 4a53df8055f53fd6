"""Product codes against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from fleetpulse.llm import vector_codes as vc
from fleetpulse.llm.queries import ORACLES, op13_vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, vector string, n bigint"


def brute(rows):
    """{(vec_id, vector): (code, error)} and the codebooks, by comparing with every entry."""
    kept = sorted(((i is None, i or 0), [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows)
    x = np.array([v for _, v in kept], dtype=object).reshape(len(kept), 16, -1)
    books = x[:64].copy()

    def assign():
        return [[min((int(((part - books[e, p]) ** 2).sum()), e) for e in range(len(books))) for p, part in enumerate(v)] for v in x]

    for _ in range(2):
        found = assign()
        new = books.copy()
        for p in range(16):
            for e in range(len(books)):
                mine = [v[p] for v, f in zip(x, found) if f[p][1] == e]
                if mine:
                    new[e, p] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    return [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in assign()], books


def rows_of(seed, n, width=2, grid=False):
    rnd = random.Random(seed)
    value = (lambda: rnd.randint(-2, 2) / 256) if grid else (lambda: rnd.gauss(0, 0.3))
    return [(i, [value() for _ in range(16 * width)]) for i in range(n)]


@pytest.mark.parametrize("n,width,grid", [(1, 1, False), (30, 2, False), (200, 3, False), (150, 1, True), (150, 2, True)])
def test_codes_equal_brute_force(spark, n, width, grid):
    rows = rows_of(n, n, width, grid)  # the grid has many ties and equal entries
    df = spark.createDataFrame([(i, v, i % 3, "c", "v", 1) for i, v in rows], SCHEMA).repartition(3)
    codes, book = vc.encode(df)
    want, books = brute(rows)
    got = [(r["code"], r["error"]) for r in codes.orderBy("vec_id").collect()]
    assert got == want
    assert book.entries.transpose(1, 0, 2).tolist() == books.tolist()


def test_orchard_search_measures_fewer(monkeypatch):
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-200, 200, (16, 64, 4))
    vectors = rnd.integers(-200, 200, (500, 16, 4))
    index, best = vc.Codebook(entries).nearest(vectors)
    full = ((vectors[:, :, None, :] - entries[None]) ** 2).sum(3)
    assert (index == full.argmin(2)).all() and (best == full.min(2)).all()


def test_malformed_rows_and_labels(spark):
    good = rows_of(9, 80)
    bad = [(500, None), (501, [None] + [0.0] * 31), (502, [float("nan")] * 32), (503, [float("inf")] * 32), (504, []), (505, [0.1] * 31), (506, [0.1] * 48)]
    odd = [(None, good[3][1]), (7, good[5][1]), (7, good[5][1]), (900, [1e30] * 32), (901, [-1e30] * 32)]
    labels = lambda i: None if i is None or i % 5 == 0 else i % 5
    df = spark.createDataFrame([(i, v, labels(i), "c", "v", 1) for i, v in good + bad + odd], SCHEMA)
    codes, book = vc.encode(df)
    out = vc.label_errors(codes).collect()
    assert len(out) == len(good) + len(odd)
    sums = {}
    for r in out:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in out) and None in sums
    assert int(np.abs(book.entries).max()) <= vc.LIMIT
    again = vc.decode(codes, book).collect()
    assert all(len(r["vector"]) == 32 for r in again) and len(again) == len(out)


def test_empty_table(spark):
    codes, book = vc.encode(spark.createDataFrame([], SCHEMA))
    assert book is None and vc.label_errors(codes).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    rel = con.sql(ORACLES["op13_vector_codes"])
    df = op13_vector_codes(spark, d)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
