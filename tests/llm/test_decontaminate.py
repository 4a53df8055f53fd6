from fleetpulse.llm.decontaminate import contaminated, tiles


def test_tiles_are_longest_first_and_never_overlap():
    assert tiles([1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 9, 1, 2, 3, 4]) in ([(0, 5, 4), (4, 0, 4)], [(4, 0, 4), (0, 5, 4)])
    assert tiles([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6]) == [(0, 5, 6)]
    assert tiles([1] * 8, [1] * 4) == [(0, 0, 4)]
    assert tiles([1, 2, 3], [4, 5, 6]) == []


def test_reordered_passages_and_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "mu nu. Eta theta IOTA kappa, lambda; filler words here alpha beta gamma delta epsilon zeta end"
    third = "something alpha beta gamma delta and other words that have nothing in common at all"
    docs = spark.createDataFrame([(1, item, 0), (2, moved, 0), (3, third, 0), (4, None, 0), (5, "", 0), (5, item, 0), (None, item, 0), (6, "xx " * 4000 + item, 0), (7, "short test", 0)],
                                 "doc_id bigint, text string, item_id int")
    tests = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (None, item), (13, "short test")], "item_id bigint, text string")
    got = contaminated(docs, tests).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == sorted([(d, 10) for d in (1, 2, 5, 6, -1) for _ in range(2)] + [(7, 13)])
    two = next(r for r in got if r["doc_id"] == 2)
    assert two["coverage"] == 11 / 12 and two["n_tiles"] == 2
    assert contaminated(docs.limit(0), tests).count() == 0
    assert contaminated(docs, tests.limit(0)).count() == 0


def test_shards_change_nothing(spark, monkeypatch):
    from fleetpulse.llm import decontaminate as m

    docs, tests = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, contaminated(docs, tests).collect()))
    monkeypatch.setattr(m, "SHARD_WORDS", 500)
    assert sorted(map(tuple, contaminated(docs, tests).collect())) == whole
