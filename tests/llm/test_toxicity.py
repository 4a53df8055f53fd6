import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import toxicity
from fleetpulse.llm.toxicity import toxic_scores, train


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(5)
    syllables = ["an", "er", "th", "on", "in", "ou", "ti", "es", "re", "le"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rnd.randint(5, 40))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scumbag", "moron"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learns_insults_with_gaps_and_inserted_characters(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in labelled] + [(0, 0), (None, 1), (9000, None)], "doc_id bigint, toxic int")
    model = train(docs, labels, F.col("_id") < 180)
    probes = {1: None, 2: "", 3: "an er the on inter", 4: "you idi-ot there", 5: "an i d i o t er", 6: "er " * 20000 + " scum.bag",
              7: "an" * 3000, 8: "sc*umbag"}
    got = {r["doc_id"]: r["score"] for r in toxic_scores(spark.createDataFrame(list(probes.items()), "doc_id bigint, text string"), model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all(got[i] < 0.5 for i in (1, 2, 3)) and got[1] == got[2]
    assert all(got[i] >= 0.5 for i in (4, 5, 6, 8)), got
    held = {r["doc_id"]: r["score"] >= 0.5 for r in toxic_scores(docs, model).collect() if r["doc_id"] >= 180}
    assert sum(held[i] == bool(x) for i, _, x in labelled if i >= 180) >= 0.95 * len(held)


def test_without_labels_nothing_is_toxic(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled][:5], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r["score"] < 0.5 for r in toxic_scores(docs, train(docs, labels, F.lit(True))).collect())
    assert toxic_scores(docs.limit(0), train(docs.limit(0), labels, F.lit(True))).count() == 0


def test_the_driver_fits_nothing(spark, labelled, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in labelled], "doc_id bigint, toxic int")

    def in_driver(*_):
        raise AssertionError("the driver fits the training texts")

    monkeypatch.setattr(toxicity, "fit", in_driver)
    model = train(docs, labels, F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in toxic_scores(docs, model).collect()}
    assert sum((scores[i] >= 0.5) == bool(x) for i, _, x in labelled) >= 0.95 * len(labelled)
