import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, kind string, node string, w string"


def make_docs(spark, rows):
    """Documents from (doc_id, text), with extra columns whose names clash with inner ones."""
    full = [(i, t, None, "src0", None, "x", "x", None, "x", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def hard_rows():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    base, passage = text(80), text(40)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d"), (6, "a b c d"), (None, base), (7, base), (8, base), (8, base),
            (9, base + " extra"), (10, "new " + base), (11, text(30) + " " + passage + " " + text(10)), (12, passage), (13, text(5) + "\n" + passage),
            (14, text(4000)), (15, "x" * 5000), (16, "ab " * 300), (17, "\u0001 odd \u0002 \x1c\u00a0\u2028 marks"), (18, text(25)), (19, "Großes ñandú 🙂 😀 ünïcode")]
    rows += [(100 + i, text(rnd.randint(0, 120))) for i in range(40)]
    rows += [(200 + i, base) for i in range(25)]  # a hot group
    near = base.split()
    for i in range(15):
        own = list(near)
        own[rnd.randrange(len(own))] = f"edit{i}"
        rows.append((300 + i, " ".join(own)))
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    return make_docs(spark, hard_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
