import random

import pytest

SCHEMA = "doc_id long, text string, source string, kept string, row string, key string, size int"


def frame(spark, rows, partitions=3):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, s, "k", "r", "key", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) rows: null, empty, white space, copies, near copies, shared passages, one long text."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "déjà", "été", "don't", "x1", "42", "–", "日本", "🙂", "omega"] + [f"w{i}" for i in range(200)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(70)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "one two", "b"), (4, "One Two", "b"), (4, "One Two", "b"),
            (5, "same same " * 40, "b"), (6, prose(4000), "c")]
    for i in range(7, 60):
        kind, text = i % 6, prose(rng.randint(12, 120))
        if kind == 0:
            text = rows[-1][1].upper() if rows[-1][1] else text
        elif kind == 1:
            text = passage + "\n" + text
        elif kind == 2 and len((rows[-3][1] or "").split()) > 30:
            text = rows[-3][1] + " tail"
        elif kind == 3:
            text = text + "\nline again here\nline again here\n"
        rows.append((i, text, "c" if i % 3 else "a"))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [], 1)
