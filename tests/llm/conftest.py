import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, ties, and a repeated row."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(130)
    rows = [(0, None), (1, ""), (2, "one"), (3, "Two words"), (4, "   \n\t "), (5, "aa" * 3000), (6, "aa" * 900)]
    for i in range(7, 30):
        rows.append((i, text(rng.randint(3, 150)) + (" " + passage + " " + text(20) if i % 5 == 0 else "")))
    base = rows[12][1] + " " + text(120)
    for i in range(30, 50):  # near copies of one text
        words = base.split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(50, rows[20][1]), (51, rows[20][1]), (52, text(9000)), (20, rows[20][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """Further columns have the names that operators return."""
    rows = [(i, t, 7, "x", 1.0, "y") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, ids string, score double, spans string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
