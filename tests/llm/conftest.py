import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, repeated rows and a long text."""
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["Zürich", "été,", "naïve."]
    line = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passages = [line(rng.randint(25, 60)) for _ in range(4)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.3 else line(rng.randint(0, 50)) for _ in range(rng.randint(1, 5))]
        rows.append((d, ("\n" if d % 3 else "  ").join(parts)))
    for k in range(8):
        words = rows[k * 5][1].split(" ")
        if len(words) > 3:
            words[len(words) // 2] = "changed"
        rows.append((100 + k, rows[k * 7][1]))
        rows.append((200 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "x"), (304, line(6000)), (305, "aa " * 300), (None, passages[0]), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with what operators make."""
    rows = [(d, t, "en" if (d or 0) % 2 else None, f"s{(d or 0) % 3}" if d != 303 else None, 1.5, "k", 7) for d, t in corpus]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, kept string, size int")
    return made.repartition(3).cache()
