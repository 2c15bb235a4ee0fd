import random

import pytest

PASSAGE = " ".join(f"word{i}" for i in range(60)) + "."


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with nulls, empty, tiny and very long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng = random.Random(11)
    texts = ["\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))) for _ in range(50)]
    rows = list(enumerate(texts))
    rows += [(100, None), (101, ""), (102, "   "), (103, "one"), (104, "one"), (105, "x\n\n\ny"), (106, "é" * 200), (107, "é" * 200)]
    rows += [(110 + i, texts[i]) for i in range(6)]  # copies
    for i in range(8):  # near copies
        w = texts[10 + i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((120 + i, " ".join(w)))
    rows += [(140 + i, f"{prose(rng, 20)}\n{PASSAGE}\n{prose(rng, 20)}") for i in range(4)]
    rows += [(150, texts[20]), (150, texts[21] + " tail"), (151, texts[22]), (151, texts[22])]  # ties and repeated rows
    rows += [(160, prose(rng, 30_000)), (161, "ab " * 5_000), (None, "no id"), (None, None)]
    base = prose(rng, 120).split(" ")
    for i in range(30):  # a group of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((200 + i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src", 1, 2, 3, "z") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, text_key long, node long, bucket long, runs string").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
