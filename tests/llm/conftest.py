import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, c0 int"


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice("abcdefg") * (rng.randrange(vocabulary) % 3) + f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, copies and near copies, and columns whose names clash."""
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([0, 1, 2, 3, 5, 8, 20, 40, 90, 200, 600])) for _ in range(80)]
    bases = [prose(rng, n) for n in (12, 30, 33, 60, 64, 130, 300, 520)]
    for b in bases:
        texts += [b] * 3 + [edited(rng, b, e) for e in (1, 1, 2, 3, 4, 6, 8) for _ in range(2)]
    texts += [None, "", " \n\t", "***", "é ü ñ", "\x1f x", "x" * 5000, prose(rng, 20000)]
    shared = prose(rng, 60)
    texts += [prose(rng, n) + "\n" + shared + "\n" + prose(rng, n) for n in (1, 5, 10, 40, 100) * 4]
    out = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "a", None][i % 4], None if t is None else len(t), "s", i) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, texts[85], "en", "a", 1, None, None), (None, None, None, None, None, None, None), (None, prose(rng, 30), None, "a", 1, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
