import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, drops string, row string, kept string, score double, share int, node int, bucket int"


def word(rng):
    return "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))


def made(texts, ids=None):
    """Rows of SCHEMA: the columns of documents and others that clash with names used inside."""
    out = []
    for k, t in enumerate(texts):
        i = ids[k] if ids else k
        out.append((i, t, None if k % 7 == 3 else "en", None if k % 5 == 2 else f"src{k % 3}", None if t is None else len(t), "x", "r", "k", 0.5, 1, 2, 3))
    return out


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, very long, repeated, tied and non-ASCII texts."""
    rng = random.Random(5)
    base = " ".join(word(rng) for _ in range(120))
    long = "\n".join(" ".join(word(rng) for _ in range(12)) for _ in range(1500))
    near = base.split()
    near[60] = "changed"
    return [None, "", " ", "\n", "a", "the the the", base, base, " ".join(near), base.upper(), long, "é ü ñ 日本 😀 z", "x" * 3000, long + "\ntail", "one two three four", base[:300] + " " + base[300:], None, ""]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(made(odd_texts), SCHEMA)


@pytest.fixture(scope="session")
def repeated(spark, odd_texts):
    """Null ids, an id with two texts, and rows that repeat whole."""
    texts = [odd_texts[6], odd_texts[6], odd_texts[10], "other words here " * 20, odd_texts[6], None]
    return spark.createDataFrame(made(texts, [1, 1, 1, None, None, None]), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
