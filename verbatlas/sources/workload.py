"""Seeded vocabularies, documents and query mixes for benchmarks."""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(n: int, seed: int = 42) -> list[str]:
    """n different words of 3 to 12 letters."""
    rng, words = random.Random(seed), {}
    while len(words) < n:
        words["".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 12)))] = None
    return list(words)


def documents(spark: SparkSession, words: list[str], n: int, seed: int = 42) -> DataFrame:
    """id, title (3 to 20 words), tags (1 to 10), year (2000 to 2024)."""
    pool = F.lit(words) if words else F.array()
    pick = lambda i, salt: F.element_at(pool, (F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    some = lambda low, high, salt: F.array_join(F.transform(F.sequence(F.lit(1), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")), lambda i: pick(i, salt)), " ")
    return spark.range(1, n + 1).select(F.concat(F.lit("d"), "id").alias("id"), some(3, 20, seed).alias("title"), some(1, 10, seed + 1).alias("tags"), (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(25)) + 2000).cast("int").alias("year"))


def misspelt(word: str, rng: random.Random) -> str:
    """Two letters swapped, one deleted or one doubled; words under three letters stay."""
    if len(word) < 3:
        return word
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    if kind == 0:
        i = min(i, len(word) - 2)
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    return word[:i] + word[i + 1 :] if kind == 1 else word[:i] + word[i] + word[i:]


def prefix(word: str, rng: random.Random) -> str:
    """Three letters at least, two fewer than the word at most; words up to four letters stay."""
    return word[: rng.randint(3, len(word) - 2)] if len(word) > 4 else word


def single_queries(words: list[str], n: int, seed: int = 42) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        word, draw = rng.choice(words), rng.random()
        out.append(misspelt(word, rng) if draw < 0.10 else prefix(word, rng) if draw < 0.35 else word)
    return out


def multi_queries(words: list[str], n: int, seed: int = 42) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        row = rng.choices(words, k=rng.randint(2, 4))
        if rng.random() < 0.10:
            i = rng.randrange(len(row))
            row[i] = misspelt(row[i], rng)
        if rng.random() < 0.25:
            row[-1] = prefix(row[-1], rng)
        out.append(" ".join(row))
    return out


def year_filters(n: int, seed: int = 42) -> list[dict[str, list[str]]]:
    rng = random.Random(seed)
    return [{"year": [str(rng.randint(2000, 2024))]} for _ in range(n)]
