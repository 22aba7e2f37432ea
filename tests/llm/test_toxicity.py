import random
import zlib

import numpy as np

from verbatlas.llm import toxicity as t


def corpus(n, seed=1):
    """An insult with the mention of a group is toxic; either alone isn't."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for _ in range(n):
        kind = rng.randrange(4)
        text = rng.choices(words, k=30) + ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rng.shuffle(text)
        texts.append(" ".join(text))
        labels.append(int(kind == 3))
    return texts, np.array(labels, float)


def test_learns_pairs():
    texts, labels = corpus(3000)
    words = t.Words()
    sets = [t.slots(x, words) for x in texts]
    model = t.fit(sets[:2000], labels[:2000], np.ones(2000), rounds=10)
    guess = model.score(sets[2000:]) >= t.THRESHOLD
    truth = labels[2000:] > 0
    assert (guess & truth).sum() >= 0.9 * truth.sum() and (guess & ~truth).sum() <= 0.1 * (~truth).sum()


def test_learns_pairs_whose_members_mean_nothing_alone():
    """Toxic is exactly one of two words: no linear weights can tell."""
    rng = random.Random(3)
    words, texts, labels = [f"w{k}" for k in range(300)], [], []
    for _ in range(6000):
        kind = rng.randrange(4)
        texts.append(" ".join(rng.choices(words, k=12) + ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))))
        labels.append(float(kind in (1, 2)))
    cache, labels = t.Words(), np.array(labels)
    sets = [t.slots(x, cache) for x in texts]
    model = t.fit(sets[:4500], labels[:4500], np.ones(4500))
    assert ((model.score(sets[4500:]) >= 0.5) == (labels[4500:] > 0)).mean() >= 0.98
    linear = t.Model(model.bias, model.row, model.w, np.zeros_like(model.v))
    assert ((linear.score(sets[4500:]) >= 0.5) == (labels[4500:] > 0)).mean() <= 0.7


def test_score_against_the_formula():
    """Pair by pair in plain Python."""
    rng = np.random.default_rng(5)
    n = 6
    row = np.full(1 << t.BITS, -1, np.int32)
    row[:n] = np.arange(n)
    model = t.Model(0.3, row, rng.normal(size=n), rng.normal(size=(n, t.FACTORS)))
    sets = [np.array(x, np.int64) for x in ([], [2], [0, 1, 5], [0, 1, 2, 3, 4, 5, 9])]
    for s, found in zip(sets, model.score(sets)):
        known = [int(k) for k in s if k < n]
        logit = 0.3 + sum(model.w[k] for k in known) + sum(sum(a * b for a, b in zip(model.v[i], model.v[j])) for i in known for j in known if i < j)
        assert abs(found - 1 / (1 + np.exp(-logit))) < 1e-9


def test_rows_beyond_the_byte_bound_are_not_learnt_from(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words there") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    monkeypatch.setattr(t, "MOST_BYTES", 0)
    assert not t.learn(docs, labels).w.size
    monkeypatch.setattr(t, "MOST_BYTES", 1 << 20)
    assert t.learn(docs, labels).w.size


def test_learns_and_scores_tables(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=20) + ["vile"] * (i % 5 == 0)), "x") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = t.scored(docs, t.learn(docs, labels)).select("doc_id", "score", "predicted").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == 800 and sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)


def test_odd_rows(spark, odd, none, odd_texts):
    labels = spark.createDataFrame([(k, k % 2) for k in range(6, 15)], "doc_id bigint, toxic int")
    no_labels = labels.where("doc_id < 0")
    out = t.scored(odd, t.learn(odd, labels)).collect()
    assert len(out) == len(odd_texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= t.THRESHOLD) for r in out)
    empty = {r.score for r in out if not (r.text or "").strip()}
    assert len(empty) == 1
    assert t.scored(none, t.learn(none, no_labels)).count() == 0
    assert all(r.predicted == 0 for r in t.scored(odd, t.learn(odd, no_labels)).collect())
