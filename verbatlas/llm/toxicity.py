"""Toxicity by a factorization machine over hashed words.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct words of a text, so a pair of words
(an insult and the mention of a group, say) can weigh more or less than both alone. Every learnt word has
factors, also one that means nothing alone. Learning runs on the driver over a bounded sample of labelled
rows; scoring is one pass over all texts, of which only the text goes to Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm import common

BITS = 20  # of a word's hash
STEMS = (4, 5)
FACTORS = 8
THRESHOLD = 0.3
MOST_POSITIVE, MOST_NEGATIVE = 4_000, 8_000  # labelled rows learnt from, those of the lowest hash of their id
MOST_BYTES = 128 << 20  # of those rows' slots on the driver; a row beyond it isn't learnt from
# Settings chosen by folds within the rows that may be learnt from (crc32 mod 4 = 0, 1, 3).
PULL, FREE = 0.25, 0.01  # of weights towards their prior; FREE for words that stand out by themselves
FACTOR_START, FACTOR_PULL, FACTOR_RATE = 0.005, 0.1, 0.05  # spread at first, pull towards 0, share of the weights' rate
ROUNDS = 8
LEAST_ROWS = 4  # of the sample that hold a word, else it isn't learnt
_PUNCTUATION = re.compile(r"[\W_]+")


class Words(common.WordCache):
    """From a raw word to the slots of its terms: the word and its stems of STEMS letters; none if nothing is left of it."""

    def look(self, raw: str) -> tuple[int, ...]:
        word = _PUNCTUATION.sub("", raw.lower())
        terms = [word] * bool(word) + [f"{word[:n]}-" for n in STEMS if len(word) > n]
        return tuple(xxhash.xxh64_intdigest(t) >> (64 - BITS) for t in terms)


def shared_words() -> Words:
    return common.kept("toxicity", "words", Words)


def slots(text: str, words: Words) -> np.ndarray:
    return np.unique(np.fromiter(chain.from_iterable(map(words.__getitem__, set(text.split()))), np.int32))


class Model:
    """bias, w (slots) and v (slots x FACTORS) of the words that were learnt; row maps a slot to its place."""

    def __init__(self, bias: float, row: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.row, self.w, self.v = bias, row, w, v

    def logits(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """places: learnt words of all texts in sequence; starts: where each text's begin, and the end."""
        vectors = self.v[places]
        sums = _sums(vectors, starts)
        return self.bias + _sums(self.w[places], starts) + 0.5 * ((sums**2).sum(1) - _sums((vectors**2).sum(1), starts))

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        kept = [self.row[s] for s in sets]
        kept = [k[k >= 0] for k in kept]
        starts = np.concatenate([[0], np.cumsum([k.size for k in kept], dtype=np.int64)])
        return 1 / (1 + np.exp(-np.clip(self.logits(np.concatenate(kept) if kept else np.empty(0, np.int64), starts), -30, 30)))


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of rows; 0 for an empty run."""
    out = np.zeros((starts.size - 1, *x.shape[1:]))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if full.size:
        out[full] = np.add.reduceat(x, starts[full], axis=0)
    return out


def _rows_with(sets: list[np.ndarray]) -> np.ndarray:
    """In how many sets each slot stands, some sets at a time."""
    out = np.zeros(1 << BITS, np.int64)
    for b in range(0, len(sets), 500):
        out += np.bincount(np.concatenate(sets[b : b + 500]), minlength=out.size)
    return out


def _prior(sets: list[np.ndarray], labels: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each learnt word, shrunk to 0 the less they stand out from chance; does it stand out at all?"""
    if not len(sets):
        return np.zeros(learnt.size), np.zeros(learnt.size, bool)
    rows = [_rows_with([s for s, label in zip(sets, labels) if label == t])[learnt] for t in (1, 0)]
    n = [max(1, int((labels == t).sum())) for t in (1, 0)]
    share = [(r + 0.5) / (m + 1) for r, m in zip(rows, n)]
    odds = np.log(share[0] / (1 - share[0])) - np.log(share[1] / (1 - share[1]))
    every, all_rows = rows[0] + rows[1], n[0] + n[1]
    cells = [(r, every * m / all_rows) for r, m in zip(rows, n)] + [(m - r, (all_rows - every) * m / all_rows) for r, m in zip(rows, n)]
    ratio = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(x, 1e-9)), 0) for o, x in cells)  # log-likelihood ratio
    doubt = np.sqrt(2 * np.log(max(2, learnt.size)))  # what the largest of so many words reaches by chance
    away = np.sqrt(np.maximum(ratio, 0)) / doubt
    return odds * np.clip(away - 1, 0, 1), away > 1


def fit(sets: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Adagrad over minibatches; without rows, or with one label only, the bias alone tells the share."""
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(sets) else 0.01
    bias = float(np.log(share / (1 - share)))
    learnt = np.flatnonzero(_rows_with(sets) >= LEAST_ROWS)
    row = np.full(1 << BITS, -1, np.int32)
    row[learnt] = np.arange(learnt.size)
    rng = np.random.default_rng(seed)
    w, out = _prior(sets, labels, learnt)
    v = rng.normal(0, FACTOR_START, (learnt.size, FACTORS))
    prior, pull = w.copy(), np.where(out, FREE, PULL)
    model = Model(bias, row, w, v)
    if not len(sets) or labels.min() == labels.max():
        return model
    gw, gv, gb = np.full(w.shape, 1.0), np.full(v.shape, 1e-3), 1.0
    kept = [row[s] for s in sets]
    kept = [k[k >= 0] for k in kept]
    for step in range(rounds):
        rate = 0.5 / (1 + 0.2 * step)
        for part in np.array_split(rng.permutation(len(kept)), max(1, len(kept) // 128)):
            places = np.concatenate([kept[i] for i in part])
            size = np.array([kept[i].size for i in part])
            starts = np.concatenate([[0], np.cumsum(size)])
            owner = np.repeat(np.arange(part.size), size)
            vectors = v[places]
            sums = _sums(vectors, starts)
            logit = model.bias + _sums(w[places], starts) + 0.5 * ((sums**2).sum(1) - _sums((vectors**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weights[part] / part.size
            order = np.argsort(places, kind="stable")
            sorted_places, by = places[order], owner[order]
            first = np.flatnonzero(np.diff(sorted_places, prepend=-1))
            used = sorted_places[first]
            e = np.add.reduceat(error[by], first) if first.size else np.empty(0)
            pulled = np.add.reduceat((error[:, None] * sums)[by], first, axis=0) if first.size else np.empty((0, FACTORS))
            dw = e + (pull * (w - prior))[used]
            dv = pulled - e[:, None] * v[used] + FACTOR_PULL * v[used]
            gw[used] += (dw * part.size) ** 2
            gv[used] += (dv * part.size) ** 2
            gb += (error.sum() * part.size) ** 2
            w[used] -= rate * part.size * dw / np.sqrt(gw[used])
            v[used] -= FACTOR_RATE * rate * part.size * dv / np.sqrt(gv[used])
            model.bias -= rate * error.sum() * part.size / np.sqrt(gb)
    return model


def fold(doc_id):
    """crc32 of the id as text, mod 4; a null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = shared_words()
    for batch in common.slices(batches, "text"):
        sets = [slots(t, words).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("toxic"), batch.column("order"), pa.array(sets, pa.binary())], ["toxic", "order", "slots"])


def learn(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    """From labelled rows, those of crc32(doc_id) mod 4 = 2 left out if held_out.

    labels: doc_id and toxic (0/1; null rows are no labels; of several for an id the highest counts). Each
    label has up to its MOST rows, weighted to its share of all labelled rows.
    """
    spark = docs.sparkSession
    common.ship(spark)
    marks = common.picked(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(fold(F.col("doc_id")) != 2) if held_out else marks
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    chosen = [marks.where(F.col("toxic") == t).withColumn("order", F.xxhash64("doc_id")).orderBy("order").limit(most) for t, most in ((1, MOST_POSITIVE), (0, MOST_NEGATIVE))]
    sample = common.id_and_text(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").mapInArrow(_sample, "toxic int, order bigint, slots binary")
    sample = common.stored(sample, "labelled-slots")
    sizes = sorted(map(tuple, sample.select("order", F.octet_length("slots")).collect()))  # two numbers a row
    within = np.cumsum([n for _, n in sizes]) <= MOST_BYTES
    last = max((o for (o, _), fits in zip(sizes, within) if fits), default=None)
    rows = sample.where(F.col("order") <= last).toArrow() if last is not None else None
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("order", "toxic", "slots")))) if rows is not None else []
    y = np.array([toxic for _, toxic, _ in rows], np.float64)
    seen = {t: max(1, int((y == t).sum())) for t in (0, 1)}
    everything = max(1, sum(totals.values()))
    weights = np.array([totals.get(int(t), 0) / seen[int(t)] for t in y]) * (len(rows) / everything) if rows else np.empty(0)
    return fit([np.frombuffer(s, np.int32) for _, _, s in rows], y, weights)


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text; null and empty ones score by the bias alone."""
    common.ship(spark)
    sent = spark.sparkContext.broadcast((model.bias, model.row, model.w.astype(np.float32), model.v.astype(np.float32)))  # 1 << BITS slots at most

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, own = shared_words(), Model(*sent.value)
        for texts in batches:
            sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] if sizes.size else 0, 4 << 20)))
            parts = [own.score([slots(t or "", words) for t in texts.slice(a, b - a).to_pylist()]) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
            yield pa.array(np.concatenate(parts) if parts else own.score([slots("", words)] * len(texts)), pa.float64())

    return F.arrow_udf(run, "double")(text)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, which has a text, with score and predicted behind its own columns (in place of any it has).

    Every row stays, repeated ones too.
    """
    out = docs.drop("score", "predicted").withColumn("score", score_of(F.col("text"), model, docs.sparkSession))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = learn(docs, common.read(spark, sf_dir, "labels"))
    out = scored(common.id_and_text(docs), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic, with the columns of docs."""
    model = learn(docs, common.read(spark, sf_dir, "labels"), held_out=False)
    return docs.where(score_of(F.col("text"), model, spark) < THRESHOLD)
