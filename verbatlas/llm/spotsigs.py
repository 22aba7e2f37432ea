"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A signature is the hash of an anchor and the next CHAIN content words behind it; content words far behind any
anchor start chains of their own. A fingerprint is the set of a text's signatures. Sets are compared by Jaccard; where a threshold is given, sizes alone rule pairs out
first. spotsigs_links() joins near-equal documents: sets are dealt out by their length and their rarest
signatures, so only sets of like lengths meet.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common
from verbatlas.llm.neighbours import with_next

CHAIN = 3
SPARSE = 20  # content words behind an anchor, beyond which each starts a chain itself
# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """
a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their
they this to was we were which will with you
aber als am auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht
oder sich sie sind so um und von war wie zu zum
au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous on ou par pas pour plus qui que sa
se ses son sont sur un une vous
al como con del el ella ese esta este fue hay las lo los más mi no para pero por se ser si sin su sus una uno y
""".split()
)
_PUNCTUATION = re.compile(r"[\W_]+")


class Words(common.WordCache):
    """From a raw word to its number: 0 nothing left of it, odd an anchor, even a content word."""

    def look(self, raw: str) -> int:
        word = _PUNCTUATION.sub("", raw.lower())
        return (xxhash.xxh64_intdigest(word) >> 2 << 1) + (word in ANCHORS) if word else 0


def shared_words() -> Words:
    return common.kept("spotsigs", "words", Words)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def values(raw: list[str], words: Words) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)).astype(np.uint64)


def signature_sets(texts: list[str], parsed: list[np.ndarray], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text; parsed: the values of its words.

    Every anchor starts a chain, and so does every content word with no anchor among the SPARSE content words
    before it or in the text so far. What starts a chain is settled by the words before it alone, so equal
    passages of two texts share their signatures whatever the rest holds. Without a content word the text
    itself is the one signature. Chains at the end of a text are shorter. The empty text has none.
    """
    n = len(texts)
    value = np.concatenate(parsed) if parsed else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [p.size for p in parsed])
    owner, value = owner[value != 0], value[value != 0]
    anchor = (value & np.uint64(1)).astype(bool)
    content, of = value[~anchor], owner[~anchor]
    ends = np.cumsum(np.bincount(of, minlength=n))
    following = np.cumsum(~anchor)[anchor]  # content words before an anchor: the place of the one behind it
    inside = following < ends[owner[anchor]]
    first, start, doc = following[inside], value[anchor][inside], owner[anchor][inside]
    place, begins = np.arange(content.size), np.concatenate([[0], ends[:-1]])[of] if n else ends
    behind = np.full(content.size, -1)
    behind[first] = first
    behind = np.maximum.accumulate(behind)  # the place behind the last anchor, less than begins if there is none
    rest = np.flatnonzero((behind < begins) | (place - behind >= SPARSE))
    first, doc = np.concatenate([first, rest]), np.concatenate([doc, of[rest]])
    h = _mix(np.concatenate([start, np.zeros(rest.size, np.uint64)]) + np.uint64(1))
    padded, end = np.concatenate([content, np.zeros(chain, np.uint64)]), ends[doc]
    for k in range(chain):
        h = _mix(h * np.uint64(0x100000001B3) ^ np.where(first + k < end, padded[first + k], np.uint64(0)))
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    cuts = np.searchsorted(both >> np.uint64(32), np.arange(n + 1).astype(np.uint64))
    low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sets = [low[cuts[k] : cuts[k + 1]] for k in range(n)]
    return [np.array([xxhash.xxh32_intdigest(t.encode())], np.uint32) if t and not s.size else s for t, s in zip(texts, sets)]


def signatures(text: str, words: Words, chain: int = CHAIN) -> np.ndarray:
    return signature_sets([text], [values(text.split(), words)], chain)[0]


def to_text(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted sets, two empty ones being equal; 0 without a look at them if sizes rule out the least."""
    if not a.size and not b.size:
        return 1.0
    if min(a.size, b.size) < least * max(a.size, b.size):
        return 0.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next document's first (or all it has)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _edited_values(text: str, parsed: np.ndarray, following: str, next_parsed: np.ndarray, words: Words) -> np.ndarray:
    """values() of the edited text: known words are taken over, those at the seam and at the end looked up."""
    n = len(text) // 3
    left, right = text[: len(text) - n].split(), following[:n].split()
    seam, last = left[-1:], right[-1:]
    if left and right and not text[len(text) - n - 1].isspace() and not following[0].isspace():
        seam, right_from = [left[-1] + right[0]], 1
    else:
        right_from = 0
    if len(right) <= right_from:
        last = []
    middle = next_parsed[right_from : len(right) - 1] if last else next_parsed[:0]
    return np.concatenate([parsed[: max(0, len(left) - 1)], values(seam, words), middle, values(last, words)])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures bigint"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _rows(held: list[tuple], words: Words) -> pa.RecordBatch:
    """Of the documents in held, each but the last of its bucket followed by its successor."""
    texts = [h[3] for h in held]
    parsed = [values(t.split(), words) for t in texts]
    pairs = [k for k in range(len(held) - 1) if held[k][0] == held[k + 1][0]]
    others = [edited(texts[k], texts[k + 1]) for k in pairs]
    sets = signature_sets(texts + others, parsed + [_edited_values(texts[k], parsed[k], texts[k + 1], parsed[k + 1], words) for k in pairs])
    out = []
    for k, other, e in zip(pairs, others, sets[len(texts) :]):
        s = sets[k]
        out.append((held[k][2], len(texts[k]), hashlib.sha256(other.encode()).hexdigest(), to_text(s), to_text(e), jaccard(s, e), jaccard(s, sets[k + 1]), s.size))
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)], NAMES)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in order, each bucket's successor last and borrowed."""
    words, held, size = shared_words(), [], 0
    for batch in common.slices(batches, "text"):
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "borrowed", "doc_id", "text"))):
            if held and held[-1][0] == row[0] and held[-1][1]:
                continue  # equal ids: the bucket's successor has been met
            held.append(row)
            size += len(row[3])
            if size > 2 << 20:
                yield _rows(held, words)
                held, size = held[-1:], 0
    if held:
        yield _rows(held, words)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, with their likeness.

    The next document is that of the next lower doc_id, after the lowest the highest; rows of equal ids
    follow by text, null ids come last. Null texts are empty; an empty table gives an empty result; one
    document alone follows itself; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    return with_next(common.id_and_text(docs)).mapInArrow(_report, SCHEMA)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = shared_words()
    for batch in common.slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        sets = signature_sets(texts, [values(t.split(), words) for t in texts])
        yield pa.record_batch([batch.column("doc_id"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "sigs"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sigs): the signature set of every text, empty for empty texts."""
    common.ship(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(_fingerprints, "doc_id bigint, sigs array<bigint>")


def length_class(size, least: float):
    """Sets of a Jaccard of at least that much lie in the same class of lengths or in adjacent ones."""
    return F.floor(F.log(size.cast("double")) / -float(np.log(least))).cast("int")


def spotsigs_links(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): links between different signature sets, a and b their least doc_ids.

    Equal sets are one node. A set is dealt out under its rarest signatures, as many as any partner must
    share one of, and its class of lengths; each pair is compared once, at its first shared key. Texts
    without signatures and rows without an id have no link.
    """
    sets = common.stored(fingerprints(docs).where("size(sigs) > 0 and doc_id is not null").groupBy("sigs").agg(F.min("doc_id").alias("node")), "spotsigs")
    counts = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    tokens = sets.select("node", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")).join(counts, "sig")
    ranked = tokens.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("rare"))
    prefix = ranked.select("node", "size", F.expr(f"slice(transform(rare, x -> x.sig), 1, size - cast(ceil({least} * size - 1e-9) as int) + 1)").alias("prefix"))
    left = prefix.select("node", "size", F.explode("prefix").alias("sig")).withColumn("class", length_class(F.col("size"), least))
    right = left.select(F.col("node").alias("b"), F.col("size").alias("size_b"), "sig", F.explode(F.array(F.col("class"), F.col("class") - 1, F.col("class") + 1)).alias("class"))
    near = left.select(F.col("node").alias("a"), F.col("size").alias("size_a"), "sig", "class").join(right, ["sig", "class"]).where(f"a < b and least(size_a, size_b) >= {least} * greatest(size_a, size_b)").select("a", "b").distinct()
    a, b = sets.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("node").alias("b"), F.col("sigs").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    likeness = shared / (F.size("sa") + F.size("sb") - shared)
    return near.join(a, "a").join(b, "b").select("a", "b", likeness.alias("likeness")).where(F.col("likeness") >= least)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(common.read(spark, sf_dir, "documents"))
