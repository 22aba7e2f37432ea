"""Suffix-array dedup: removes every byte of a LENGTH-byte string that also starts anywhere else.

Every window of LENGTH bytes has a minimizer: of its GRAM-byte strings the first with the least hash. Equal
windows have equal minimizers at equal places, so a window can repeat only where its minimizer does. Each run
of windows with one minimizer is a segment. Segments whose minimizer occurs once are settled; equal segments
count as one, whose windows all repeat. What is left is dealt out by minimizer into shards, and each shard's
suffix array (by external induced sorting) tells the windows that share LENGTH bytes with a neighbour.

A minimizer of more than SHARD bytes of different segments is hot. Its segments are parted by the place of the
minimizer in the window, CONTEXT places at a time, and dealt out by the bytes that all windows of a part have in
common, so they spread over shards. What still meets in one shard is sorted in files, whatever its size.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common
from verbatlas.llm.suffix_array import SPILL, Scratch, blocks, suffix_array

LENGTH = 400
GRAM = 128
PIECE = 1 << 22  # windows looked at together
SHARD = 1_000_000  # bytes aimed at in a shard
CONTEXT = 64  # places of a hot minimizer in its window that go together
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    return common.kept("suffix_dedup", "powers", _make_powers)


def _make_powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + LENGTH + 1
    base = 0x100000001B3
    up = np.full(n, base, np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of gram bytes, by prefix sums of a polynomial."""
    up, down = _powers()
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: data.size - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * _MULT
    return h ^ (h >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row, from minima to both sides of fixed cuts."""
    n = v.size
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = v
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(minimizer hash, first byte, bytes) of the runs of windows with one minimizer, piece by piece."""
    for low in range(0, len(data) - length + 1, PIECE):
        piece = np.frombuffer(data, np.uint8)[low : low + PIECE + length - 1]
        h = gram_hashes(piece, gram)
        place = np.arange(h.size, dtype=np.uint64)
        least = _least((h & ~_LOW) | place, length - gram + 1) & _LOW  # 24 bits hold a place in a piece
        first = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
        count = np.diff(np.append(first, least.size))
        yield h[least[first].astype(np.int64)].view(np.int64), first + low, count + length - 1


def _segment_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            doc, key, start, size, digest = [], [], [], [], []
            for i, data in zip(batch.column("row_key").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if len(data) < length:
                    continue
                for h, first, n in segments(data, length):
                    key.append(h)
                    start.append(first)
                    size.append(n)
                    doc.append((i, h.size))
                    digest += [xxhash.xxh3_128_digest(data[a : a + m]) for a, m in zip(first.tolist(), n.tolist())]
            if not doc:
                continue
            docs = pa.array([i for i, n in doc], pa.string()).take(pa.array(np.repeat(np.arange(len(doc)), [n for _, n in doc])))
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.record_batch([docs, *(pa.array(x) for x in (np.concatenate(key), np.concatenate(start), np.concatenate(size), d[:, 0], d[:, 1]))], ["row_key", "key", "start", "size", "d1", "d2"])

    return run


def context_parts(segment: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, bytes]]:
    """(key, first window, bytes) of the parts of a segment; equal windows of any two segments are in parts of one key."""
    h = gram_hashes(np.frombuffer(segment, np.uint8), gram)[: length - gram + 1]
    m = int(np.argmin((h & ~_LOW) | np.arange(h.size, dtype=np.uint64)))  # where the minimizer is
    n = len(segment) - length + 1
    for c in range((m - n + 1) // CONTEXT, m // CONTEXT + 1):
        first, last = max(0, m - (c + 1) * CONTEXT + 1), min(n - 1, m - c * CONTEXT)
        shared = segment[m - c * CONTEXT : m - (c + 1) * CONTEXT + 1 + length]
        yield xxhash.xxh3_64_intdigest(shared, c) - 2**63, first, segment[first : last + length]


def _cut(length: int):
    names = ["key", "d1", "d2", "part", "shift", "segment"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in common.slices(batches, "text"):
            for data, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                for w in wanted:
                    segment = data[w["start"] : w["start"] + w["size"]]
                    parts = context_parts(segment, length) if w["hot"] else [(0, 0, segment)]
                    for key, first, part in parts:
                        rows.append((w["key"], w["d1"], w["d2"], key, first, part))
                        size += len(part)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return run


class Shard:
    """Segments of one shard as files of the task's scratch folder: their symbols, and four numbers for each."""

    def __init__(self, spill: int = SPILL):
        self.scratch = Scratch(spill)
        self.paths = [self.scratch.path("text"), self.scratch.path("segments")]
        self.text, self.rows = (open(p, "wb") for p in self.paths)

    def add(self, key: int, d1: int, d2: int, shift: int, segment: bytes) -> None:
        self.text.write((np.frombuffer(segment, np.uint8).astype(np.uint16) + np.uint16(2)).tobytes() + b"\1\0")
        self.rows.write(np.array([key, d1, d2, shift, len(segment)], np.int64).tobytes())

    def _read(self, path: str, kind) -> np.ndarray:
        small = os.path.getsize(path) <= self.scratch.spill * np.dtype(kind).itemsize
        return np.fromfile(path, kind) if small else np.memmap(path, kind, "r")

    def repeated(self, length: int) -> Iterator[tuple[tuple[int, int, int], bytes]]:
        """(key, d1, d2) and the repeated windows, as pairs of first and end, of every segment that has some."""
        self.text.write(b"\0\0")
        self.text.close()
        self.rows.close()
        text, rows = self._read(self.paths[0], np.uint16), self._read(self.paths[1], np.int64).reshape(-1, 5)
        order, lcp = suffix_array(text, length, self.scratch)
        hit = self.scratch.zeros(text.size, bool)
        for b, e in blocks(text.size):
            deep = b + np.flatnonzero(lcp[b:e] >= length)
            hit[order[deep]] = True
            hit[order[deep - 1]] = True
        at = 0
        for key, d1, d2, shift, size in (r.tolist() for r in rows):
            n = size - length + 1
            edge = np.flatnonzero(np.diff(np.asarray(hit[at : at + n]).astype(np.int8), prepend=0, append=0))
            if edge.size:
                yield (key, d1, d2), (edge + shift).astype("<i4").tobytes()
            at += size + 1

    def close(self) -> None:
        self.text.close()
        self.rows.close()
        self.scratch.__exit__()


def _match(length: int, spill: int):
    """Rows come sorted by shard; (key, d1, d2, runs): the repeated windows of each segment as pairs of first and end."""

    def batches_of(found) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for names, runs in found:
            held.append((*names, runs))
            if len(held) == 20_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["key", "d1", "d2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        try:
            for batch in common.slices(batches, "segment"):
                for n, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "d1", "d2", "shift", "segment"))):
                    if n != number:
                        if shard:
                            yield from batches_of(shard.repeated(length))
                            shard.close()
                        number, shard = n, Shard(spill)
                    shard.add(*row)
            if shard:
                yield from batches_of(shard.repeated(length))
        finally:
            if shard:
                shard.close()

    return run


def union(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans, apart from each other, in order, from any (first, end) pairs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            out, kept_texts = [], []
            for data, starts, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("runs").to_pylist()):
                spans = []
                for s, r in zip(starts or [], runs or []):
                    windows = np.frombuffer(r, "<i4").astype(np.int64).reshape(-1, 2) + s
                    windows[:, 1] += length - 1
                    spans.append(windows)
                gone = union(np.concatenate(spans)) if spans else np.empty((0, 2), np.int64)
                edges = [0, *gone.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
                kept_texts.append(kept)
            n, removed, count, sha = zip(*out)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            yield pa.record_batch(cols + [pa.array(kept_texts, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, shard: int = SHARD, spill: int = SPILL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with_text also kept, the bytes left.

    shard: bytes aimed at in a shard; spill: symbols that a task holds in memory, the rest is in its files.

    Texts are UTF-8; null ones are empty. Matches never cross documents and are judged on the input. Rows
    that repeat are documents of their own and match each other; null ids are ids. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.id_and_text(docs)
    # rows of one id and text have the same spans, so they may share a key
    keyed = rows.withColumn("row_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text"))))
    found = common.stored(keyed.select("row_key", "text").mapInArrow(_segment_rows(length), "row_key string, key bigint, start bigint, size bigint, d1 bigint, d2 bigint"), "segments")
    shared = found.groupBy("key").agg(F.count("*").alias("n"), F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("several"))
    shared = common.stored(shared, "shared-keys")  # joined from a table, a hot key's rows can be split
    met = common.stored(found.join(shared, "key"), "met")
    distinct = met.groupBy("key", "d1", "d2").agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "start", "size")).alias("at"), F.first("several").alias("several"))
    distinct = common.stored(distinct, "distinct-segments")

    whole = distinct.where("copies > 1").select("key", "d1", "d2", F.expr("cast(null as binary)").alias("runs"), F.lit(True).alias("whole"))
    open_ = distinct.where("several")
    by_key = common.stored(open_.groupBy("key").agg(F.sum("at.size").alias("bytes")), "open-keys")
    total, hot_bytes = by_key.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bytes") > shard, F.col("bytes"))), F.lit(0))).first()
    grown = 1 + length // CONTEXT  # times the bytes, at most, of what is parted
    shards = max(1, -(-(total + grown * hot_bytes) // shard))
    hot = by_key.select("key", (F.col("bytes") > shard).alias("hot"))
    wanted = open_.join(hot, "key").groupBy("at.row_key").agg(F.collect_list(F.struct("key", "d1", "d2", "at.start", "at.size", "hot")).alias("wanted"))
    texts = keyed.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"]).select("text", "wanted").mapInArrow(_cut(length), "key bigint, d1 bigint, d2 bigint, part bigint, shift bigint, segment binary")
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards))).repartition(max(common.n_partitions(spark), min(shards, 10_000)), "shard").sortWithinPartitions("shard")
    some = common.stored(dealt.mapInArrow(_match(length, spill), "key bigint, d1 bigint, d2 bigint, runs binary"), "matches")
    partial = some.join(distinct.where("copies = 1").select("key", "d1", "d2"), ["key", "d1", "d2"], "left_semi").withColumn("whole", F.lit(False))
    marks = whole.unionByName(partial)
    windows = met.join(marks, ["key", "d1", "d2"]).select("row_key", "start", F.when(F.col("whole"), _le_pair(F.col("size") - length + 1)).otherwise(F.col("runs")).alias("runs"))
    spans = windows.groupBy("row_key").agg(F.collect_list(F.struct("start", "runs")).alias("s")).select("row_key", F.col("s.start").alias("starts"), F.col("s.runs").alias("runs"))
    out = keyed.join(spans, "row_key", "left").select("doc_id", "text", "starts", "runs")
    return out.mapInArrow(_removed(length, with_text), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)


def _le_pair(n):
    """0 and n as little-endian 32-bit integers."""
    big = F.lpad(F.hex(n), 8, "0")
    little = F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1)))
    return F.unhex(F.concat(F.lit("00000000"), little))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents"))
