"""Token ids as canonical length-limited Huffman codes in independent blocks with bit-offset checkpoints.

The file format is a table of blocks, written by Spark's Parquet writer so that any store and any commit
protocol works. A block holds whole documents in order: their ids, their token counts, one bit string, and
the bit offset of every STEP-th token. A block can be read alone, and all its checkpointed runs decode side
by side, one table lookup a token. Code lengths come from global counts; the code book (id, length) is a
second table beside the blocks, and its canonical codes follow from it. Both are all that reading takes:
open() does it from the path alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm import common

LIMIT = 18  # bits of the longest code
STEP = 256  # tokens between checkpoints
CHUNK = 1 << 15  # tokens encoded at once, a multiple of STEP
BLOCK = 1 << 20  # tokens of a block, more if one document has more
END = 1

# --- tokens ---

#: A text of these characters alone is cut at its plain white space and put in lower case before the
#: tokenizer sees its words, which then equals encoding it whole: NFC changes nothing, lower case works
#: letter by letter, and no token spans white space.
_PLAIN = re.compile(r"[^\t\n\r -~¡-Ĭı-ɏ]")
#: Of words, one a line: letters in front (a group of their own for the tokenizer) and what follows, or a word
#: that is encoded whole. Quotes can join letters, < can begin a special token, and ² is in no simple class.
_PARTS = re.compile(r"^(?:([^\W\d_²³¹¼½¾]+)([^'<²³¹¼½¾\n]*)|(.+))$", re.M)
NARROW = 1 << 16  # ids below it take two bytes


class Encoder:
    """Texts to ids, by the tokenizers library.

    Where the vocabulary allows it (by_word), plain texts are cut into words by Arrow, each different word of a
    batch is looked up once, and all words' ids are gathered from one pool. Words met for the first time are
    encoded together, many to a call, and told apart by the ids that end a word.
    """

    MOST = 800_000  # words kept; beyond it those met in one batch only go. It only spares work
    LONGEST = 60  # characters of a word that is kept

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            made = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        normal, cut = json.dumps(made.get("normalizer") or {}), json.dumps(made.get("pre_tokenizer") or {})
        suffix = made["model"].get("end_of_word_suffix")
        self.by_word = made["model"].get("type") == "BPE" and bool(suffix) and all(x in normal for x in ('"Lowercase"', '"NFC"', "\\\\s+")) and "\\\\s" in cut
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        if self.by_word:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._anew()

    def _anew(self) -> None:
        self.known: dict[str, int] = {"": 0}  # the place of a word in start and size
        self.pool, self.used = np.zeros(1 << 20, "<u4"), 0
        self.start, self.size, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: those of all words in sequence."""
        at = len(self.known)
        while self.used + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while at + len(words) > self.start.size:
            self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
        self.pool[self.used : self.used + ids.size] = ids
        ends = self.used + np.cumsum(sizes)
        self.start[at : at + len(words)], self.size[at : at + len(words)] = ends - sizes, sizes
        self.met[at : at + len(words)] = 0
        self.known.update(zip(words, range(at, at + len(words))))
        self.used += ids.size

    def _keep_rows(self, words: list[str], rows: list[np.ndarray]) -> None:
        if words:
            self._keep(words, np.concatenate(rows), np.array([r.size for r in rows], np.int64))

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at those places in sequence, and where each one's end."""
        size = self.size[place]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.start[place] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)], ends

    def _thin(self) -> None:
        """Lets words go that few batches have held, more than half of the room at least."""
        met = self.met[: len(self.known)]
        least = 2
        while (met >= least).sum() > self.MOST // 2:
            least *= 2
        words = [w for w, k in zip(self.known, (met >= least).tolist()) if k and w]
        place = np.array([self.known[w] for w in words], np.int64)
        ids, ends = self._gather(place)
        met = met[place]
        self._anew()
        self._keep(words, ids, np.diff(ends, prepend=0))
        self.met[1 : len(words) + 1] = met

    def _learn(self, words: list[str]) -> None:
        parts = _PARTS.findall("\n".join(words))
        letters = list({h for h, _, _ in parts} - self.known.keys())
        for at in range(0, len(letters), 4000):
            part = letters[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if last.size == len(part):
                self._keep(part, ids, np.diff(last, prepend=0))
            else:
                self._keep_rows(part, [self.whole(w) for w in part])
        odd = [o for _, _, o in parts if o]
        self._keep_rows(odd, [self.whole(w) for w in odd])
        tails = list({t for _, t, _ in parts} - {""})
        tails = [t for t in tails if "\n" + t not in self.known]  # no word begins with a line end
        self._keep_rows(["\n" + t for t in tails], [self.whole(t) for t in tails])
        split = [(w, h, "\n" + t) for w, (h, t, _) in zip(words, parts) if t]
        ids, ends = self._gather(np.array([self.known[x] for _, *both in split for x in both], np.int64))
        self._keep([w for w, _, _ in split], ids, np.diff(ends[1::2], prepend=0))

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts in sequence, and how many each has."""
        rows = pc.ascii_split_whitespace(pc.utf8_lower(texts))  # plain texts have no other white space
        counts = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
        coded = rows.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(found) if x is None] if None in found else []
        if missing:
            if len(self.known) + len(missing) > self.MOST:
                self._thin()
                found = list(map(self.known.get, words))  # what is at hand must be known together
                missing = [k for k, x in enumerate(found) if x is None]
            self._learn([words[k] for k in missing if len(words[k]) <= self.LONGEST])
            used, long = self.used, [words[k] for k in missing if len(words[k]) > self.LONGEST]
            self._keep_rows(long, [self.whole(w) for w in long])
            for k in missing:
                found[k] = self.known[words[k]]
            for w in long:  # their ids stay in the pool until the next words come
                del self.known[w]
            self.used = used
        place = np.array(found, np.int64)
        self.met[place] += 1
        place = place[coded.indices.to_numpy()]
        ids, ends = self._gather(place)
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) in sequence, and how many each has."""
        plain = np.zeros(len(texts), bool)
        if self.by_word:
            strange = pc.match_substring_regex(texts, _PLAIN.pattern)
            for special in self.special:
                strange = pc.or_(strange, pc.match_substring(texts, special))
            plain = ~strange.to_numpy(zero_copy_only=False)
        if plain.all():
            return self._by_word(texts)
        found, counts = self._by_word(texts.filter(pa.array(plain)))
        rows = iter(np.split(found, np.cumsum(counts)[:-1]) if counts.size else [])
        rows = [next(rows) if p else self.whole(t) for t, p in zip(texts.to_pylist(), plain)]
        return np.concatenate(rows), np.array([r.size for r in rows], np.int64)


def encoder(path: str) -> Encoder:
    return common.kept("huffman", path, lambda: Encoder(path))


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value for each document: two bytes an id, or four behind one byte (an odd number of bytes)."""
    ends = np.cumsum(counts)
    if not ids.size or ids.max() < NARROW:
        if 2 * ids.size < 1 << 31:
            offsets = np.append(0, 2 * ends).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
        return pa.array([ids[e - n : e].astype("<u2").tobytes() for e, n in zip(ends, counts)], pa.binary())
    rows = (ids[e - n : e] for e, n in zip(ends, counts))
    return pa.array([r.astype("<u2").tobytes() if r.size and r.max() < NARROW else b"\0" + r.astype("<u4").tobytes() for r in rows], pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of packed() values: all ids in sequence (uint32), and how many each has."""
    column = column if column.offset == 0 else pa.concat_arrays([column])
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if not (size % 2).any():
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        begin = int(np.frombuffer(column.buffers()[1], np.int32, 1)[0]) if len(column) else 0
        return data[begin : begin + int(size.sum())].view("<u2").astype(np.uint32), size // 2
    rows = [np.frombuffer(x, "<u4", offset=1) if len(x) % 2 else np.frombuffer(x, "<u2").astype(np.uint32) for x in column.to_pylist()]
    return np.concatenate(rows).astype(np.uint32), np.array([r.size for r in rows], np.int64)


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in common.slices(batches, "text", 8 << 20):
            ids, counts = encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end)
            yield pa.record_batch([batch.column("doc_id"), packed(ids, counts + 1)], ["doc_id", "ids"])

    return run


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, ids): of every whole text, end behind it. Null texts are empty and hold the end alone."""
    common.ship(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(_tokenize(path, end), "doc_id bigint, ids binary")


# --- code book ---


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(counts.size, np.int64)
    if used.size <= 1:
        lengths[used] = 1
        return lengths
    if used.size > 1 << limit:
        raise ValueError(f"{used.size} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    leaf, levels = np.ones(used.size, bool), []
    value = weight
    for _ in range(limit):
        levels.append(leaf)
        pairs = value[: value.size // 2 * 2].reshape(-1, 2).sum(1)
        value = np.concatenate([weight, pairs])
        order = np.argsort(value, kind="stable")
        value, leaf = value[order], order < used.size
    take = 2 * used.size - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[used[:leaves]] += 1
        take = 2 * (min(take, leaf.size) - leaves)
    return lengths


class Code:
    """The canonical code of given lengths: codes by (length, id), and one table from the next limit bits."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        order = np.lexsort((np.arange(lengths.size), self.lengths))
        order = order[self.lengths[order] > 0]
        sizes = self.lengths[order]
        self.limit = int(sizes[-1]) if order.size else 1
        steps = np.left_shift(np.int64(1), self.limit - sizes)
        ends = np.cumsum(steps)
        self.codes = np.zeros(lengths.size, np.int64)
        self.codes[order] = (ends - steps) >> (self.limit - sizes)
        self.table = np.zeros(1 << self.limit, np.uint32)
        if order.size:
            if int(order.max()) >= 1 << 26:
                raise ValueError("an id of more than 26 bits")
            self.table[: ends[-1]] = np.repeat((order << 6 | sizes).astype(np.uint32), steps)
        self.short = self.lengths.astype(np.uint8)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string (padded to whole bytes) and the bit offset of every STEP-th id."""
        sizes = self.short[ids]
        if ids.size and not sizes.all():
            raise ValueError("an id is not in the code book")
        total = int(sizes.sum(dtype=np.int64))
        words = np.zeros(total // 32 + 2, np.uint64)
        points, base = [np.empty(0, np.int64)], 0
        for b in range(0, ids.size, CHUNK):  # what is at work stays in the processor's cache
            size = sizes[b : b + CHUNK].astype(np.int64)
            start = base + np.cumsum(size) - size
            base = int(start[-1] + size[-1])
            value = self.codes[ids[b : b + CHUNK]].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
            at = start >> 5
            first = np.flatnonzero(np.diff(at, prepend=-1))
            joined = np.bitwise_or.reduceat(value, first)
            words[at[first]] |= joined >> np.uint64(32)
            words[at[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
            points.append(start[::STEP])
        return words.astype(">u4").tobytes()[: (total + 7) // 8], np.concatenate(points)

    def decode(self, data: bytes, checkpoints: np.ndarray, count: int) -> np.ndarray:
        """count ids; the runs behind all checkpoints are read in step."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.zeros((STEP, checkpoints.size), np.uint32)
        at, last = checkpoints.astype(np.int64), window.size - 1
        mask, down = np.uint32((1 << self.limit) - 1), 32 - self.limit
        for k in range(min(STEP, count)):
            found = self.table[(window[np.minimum(at >> 3, last)] >> (down - (at & 7)).astype(np.uint32)) & mask]
            out[k] = found >> np.uint32(6)
            at += found & np.uint32(63)
        return out.T.reshape(-1)[:count]


# --- files ---

BLOCKS = "part int, block long, start_in_part long, n_tokens long, doc_ids binary, sizes binary, checkpoints binary, bits binary, no_id binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        n = np.bincount(unpacked(batch.column("ids"))[0])
        if n.size > total.size:
            total = np.concatenate([total, np.zeros(n.size - total.size, np.int64)])
        total[: n.size] += n
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def global_counts(tokens: DataFrame) -> np.ndarray:
    """Of every id over all documents, by id; as long as the vocabulary, never as the corpus."""
    rows = tokens.select("ids").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = rows["id"].to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if ids.size else 1, np.int64)
    counts[ids] = rows["n"].to_numpy()
    return counts


def _block(code: Code, place: list[int], ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
    bits, points = code.encode(ids)
    row = [*place, ids.size, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), points.astype("<u4").tobytes(), bits, np.packbits(none).tobytes()]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])


def _encode(lengths_sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(lengths_sent.value), TaskContext.get().partitionId()
        held, size, block, start = [], 0, 0, 0
        for batch in common.slices(batches, "ids"):
            ids, counts = unpacked(batch.column("ids"))
            column = batch.column("doc_id")
            held.append((ids, counts, column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)))
            size += ids.size
            if size >= BLOCK:
                yield _block(code, [part, block, start], *map(np.concatenate, zip(*held)))
                held, size, block, start = [], 0, block + 1, start + size
        if held:
            yield _block(code, [part, block, start], *map(np.concatenate, zip(*held)))

    return run


class TokenFile:
    """Encoded documents at a path: blocks (part and block in ascending doc_id order) and the code book."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    def lengths(self) -> np.ndarray:
        """Code lengths by id, from the stored book; as many as the vocabulary has ids at most."""
        book = self.spark.read.schema("id long, length int").parquet(f"{self.path}/book").toArrow()
        ids = book["id"].to_numpy()
        out = np.zeros(int(ids.max()) + 1 if ids.size else 1, np.int64)
        out[ids] = book["length"].to_numpy()
        return out

    def documents(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (and ids, four bytes each) of every document, read from the files."""
        spark, blocks = self.spark, self.blocks
        common.ship(spark)
        sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each part
        base, total = {}, 0
        for part in sorted(sums):
            base[part], total = total, total + sums[part]
        sent = spark.sparkContext.broadcast((base, self.lengths()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, code = sent.value[0], Code(sent.value[1])
            for batch in batches:
                for row in batch.to_pylist():
                    ids = code.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u4"), row["n_tokens"]).astype("<u4")
                    sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                    ends = np.cumsum(sizes)
                    parts = [ids[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                    none = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=sizes.size).astype(bool)
                    cols = [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=none), pa.array(base[row["part"]] + row["start_in_part"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    yield pa.record_batch(cols + [pa.array(parts, pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

        return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def open_file(spark: SparkSession, path: str) -> TokenFile:
    """What write() has left at a path; nothing else is needed to read it."""
    return TokenFile(spark, path)


def write(tokens: DataFrame, limit: int = LIMIT, path: str | None = None) -> TokenFile:
    """Writes the ids of (doc_id, ids) in ascending doc_id order (null ids first, equal ids by content).

    Without a path a new one in the shared folder is taken. tokens is read more than once, so it should be a
    stored table. Empty tables give a file without blocks.
    """
    spark = tokens.sparkSession
    common.ship(spark)
    path = path or common.new_path(spark, "token-file")
    lengths = code_lengths(global_counts(tokens), limit)
    sent = spark.sparkContext.broadcast(lengths)  # as long as the vocabulary
    dealt = tokens.repartitionByRange(common.n_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int")
    book.coalesce(1).write.parquet(f"{path}/book")
    dealt.mapInArrow(_encode(sent), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return open_file(spark, path)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    tokens = common.stored(tokenize(docs, public_tokenizers.path("word_bpe_49k.json")), "token-ids")
    return open_file(spark, write(tokens).path).documents()
