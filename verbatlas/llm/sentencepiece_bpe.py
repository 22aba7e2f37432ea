"""SentencePiece encoding and decoding of BPE models, by suffix-array matching and relaxation.

Texts are cut at their spaces (pieces hold the mark of a space only in front) and a batch's unknown words are
joined to one text. Its suffixes are sorted as deep as the longest piece, every piece of the vocabulary is
binary-searched for its range of occurrences, and the occurrences are edges from start to end. Edges are
sorted by end and relaxed, all words side by side: the last piece of a prefix's encoding is the longest edge
whose start is the word's, or whose piece is compatible with the last piece of the encoding up to its start.
Two pieces are compatible if merging them never takes place before both are made; an encoding by merges is
the one row of pieces whose neighbours all are, so ids equal those of merging by score.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common

MARK = "▁"
WINDOW = 1 << 18  # characters of one index
LATE = np.int64(1) << 40


def _table(rows: list[list[int]]) -> np.ndarray:
    """Rows of one width, filled up with -1."""
    width = max(map(len, rows))
    return np.array([r + [-1] * (width - len(r)) for r in rows])


class Vocabulary:
    """Pieces of a SentencePiece BPE model whose normalization is the identity, read by the library."""

    MOST, MOST_BYTES = 600_000, 40 << 20  # words kept, and their characters and ids; then it starts anew, it only spares work

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = np.full(256, -1, np.int64)
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        normal = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif model.is_control(i):
                self.raw[i] = b""
            elif model.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()
            elif not model.is_unused(i):
                normal.append(i)
        self.runs = {len(self.pieces[i]): i for i in normal if not self.pieces[i].strip(MARK)}
        normal = [i for i in normal if self.pieces[i].strip(MARK) or len(self.pieces[i]) == 1]
        if any(MARK in self.pieces[i][1:] for i in normal):
            raise ValueError("a piece holds a space behind its first character")
        self.ids = np.array(normal, np.int64)
        text = [self.pieces[i] for i in normal]
        self.code = {c: k + 1 for k, c in enumerate(sorted(set("".join(text))))}
        if len(self.code) > 65_000:
            raise ValueError("too many characters for two-byte codes")
        self.depth = max(map(len, text))
        self.size = np.array([len(t) for t in text])
        keys = [b"".join(self.code[c].to_bytes(2, "big") for c in t) for t in text]
        self.low = np.array([k.ljust(2 * self.depth, b"\0") for k in keys], f"S{2 * self.depth}")
        self.high = np.array([k.ljust(2 * self.depth, b"\xff") for k in keys], f"S{2 * self.depth}")
        self._merges(text, [model.get_score(i) for i in normal])
        self.strange = re.compile("([^" + re.escape("".join(self.code)) + "])")
        self.lookup = np.zeros(0x110000, ">u2")
        self.lookup[[ord(c) for c in self.code]] = list(self.code.values())
        self.mark, self.line_end = self._ids_of([MARK, "\n"])
        self.known: dict[str, bytes] = {}  # words behind a space
        self.at_line: dict[str, bytes] = {}  # words at the start of a line
        self.held = 0

    def _merges(self, text: list[str], score: list[float]) -> None:
        """Ranks, all pairs that merge, and of each piece the pieces at its left and right edge while it grows."""
        number = {t: k for k, t in enumerate(text)}
        order = sorted((k for k in range(len(text)) if len(text[k]) > 1), key=lambda k: -score[k])
        self.rank = np.full(len(text), -1, np.int64)
        self.rank[order] = np.arange(len(order))
        pair, made = [], []
        for k in order:
            for cut in range(1, len(text[k])):
                a, b = number.get(text[k][:cut]), number.get(text[k][cut:])
                if a is not None and b is not None:
                    pair.append(a << 20 | b)
                    made.append(k)
        by = np.argsort(pair) if pair else np.empty(0, np.int64)
        self.pair, self.made = np.array(pair, np.int64)[by], np.array(made, np.int64)[by]
        merge = dict(zip(pair, made))
        left, right = {}, {}
        for k in order:
            row = [number[c] for c in text[k]]
            while len(row) > 1:
                found = [(self.rank[m], i, m) for i in range(len(row) - 1) if (m := merge.get(row[i] << 20 | row[i + 1])) is not None]
                if not found:
                    break
                _, i, m = min(found)
                if len(row) == 2:
                    left[k], right[k] = row
                row[i : i + 2] = [m]
            if row != [k]:
                self.rank[k] = LATE  # never made by merges
        deep = lambda k, side: [k] if k not in side else [k, *deep(side[k], side)]
        self.lefts, self.rights = (_table([deep(k, side) for k in range(len(text))]) for side in (left, right))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: does none of the pieces at the right edge of a merge with one at b's left edge?"""
        out = np.ones(a.size, bool)
        for i in range(self.rights.shape[1]):
            x = self.rights[a, i]
            if not (x >= 0).any():
                break
            x_until = self.rank[self.rights[a, i - 1]] if i else np.full(a.size, LATE)
            for j in range(self.lefts.shape[1]):
                live = np.flatnonzero(out & (x >= 0) & (self.lefts[b, j] >= 0))
                if not live.size:
                    break
                u, v = x[live], self.lefts[b[live], j]
                v_until = self.rank[self.lefts[b[live], j - 1]] if j else np.full(live.size, LATE)
                at = np.minimum(np.searchsorted(self.pair, u << 20 | v), self.pair.size - 1)
                merges = self.pair[at] == (u << 20 | v)
                rank = self.rank[self.made[at]]
                from_ = np.maximum(self.rank[u], self.rank[v])
                early = merges & (rank < x_until[live]) & (rank <= v_until) & (from_ < x_until[live]) & (from_ < v_until)
                out[live[early]] = False
        return out

    def _edges(self, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence that ends in (low, high], from the sorted suffixes near there."""
        first = max(0, low - self.depth)
        suffixes = np.lib.stride_tricks.sliding_window_view(text[first : high + self.depth], self.depth)[: high - first]
        keys = np.ascontiguousarray(suffixes).view(f"S{2 * self.depth}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begin, count = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count -= begin
        piece = np.repeat(np.arange(count.size), count)
        start = first + order[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(piece.size)]
        end = start + self.size[piece]
        mine = (end > low) & (end <= high) & (self.rank[piece] < LATE)
        return start[mine], end[mine], piece[mine]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (places in self.ids) of the pieces of words whose characters are all known, and how many each has.

        Edges are made and relaxed for WINDOW ends at a time, so a text of one endless word needs no more memory
        than its own characters and the last piece up to each.
        """
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size + 1)
        starts = ends - size - 1
        text = np.zeros(int(ends[-1]) + self.depth, ">u2")
        text[: ends[-1] - 1] = self.lookup[np.frombuffer("\0".join(words).encode("utf-32-le"), "<u4")]
        last = np.full(text.size + 1, -1, np.int32)
        for low in range(0, int(ends[-1]), WINDOW):
            start, end, piece = self._edges(text, low, min(low + WINDOW, int(ends[-1])))
            word = np.searchsorted(ends, start, "right")
            # by place of the end within its word: what is relaxed together stands together
            step = end - starts[word]
            by = np.argsort(step.astype(np.uint16) if step.size and step.max() < 1 << 16 else step, kind="stable")
            start, end, piece, word, step = start[by], end[by], piece[by], word[by], step[by]
            cuts = np.append(np.flatnonzero(np.diff(step, prepend=-1)), step.size)
            for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                self._relax(last, start[b:e], end[b:e], piece[b:e], starts[word[b:e]])
        return self._read_back(last, starts, size)

    def _relax(self, last: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, word_start: np.ndarray) -> None:
        """Settles the last piece of each end, from all edges of like place in their words."""
        length = end - start
        for n in range(int(length.max()) if length.size else 0, 0, -1):
            mine = np.flatnonzero((length == n) & (last[end] < 0))
            if not mine.size:
                continue
            good = start[mine] == word_start[mine]
            rest = np.flatnonzero(~good & (last[start[mine]] >= 0))
            if rest.size:
                pairs, back = np.unique(last[start[mine[rest]]].astype(np.int64) << 20 | piece[mine[rest]], return_inverse=True)
                good[rest] = self.compatible(pairs >> 20, pairs & ((1 << 20) - 1))[back]
            done = mine[good]
            last[end[done]] = piece[done]

    def _read_back(self, last: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = starts + size
        live = np.flatnonzero(size > 0)
        owners, chosen = [], []
        while live.size > 1000:  # many words: a piece of each at a time
            p = last[at[live]]
            owners.append(live)
            chosen.append(p)
            at[live] -= self.size[p]
            live = live[at[live] > starts[live]]
        for k in live.tolist():  # few long ones: word by word
            row, i, first = [], int(at[k]), int(starts[k])
            while i > first:
                row.append(last[i])
                i -= int(self.size[row[-1]])
            owners.append(np.full(len(row), k))
            chosen.append(np.array(row, last.dtype))
        if not chosen:
            return np.empty(0, last.dtype), np.zeros(size.size, np.int64)
        owner, p = np.concatenate(owners)[::-1], np.concatenate(chosen)[::-1]
        return p[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=size.size)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words (with no mark but in front) as bytes; what lies between unknown characters is encoded apart."""
        whole, odd = [], {}
        known = self.code.keys()
        for k, w in enumerate(words):
            if known >= set(w):
                whole.append(w)
            else:
                odd[k] = [x for x in re.split(self.strange, w) if x]
                whole += [x for x in odd[k] if x[0] in self.code]
        found = iter(self._pieces(whole))
        out = []
        for k in range(len(words)):
            out.append(next(found) if k not in odd else b"".join(next(found) if x[0] in self.code else self._fallback(x) for x in odd[k]))
        return out

    def _pieces(self, words: list[str]) -> Iterator[bytes]:
        part: list[str] = []
        chars = 0
        for w in words:
            part.append(w)
            chars += len(w)
            if chars >= WINDOW:
                yield from self._joined(part)
                part, chars = [], 0
        if part:
            yield from self._joined(part)

    def _joined(self, words: list[str]) -> list[bytes]:
        pieces, count = self.encode_words(words)
        data = self.ids[pieces].astype("<u4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _fallback(self, c: str) -> bytes:
        """Of a character that no piece holds."""
        return np.array(self.bytes[list(c.encode())] if self.bytes[0] >= 0 else [self.unknown], "<u4").tobytes()

    def _spaces(self, n: int) -> bytes:
        """A run of n marks, merged from the left."""
        out = []
        while n:
            k = max((x for x in self.runs if x <= n), default=0)
            if not k:
                return self.mark * n
            out.append(self.runs[k])
            n -= k
        return np.array(out, "<u4").tobytes()

    def _learn(self, behind_space: set[str], at_line: set[str]) -> None:
        """Keeps what is at hand; it must be known together, so all of it is learnt anew if the rest has to go."""
        behind_space.discard("")
        at_line.discard("")
        if len(self.known) + len(behind_space - self.known.keys()) > self.MOST or self.held > self.MOST_BYTES:
            self.known.clear()
            self.at_line.clear()
            self.held = 0
        for kept, words, before in ((self.known, behind_space, MARK), (self.at_line, at_line, "")):
            new = list(words - kept.keys())
            found = self._ids_of([before + w for w in new])
            kept.update(zip(new, found))
            self.held += sum(map(len, new)) + sum(map(len, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows = [[line.split(" ") for line in t.replace(MARK, " ").split("\n")] if t else [] for t in texts]
        behind_space: set[str] = set()
        at_line: set[str] = set()
        for row in rows:
            for k, parts in enumerate(row):
                behind_space.update(parts[1:] if k else parts)
                if k:
                    at_line.add(parts[0])
        self._learn(behind_space, at_line)
        known, out = self.known, []
        for row in rows:
            found: list[bytes] = []
            for k, parts in enumerate(row):
                if k:
                    found.append(self.line_end)
                    if parts[0]:
                        found.append(self.at_line[parts[0]])
                    parts = parts[1:]
                if "" not in parts:
                    found += map(known.__getitem__, parts)
                    continue
                waiting = 0
                for p in parts:
                    if not p:
                        waiting += 1
                        continue
                    ids = known[p]
                    if waiting and ids[:4] == self.mark:
                        found += [self._spaces(waiting + 1), ids[4:]]
                    else:
                        found += [self._spaces(waiting), ids]
                    waiting = 0
                found.append(self._spaces(waiting))
            out.append(b"".join(found))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space in front of all goes, broken UTF-8 becomes U+FFFD."""
        data = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    return common.kept("sentencepiece", path, lambda: Vocabulary(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in common.slices(batches, "text"):
            ids = v.encode(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text, four bytes each, little-endian.

    Null texts are empty and have no ids. Rows stay as they are, repeated ones and null ids too; other
    columns are ignored.
    """
    common.ship(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(_encode(path), "doc_id bigint, n_tokens bigint, ids binary")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in common.slices(batches, "ids"):
            ids = [x or b"" for x in batch.column("ids").to_pylist()]
            texts = [v.decode(np.frombuffer(x, "<u4")) for x in ids]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_tokens"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(texts, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text", "text_sha256"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text, text_sha256) of encode()'s rows; null ids are none."""
    common.ship(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(path), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text string, text_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    encoded = encode(common.read(spark, sf_dir, "documents"), model_path())
    return decode(encoded, model_path()).select("doc_id", "n_tokens", "ids_crc32", F.char_length("text").cast("bigint").alias("n_chars"), "text_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids (array) of every document."""
    common.ship(spark)
    v = model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in vocabulary(v).encode(batch.column("text").to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([x.size for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "source", "lang", "n_tokens", "ids"])

    rows = common.picked(docs, doc_id="bigint", source="string", lang="string", text="string").na.fill("", ["text"])
    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, n_tokens bigint, ids array<int>")
