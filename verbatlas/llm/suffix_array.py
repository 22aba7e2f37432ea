"""Suffix arrays with common-prefix lengths by external induced sorting.

Suffixes are of type S (less than the one behind) or L. S suffixes behind an L suffix (LMS) are sorted
first: a rough induction orders their substrings, equal substrings get one name, and the text of names is
sorted by recursion. A text of names of at most SPILL symbols is the base of the recursion: it is sorted by
doubled ranks in memory. From the sorted LMS suffixes two sweeps induce all others: upwards those of type L,
downwards those of type S.

A sweep reads a priority queue of suffix tuples (position, common prefix with the tuple before) keyed by the
suffix's first symbol. Tuples of one key leave in the order in which they came. The queue holds runs of
neighbouring keys, appended to and read in blocks; beyond SPILL tuples the runs are files. Whole blocks are
induced at once. Texts, types, names, orders and prefixes of more than SPILL symbols are memory-mapped files,
read and written in blocks, so memory holds blocks, not the text.

Common prefixes are carried along: neighbours of one key that suffixes u < v induced share one symbol and
what u and v share, which is the least value between them in the sweep. Those of LMS suffixes come from the
recursion: the names that two of them share stand for all symbols up to the first other name, whose
substrings are compared. Values are cut at a limit; two names are four symbols or more, so the limit
halves with each level.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16  # tuples read at once
SPILL = 1 << 19  # tuples and symbols held in memory
FEW = 1024  # keys that have a run each
BIG = np.iinfo(np.int64).max


class Scratch:
    """A folder of the task's own, in the folder that Spark gives its tasks for spilled data; it goes with the task's
    work, and no other task reads it. Arrays of more than spill values are files there."""

    def __init__(self, spill: int | None = None):
        self.spill = SPILL if spill is None else spill
        given = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = tempfile.TemporaryDirectory(dir=given if given and os.path.isdir(given) else None)
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.folder.cleanup()

    def path(self, name: str) -> str:
        self.made += 1
        return os.path.join(self.folder.name, f"{name}-{self.made}")

    def zeros(self, n: int, kind=np.int64) -> np.ndarray:
        return np.zeros(n, kind) if n <= self.spill else np.memmap(self.path("array"), kind, "w+", shape=(n,))


def blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((b, min(n, b + BLOCK)) for b in range(0, n, BLOCK))


class Queue:
    """Tuples by key, first in first out within a key; on disk beyond the scratch folder's bound.

    ends: how many symbols of the text are of each key or a lower one. Neighbouring keys of few tuples share a run, which is put in
    order in memory when the sweep gets there; a key of many has one of its own, which is read in blocks.
    """

    def __init__(self, scratch: Scratch, ends: np.ndarray):
        self.scratch, self.held, self.ends = scratch, 0, ends
        self.room = max(1, scratch.spill // 4)
        self.paths: dict[int, str] = {}
        self.runs: dict[int, list[np.ndarray]] = {}  # of each run: rows of key, position, common prefix
        self.open, self.by_key = -1, {}

    def _run(self, key: int) -> int:
        return key if self.ends.size <= FEW else int(self.ends[key]) // self.room

    def _alone(self, key: int) -> bool:
        return self.ends.size <= FEW or self._run(key) not in (self._run(key - 1) if key else -1, self._run(key + 1) if key + 1 < self.ends.size else -1)

    def push(self, key: int, position: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty((position.size, 3), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2] = key, position, lcp
        run = self._run(key)
        if run == self.open:
            self.by_key.setdefault(key, []).append(rows)
            return
        self.runs.setdefault(run, []).append(rows)
        self.held += position.size
        if self.held > self.scratch.spill:
            for r, parts in self.runs.items():
                with open(self.paths.setdefault(r, self.scratch.path("run")), "ab") as f:
                    f.writelines(p.data for p in parts)
            self.runs, self.held = {}, 0

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of the key's tuples; what is pushed to it meanwhile follows."""
        run = self._run(key)
        if self._alone(key):
            yield from self._stream(run)
            return
        if run != self.open:
            self.open, self.by_key = run, {}
            rows = [np.stack([np.full(p.size, k), p, v], axis=1) for k, p, v in self._stream(run, keys=True)]
            if rows:
                rows = np.concatenate(rows)
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
                for b, e in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
                    self.by_key[int(rows[b, 0])] = [rows[b:e]]
        while parts := self.by_key.pop(key, None):
            rows = np.concatenate(parts)
            for b, e in blocks(len(rows)):
                yield rows[b:e, 1], rows[b:e, 2]

    def _stream(self, run: int, keys: bool = False):
        at = 0
        while True:
            path = self.paths.get(run)
            if path and os.path.getsize(path) > at:
                with open(path, "rb") as f:
                    f.seek(at)
                    rows = np.frombuffer(f.read(BLOCK * 24), np.int64).reshape(-1, 3)
                at += rows.nbytes
            elif parts := self.runs.pop(run, None):
                rows = np.concatenate(parts)
                self.held -= len(rows)
            else:
                if path:
                    os.remove(self.paths.pop(run))
                return
            for b, e in blocks(len(rows)):
                if keys:
                    for k, p, v in zip(*self._split(rows[b:e])):
                        yield k, p, v
                else:
                    yield rows[b:e, 1], rows[b:e, 2]

    @staticmethod
    def _split(rows: np.ndarray):
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        ends = [*first[1:].tolist(), len(rows)]
        return rows[first, 0].tolist(), [rows[b:e, 1] for b, e in zip(first, ends)], [rows[b:e, 2] for b, e in zip(first, ends)]


class Sweep:
    """Induces, from blocks of suffixes in sweep order, the suffixes one symbol longer into a queue."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, type_: bool, queue: Queue, keys: int, cut: int):
        self.text, self.is_s, self.type, self.queue, self.cut = text, is_s, type_, queue, cut
        self.fed = 0
        self.last, self.tail = queue.scratch.zeros(keys), queue.scratch.zeros(keys)  # of a key's last tuple: its block, and the least value behind it there
        self.lows: tuple[list[int], list[int]] = [], []  # blocks whose least value no later one is below, and those values

    def _since(self, keys: np.ndarray) -> np.ndarray:
        """The least value since the last tuple of each key was induced."""
        at = np.searchsorted(self.lows[0], self.last[keys], "right")
        return np.minimum(self.tail[keys], np.array([*self.lows[1], BIG])[at])

    def feed(self, position: np.ndarray, value: np.ndarray) -> None:
        """value[k]: common prefix of suffix k with the one before it in the sweep."""
        self.fed += 1
        before = position - 1
        hit = np.flatnonzero((before >= 0) & (self.is_s[before] == self.type))
        total = np.minimum.accumulate(value)
        if hit.size:
            symbol = self.text[before[hit]].astype(np.int64)
            order = np.argsort(symbol, kind="stable")
            hit, symbol = hit[order], symbol[order]
            first = np.flatnonzero(np.diff(symbol, prepend=-1))
            shared = np.empty(hit.size, np.int64)
            follows = np.ones(hit.size, bool)
            follows[first] = False
            shared[follows] = least_between(value, hit[:-1][follows[1:]], hit[1:][follows[1:]])
            keys = symbol[first]
            shared[first] = np.where(self.last[keys] > 0, np.minimum(self._since(keys), total[hit[first]]), -1)
            shared = np.where(shared < 0, 0, np.minimum(shared + 1, self.cut))
            ends = np.append(first[1:], hit.size)
            for key, b, e in zip(keys.tolist(), first.tolist(), ends.tolist()):
                self.queue.push(key, before[hit[b:e]], shared[b:e])
            self.last[keys] = self.fed
            self.tail[keys] = np.append(np.minimum.accumulate(value[::-1])[::-1], BIG)[hit[ends - 1] + 1]
        low = int(total[-1])
        while self.lows[1] and self.lows[1][-1] >= low:
            self.lows[0].pop()
            self.lows[1].pop()
        self.lows[0].append(self.fed)
        self.lows[1].append(low)


def least_between(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of value over (low, high] for each pair, by minima over powers of two."""
    out = np.empty(low.size, np.int64)
    if not low.size:
        return out
    span = high - low
    level = np.zeros(low.size, np.int64)
    level[span > 1] = np.floor(np.log2(span[span > 1])).astype(np.int64)
    table, width = value, 1
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine] + 1], table[high[mine] - width + 1])
        if k < level.max():
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out


def shared_heads(text: np.ndarray, a: np.ndarray, b: np.ndarray, cut) -> np.ndarray:
    """Common prefixes of pairs of suffixes, none longer than cut (one number or one for each pair)."""
    n, done, width = text.size, 0, 8
    cut = np.broadcast_to(np.asarray(cut, np.int64), a.shape)
    out = cut.copy()
    live = np.arange(a.size)
    while live.size:
        at = done + np.arange(width)
        keep = []
        for part in np.array_split(live, max(1, live.size * width >> 20)):
            x, y = a[part, None] + at, b[part, None] + at
            differ = (text[np.minimum(x, n - 1)] != text[np.minimum(y, n - 1)]) | (x >= n) | (y >= n)
            some = differ.any(1)
            out[part[some]] = done + differ[some].argmax(1)
            keep.append(part[~some])
        live = np.concatenate(keep)
        done += width
        live = live[cut[live] > done]
        width = min(128, width * 2)
    return np.minimum(out, cut)


def types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True for type S. The last symbol is the one least of all."""
    n = text.size
    out = scratch.zeros(n, bool)
    behind = True  # type of the first suffix of the block behind
    for b, e in reversed(list(blocks(n))):
        part = np.asarray(text[b : min(n, e + 1)]).astype(np.int64)
        if e == n:
            part = np.append(part, np.int64(-1))  # the last suffix is S by definition
        rise, known = part[:-1] < part[1:], part[:-1] != part[1:]
        if e == n:
            rise[-1] = known[-1] = True
        m = e - b
        following = np.minimum.accumulate(np.where(known, np.arange(m), m)[::-1])[::-1]
        out[b:e] = np.append(rise, behind)[following]
        behind = bool(out[b])
    return out


def _counts(text: np.ndarray, keys: int, scratch: Scratch, at: np.ndarray | None = None, where: np.ndarray | None = None) -> np.ndarray:
    """How often each symbol stands in the text (at those positions, or where that holds)."""
    out = scratch.zeros(keys)
    for b, e in blocks(text.size if at is None else at.size):
        part = text[b:e] if at is None else text[at[b:e]]
        symbol, count = np.unique(part if where is None else part[where[b:e]], return_counts=True)
        out[symbol] += count
    return out


def _cumulated(sizes: np.ndarray, scratch: Scratch) -> np.ndarray:
    out, total = scratch.zeros(sizes.size), 0
    for b, e in blocks(sizes.size):
        out[b:e] = total + np.cumsum(sizes[b:e])
        total = int(out[e - 1])
    return out


def _used(sizes: np.ndarray, down: bool = False) -> Iterator[int]:
    for b, e in reversed(list(blocks(sizes.size))) if down else blocks(sizes.size):
        found = b + np.flatnonzero(sizes[b:e])
        yield from (found[::-1] if down else found).tolist()


def induce(text, lms, lms_lcp, is_s, cut: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and their common prefixes up to cut, from the LMS suffixes in order with theirs."""
    keys = max(int(text[b:e].max()) for b, e in blocks(text.size)) + 1
    sizes, sizes_s = _counts(text, keys, scratch), _counts(text, keys, scratch, where=is_s)
    ends, lms_ends = _cumulated(sizes, scratch), _cumulated(_counts(text, keys, scratch, at=lms), scratch)
    order, lcp = scratch.zeros(text.size), scratch.zeros(text.size)

    up = Sweep(text, is_s, False, Queue(scratch, ends), keys, cut)
    for c in _used(sizes):
        at = head = int(ends[c] - sizes[c])
        lms_from, lms_to = int(lms_ends[c - 1]) if c else 0, int(lms_ends[c])
        for position, value in up.queue.pop(c):
            value = value.copy()
            if at == head:
                value[0] = 0
            order[at : at + position.size], lcp[at : at + position.size] = position, value
            at += position.size
            up.feed(position, value)
        for b in range(lms_from, lms_to, BLOCK):
            e = min(lms_to, b + BLOCK)
            value = np.array(lms_lcp[b:e])
            if b == lms_from:
                value[0] = shared_heads(text, order[at - 1 : at], lms[b : b + 1], cut)[0] if at > head else 0
            up.feed(np.array(lms[b:e]), value)

    down = Sweep(text, is_s, True, Queue(scratch, ends), keys, cut)
    order[0] = text.size - 1  # the last symbol alone, which no suffix induces
    for c in _used(sizes, down=True):
        at = end = int(ends[c])
        head, middle = end - int(sizes[c]), end - int(sizes_s[c])
        for position, value in down.queue.pop(c):
            value = value.copy()
            if at == end:
                value[0] = 0
            else:
                lcp[at] = value[0]
            lcp[at - position.size + 1 : at] = value[1:][::-1]
            at -= position.size
            order[at : at + position.size] = position[::-1]
            down.feed(position, value)
        seam = 0
        if middle > head and at < end:
            seam = lcp[at] = shared_heads(text, order[middle - 1 : middle], order[at : at + 1], cut)[0]
        elif at < end:
            lcp[at] = 0
        for e in range(middle, head, -BLOCK):
            b = max(head, e - BLOCK)
            value = np.concatenate([[seam if e == middle else lcp[e]], lcp[b + 1 : e][::-1]])
            down.feed(np.array(order[b:e])[::-1], value)
    return order, lcp


def _lms(is_s: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of S suffixes behind an L suffix."""
    def found():
        for b, e in blocks(is_s.size - 1):
            yield b + 1 + np.flatnonzero(is_s[b + 1 : e + 1] & ~is_s[b:e])

    out, at = scratch.zeros(sum(x.size for x in found())), 0
    for x in found():
        out[at : at + x.size] = x
        at += x.size
    return out


def _by_symbol(text: np.ndarray, lms: np.ndarray, scratch: Scratch) -> np.ndarray:
    """lms in the stable order of their symbols."""
    keys = max(int(text[lms[b:e]].max()) for b, e in blocks(lms.size)) + 1
    sizes = _counts(text, keys, scratch, at=lms)
    free = _cumulated(sizes, scratch)  # where each symbol's begin
    for b, e in blocks(keys):
        free[b:e] -= sizes[b:e]
    out = scratch.zeros(lms.size)
    for b, e in blocks(lms.size):
        symbol = np.asarray(text[lms[b:e]]).astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        first = np.flatnonzero(np.diff(symbol, prepend=-1))
        count = np.diff(np.append(first, symbol.size))
        out[free[symbol] + np.arange(symbol.size) - np.repeat(first, count)] = lms[b:e][order]
        free[symbol[first]] += count
    return out


def _named(text, lms, is_s, rough, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """The LMS substrings' numbers in rough order, their names in text order, and how many names there are."""
    order, names = scratch.zeros(lms.size), scratch.zeros(lms.size)
    at, name, before = 0, 0, np.empty(0, np.int64)
    for b, e in blocks(rough.size):
        position = np.asarray(rough[b:e])
        position = position[position > 0]
        k = np.searchsorted(lms, position[is_s[position] & ~is_s[position - 1]])
        if not k.size:
            continue
        both = np.append(before, k)
        start, end = lms[both], lms[np.minimum(both + 1, lms.size - 1)]
        length = np.where(both + 1 < lms.size, end - start + 1, 1)
        same = np.zeros(both.size, bool)
        near = np.flatnonzero(length[1:] == length[:-1])
        same[near + 1] = shared_heads(text, start[near], start[near + 1], length[near]) >= length[near]
        same = same[before.size :]
        order[at : at + k.size] = k
        value = name + np.cumsum(~same)
        names[k] = value
        at, name, before = at + k.size, int(value[-1]), k[-1:]
    return order, names, name


def _doubled(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """suffix_array() of a text of names that fits in memory, by ranks of twice as many names each time.

    Two suffixes share as many names as the ranks that are equal stand for, the deepest first.
    """
    ranks, depth = [np.append(names, 0).astype(np.int32)], 1
    while int(ranks[-1].max()) < names.size and depth < limit:
        rank = ranks[-1][:-1].astype(np.int64)
        pair = rank * (names.size + 1) + np.append(rank[depth:], np.zeros(min(depth, rank.size), np.int64))
        ranks.append(np.append(np.unique(pair, return_inverse=True)[1] + 1, 0).astype(np.int32))
        depth *= 2
    order = np.argsort(ranks[-1][:-1], kind="stable")
    shared = np.zeros(order.size, np.int64)
    u, v = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = (ranks[k][np.minimum(u, names.size)] == ranks[k][np.minimum(v, names.size)]) & (np.maximum(u, v) < names.size)
        step = same.astype(np.int64) << k
        shared[1:] += step
        u += step
        v += step
    return order, shared


def suffix_array(text: np.ndarray, limit: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes of text in order, and min(limit, common prefix with the one before).

    text: small integers, the last of them 0 and no other. Suffixes that share limit symbols may stand in
    any order. The arrays may be files of the scratch folder.
    """
    if text.size == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    is_s = types(text, scratch)
    lms = _lms(is_s, scratch)
    rough, _ = induce(text, _by_symbol(text, lms, scratch), scratch.zeros(lms.size), is_s, 1, scratch)
    order, names, count = _named(text, lms, is_s, rough, scratch)
    shared = None
    if count < lms.size and lms.size <= scratch.spill:
        order, shared = _doubled(names, limit // 2 + 1)
    elif count < lms.size:
        deeper = scratch.zeros(lms.size + 1)
        for b, e in blocks(lms.size):
            deeper[b:e] = names[b:e]
        order, shared = suffix_array(deeper, limit // 2 + 1, scratch)
        order, shared = order[1:], shared[1:]  # the first is the end alone
    ordered, lcp = scratch.zeros(lms.size), scratch.zeros(lms.size)
    for b, e in blocks(lms.size):
        k = np.asarray(order[max(0, b - 1) : e])
        position = lms[k]
        ordered[b:e] = position[k.size - (e - b) :]
        if k.size < 2:
            continue
        u, v = position[:-1], position[1:]
        alike = np.zeros(u.size, np.int64)  # symbols that the shared names stand for
        if shared is not None:
            alike = np.minimum(limit, lms[np.minimum(k[:-1] + shared[e - u.size : e], lms.size - 1)] - u)
        lcp[e - u.size : e] = alike + shared_heads(text, u + alike, v + alike, limit - alike)
    return induce(text, ordered, lcp, is_s, limit, scratch)
