import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from verbatlas.llm import suffix_array, suffix_dedup


def sorted_suffixes(text):
    tails = [tuple(text[i:].tolist()) for i in range(text.size)]
    want = sorted(range(text.size), key=tails.__getitem__)
    return want, [0] + [next((k for k, (x, y) in enumerate(zip(tails[a], tails[b])) if x != y), min(len(tails[a]), len(tails[b]))) for a, b in zip(want, want[1:])]


@pytest.mark.parametrize("block, few", [(1 << 16, 1024), (3, 2), (1, 1)])
def test_suffix_arrays_against_sorting(monkeypatch, block, few):
    """With everything in files, the smallest blocks, and recursion down to texts of a few names."""
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    monkeypatch.setattr(suffix_array, "FEW", few)
    rng = np.random.default_rng(4)
    for trial in range(60):
        text = np.append(rng.integers(1, rng.integers(2, 6) + 1, rng.integers(1, 60)), 0)
        if trial % 3 == 0:
            text = np.append(np.tile(rng.integers(1, 4, rng.integers(1, 5)), rng.integers(1, 12)), 0)
        want, shared = sorted_suffixes(text)
        for limit in (1000, 5, 2):
            for spill in (suffix_array.SPILL, 7, 1):
                with suffix_array.Scratch(spill) as scratch:
                    order, lcp = (np.array(x) for x in suffix_array.suffix_array(text, limit, scratch))
                assert lcp.tolist() == [min(limit, x) for x in shared], (text, limit, spill)
                assert limit < 1000 or order.tolist() == want


def test_deep_recursion_over_files():
    rng = np.random.default_rng(8)
    text = np.concatenate([np.tile(rng.integers(1, 9, 50), 12), rng.integers(1, 5, 900), np.full(300, 3), np.tile(rng.integers(1, 3, 7), 60), [0]])
    want, shared = sorted_suffixes(text)
    with suffix_array.Scratch(16) as scratch:
        order, lcp = suffix_array.suffix_array(text, 10_000, scratch)
        assert order.tolist() == want and lcp.tolist() == shared and scratch.made > 100


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard, spill", [(2000, suffix_array.SPILL), (10**6, 1000), (900, 500)])
def test_dedup_against_counting(spark, shard, spill):
    """Many small shards, large ones in files, and nearly every minimizer hot."""
    rng = random.Random(6)
    passages = ["".join(rng.choices("ab é", k=rng.randint(100, 700))) for _ in range(6)] + ["xy" * 300, "q" * 900]
    texts = ["".join(rng.choice([rng.choice(passages), "".join(rng.choices("cdef", k=rng.randint(0, 500)))]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for k in range(8):
        cut = rng.randrange(100)
        texts.append(passages[0][cut:] + str(k))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(df, shard=shard, spill=spill).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 400)


def test_a_shard_far_larger_than_its_memory(monkeypatch):
    """What the task holds doesn't grow with the shard: eight times the bytes, less than twice the peak."""
    import tracemalloc

    monkeypatch.setattr(suffix_array, "BLOCK", 4096)
    rng = random.Random(3)
    peaks = []
    for times in (1, 8):
        passage = "".join(rng.choices("abcdef ", k=450)).encode()
        segments = [bytes(rng.choices(b"abcdefgh", k=100)) + passage + bytes(rng.choices(b"abcdefgh", k=122)) for _ in range(60 * times)]
        shard = suffix_dedup.Shard(5000)
        for k, x in enumerate(segments):
            shard.add(k, k, k, 0, x)
        del segments
        tracemalloc.start()
        found = sum(len(np.frombuffer(r, "<i4")) == 2 for _, r in shard.repeated(400))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        folder = shard.scratch.folder.name
        shard.close()
        assert found == 60 * times and not os.path.exists(folder)
    assert peaks[1] < 2 * peaks[0], peaks


def test_equal_windows_meet_in_a_part():
    rng = random.Random(4)
    base = bytes(rng.choices(b"abc", k=3000))
    for data in (base, b"ab" * 700, b"z" * 1500):
        keys, windows = {}, set()
        for low, twice in ((0, data), (37, b"x" * 37 + data[:2000] + b"y" * 50)):
            for _, first, size in suffix_dedup.segments(twice):
                for a, n in zip(first.tolist(), size.tolist()):
                    for key, shift, part in suffix_dedup.context_parts(twice[a : a + n]):
                        for p in range(len(part) - 399):
                            keys.setdefault(part[p : p + 400], set()).add(key)
                            windows.add((low, a + shift + p))
            assert all((low, p) in windows for p in range(len(twice) - 399))
        assert all(len(k) == 1 for k in keys.values())


def test_odd_rows(odd, repeated, none, odd_texts):
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup(odd, with_text=True).collect()}
    assert [got[k] for k in range(len(odd_texts))] == brute(odd_texts, 400)
    texts = [r.text for r in repeated.select("text").collect()]
    assert sorted(tuple(r)[1:] for r in suffix_dedup.dedup(repeated).collect()) == sorted(brute(texts, 400))
    assert suffix_dedup.dedup(none).count() == 0
