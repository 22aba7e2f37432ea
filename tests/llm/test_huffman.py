import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verbatlas.llm import huffman as h

PATH = public_tokenizers.path("word_bpe_49k.json")


def optimal(counts, limit):
    """Least total bits, from the plain package-merge of explicit coins."""
    coins = sorted((c, (k,)) for k, c in enumerate(counts) if c)
    row = []
    for _ in range(limit):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(coins + pairs, key=lambda x: x[0])
    return sum(c for c, _ in row[: 2 * len(coins) - 2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=14), st.integers(4, 9))
def test_lengths_are_optimal(counts, limit):
    lengths = h.code_lengths(np.array(counts), limit)
    used = np.flatnonzero(counts)
    assert ((lengths > 0) == (np.array(counts) > 0)).all() and lengths.max(initial=0) <= limit
    if used.size > 1:
        assert sum(2.0 ** -lengths[used]) == 1 and int((lengths * counts).sum()) == optimal(counts, limit)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=2000))
def test_round_trip(ids):
    ids = np.array(ids)
    code = h.Code(h.code_lengths(np.bincount(ids)))
    bits, points = code.encode(ids)
    assert (code.decode(bits, points, ids.size) == ids).all() and points.size == -(-ids.size // h.STEP)


TEXTS = ["don't stop'll 'S", "ΑΣ Σ", "J̌ x", "a\x1cb c d", "<|endoftext|> hi", "İx", "x1y2 3.5!!a'b", "…“q”", "", "  ", "DON'T", "é É é", "a<|endoftext|>b", "ſ K", "n't're've", "Ǆ ǅ", "²x½y", "ab's 's", "x-'ll", "9\n", "a b\r\n\t", " \n"]


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.sampled_from(TEXTS), st.text(alphabet=st.sampled_from("aB'sdLl rev.,!9é ÉǅJ̌\n\t<|>x"), max_size=40)))
def test_ids_equal_the_library(text):
    assert h.encoder(PATH)(pa.array([text]))[0].tolist() == library().encode(text, add_special_tokens=False).ids


_kept = []


def library():
    if not _kept:
        _kept.append(Tokenizer.from_file(PATH))
    return _kept[0]


@pytest.mark.parametrize("name", ["odd", "repeated"])
def test_files(spark, name, request, monkeypatch):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, (np.array([*library().encode(r.text or "", add_special_tokens=False).ids, h.END], "<u4"))) for r in docs.select("doc_id", "text").collect()]
    tokens = h.common.stored(h.tokenize(docs, PATH), "t")
    got = [(r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in h.write(tokens).documents(with_ids=True).collect()]
    got.sort()
    at = 0
    for start, _, n, crc, ids in got:
        assert start == at and len(ids) == 4 * n and zlib.crc32(ids) == crc
        at += n
    assert [g[1] if g[1] is not None else -1 for g in got] == sorted(i if i is not None else -1 for i, _ in rows)
    assert sorted((-1 if g[1] is None else g[1], g[4]) for g in got) == sorted((-1 if i is None else i, a.tobytes()) for i, a in rows)


def test_empty_table(none):
    assert h.write(h.common.stored(h.tokenize(none, PATH), "t")).documents().count() == 0


def test_small_caches_change_nothing(monkeypatch):
    """Words learnt anew, words too long to keep, and all letters of the plain characters in one batch."""
    texts = TEXTS + ["one two " + "long" * 40 + " three", "".join(map(chr, range(0xA1, 0x250))), " ".join(map(chr, range(0xA1, 0x250))), "one two"]
    want = [library().encode(t, add_special_tokens=False).ids for t in texts]
    for most, longest in ((5, 60), (0, 0), (10**6, 3)):
        monkeypatch.setattr(h.Encoder, "MOST", most)
        monkeypatch.setattr(h.Encoder, "LONGEST", longest)
        encode = h.Encoder(PATH)
        for part in (slice(0, 9), slice(9, None), slice(None)):
            ids, counts = encode(pa.array(texts[part]))
            assert [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])] == want[part]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=5), max_size=6), st.integers(0, 3))
def test_packing(rows, skip):
    ids, counts = np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows], np.int64)
    found, sizes = h.unpacked(h.packed(ids, counts).slice(skip)) if rows[skip:] else (np.empty(0), np.empty(0))
    assert found.tolist() == [x for r in rows[skip:] for x in r] and sizes.tolist() == [len(r) for r in rows[skip:]]


READER = """
import sys
from pyspark.sql import SparkSession
from verbatlas.llm import huffman
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for r in huffman.open_file(spark, sys.argv[1]).documents().orderBy("start").collect():
    print("ROW", r.doc_id, r.start, r.n_tokens, r.ids_crc32)
"""


def test_read_by_another_process(spark, tmp_path):
    docs = spark.createDataFrame([(3, "some words"), (1, "others, and more"), (2, None)], "doc_id bigint, text string")
    made = h.write(h.common.stored(h.tokenize(docs, PATH), "t"), path=f"file://{tmp_path}/file")
    want = [tuple(map(str, (r.doc_id, r.start, r.n_tokens, r.ids_crc32))) for r in made.documents().orderBy("start").collect()]
    said = subprocess.run([sys.executable, "-c", READER, f"file://{tmp_path}/file"], capture_output=True, text=True, timeout=180, cwd=h.common.ROOT)
    assert [tuple(line.split()[1:]) for line in said.stdout.splitlines() if line.startswith("ROW")] == want, said.stderr[-2000:]
