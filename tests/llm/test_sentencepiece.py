import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import sentencepiece_bpe as sp


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(sp.model_path())


TEXTS = ["Hello world", " a  b ", "a\nb\t c", "日本 é x\xa0y", "", "  ", "\n\n  x", "a" * 50, " " * 40 + "b", "<s> hi </s> <0x41>", "x▁y", "𝒳😀 z", "aaaa bbbb   ", "don't   stop\n\n\n   now", "............ !!!!!!!", "1234567890 00000000"]


def test_equals_the_library(vocabulary, library):
    for text, ids in zip(TEXTS, vocabulary.encode(TEXTS)):
        found = np.frombuffer(ids, "<u4")
        assert found.tolist() == library.encode(text), text
        assert vocabulary.decode(found) == library.decode(found.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab he lo\nétion'.▁1日😀"), max_size=40), max_size=5))
def test_equals_the_library_on_any_text(vocabulary, library, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(texts)] == [library.encode(t) for t in texts]


def test_odd_rows(spark, odd, repeated, none, odd_texts, library):
    encoded = sp.encode(odd, sp.model_path())
    for r in encoded.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(odd_texts[r.doc_id] or "")
    texts = {r.doc_id: r.text for r in sp.decode(encoded, sp.model_path()).collect()}
    assert all(texts[k] == (t or "") for k, t in enumerate(odd_texts))
    assert sp.encode(repeated, sp.model_path()).count() == 6 and sp.encode(none, sp.model_path()).count() == 0
    assert sp.stage(spark, odd, "").columns == ["doc_id", "source", "lang", "n_tokens", "ids"]


@pytest.mark.parametrize("most, most_bytes, window", [(3, 1 << 20, 1 << 19), (1000, 10, 7), (0, 0, 1)])
def test_small_caches_and_windows_change_nothing(vocabulary, library, monkeypatch, most, most_bytes, window):
    monkeypatch.setattr(sp.Vocabulary, "MOST", most)
    monkeypatch.setattr(sp.Vocabulary, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(sp, "WINDOW", window)
    for texts in (TEXTS[:6], TEXTS[6:], ["abcdefgh" * 400 + "é日" + "xyz" * 300], TEXTS):
        assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(texts)] == [library.encode(t) for t in texts]
