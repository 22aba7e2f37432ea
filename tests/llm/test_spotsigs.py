import hashlib

import pytest

from verbatlas.llm import spotsigs as s


def test_signatures():
    words = s.Words()
    a = s.signatures("the red fox jumps over a lazy dog of mine", words)
    assert a.size and (a == s.signatures("The red, fox jumps over a lazy dog of mine!", words)).all()
    assert s.signatures("", words).size == 0 and s.signatures("...", words).size == 1 and s.signatures("red fox", words).size == 2
    assert (s.from_text(s.to_text(a)) == a).all()
    assert s.jaccard(a, a) == 1 and s.jaccard(a[:0], a[:0]) == 1 and s.jaccard(a, a[:1], 0.9) == 0


def test_rare_anchors_share_signatures():
    words, names = s.Words(), [f"w{k}x" for k in range(400)]
    rare = " ".join(names[:300])  # no anchor at all
    dense = " ".join(f"the {w}" for w in names[300:])
    for a, b in ((rare, rare + " " + dense), (dense, dense + " " + rare), (rare, s.edited(rare, dense * 9)), (dense, s.edited(dense, rare))):
        x, y = set(s.signatures(a, words)), set(s.signatures(b, words))
        assert len(x & y) >= 0.6 * len(x) and s.jaccard(s.signatures(a, words), s.signatures(b, words)) > 0.2
    anchored = " ".join(f"the {' '.join(names[k : k + 30])}" for k in range(0, 300, 30))  # one anchor in 30 words
    assert len(set(s.signatures(anchored, words)) - set(s.signatures(anchored.replace("the ", ""), words))) >= 10
    parsed = [s.values(t.split(), words) for t in (dense, "", rare, "the", anchored)]
    assert all((x == s.signature_sets([t], [p])[0]).all() for t, p, x in zip((dense, "", rare, "the", anchored), parsed, s.signature_sets([dense, "", rare, "the", anchored], parsed)))


def test_words_of_edited_texts():
    words = s.Words()
    for a in ("", "a", "a b", " a", "abc def ", "  ", " a b c d e f ", "foo bar baz"):
        for b in ("", "x", "x y z", " x", "  "):
            found = s._edited_values(a, s.values(a.split(), words), b, s.values(b.split(), words), words)
            assert (found == s.values(s.edited(a, b).split(), words)).all(), (a, b)


def brute(rows):
    """rows: (doc_id, text) in any order."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    words, out = s.Words(), []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        e = s.edited(t, n)
        f, g = s.signatures(t, words), s.signatures(e, words)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), s.to_text(f), s.to_text(g), s.jaccard(f, g), s.jaccard(f, s.signatures(n, words))))
    return sorted(map(str, out))


def test_report(spark, odd, repeated, none, odd_texts, monkeypatch):
    monkeypatch.setattr("verbatlas.llm.neighbours.ROWS", 3)
    got = sorted(str(tuple(r)[:7]) for r in s.fingerprint_report(odd).collect())
    assert got == brute(list(enumerate(odd_texts)))
    assert s.fingerprint_report(none).count() == 0
    one = odd.where("doc_id = 6")
    assert sorted(str(tuple(r)[:7]) for r in s.fingerprint_report(one).collect()) == brute([(6, odd_texts[6])])
    rows = [(r.doc_id, r.text) for r in repeated.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)[:7]) for r in s.fingerprint_report(repeated).collect()) == brute(rows)


def test_links(spark, odd, none, odd_texts):
    words = s.Words()
    sets = {}
    for k, t in enumerate(odd_texts):
        sets.setdefault(tuple(s.signatures(t or "", words)), k)
    nodes = [(k, x) for x, k in sets.items() if x]
    want = {(a, b) for a, x in nodes for b, y in nodes if a < b and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    found = {(r.a, r.b): r.likeness for r in s.spotsigs_links(odd, 0.5).collect()}
    assert set(found) == want and want and all(v == pytest.approx(v) for v in found.values())
    assert s.spotsigs_links(none).count() == 0
