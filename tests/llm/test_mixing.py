import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import mixing


def test_rake_meets_targets():
    rng = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}") for a in range(4) for b in range(3) for c in range(2)]
    tokens = rng.integers(100, 1000, len(cells)).astype(float)
    share = mixing.rake(cells, tokens, 0.3, {"source": 0.9, "lang": 0.9, "topic": 0.9})
    assert (share > 0).all() and (share <= 1).all()
    for k in range(3):
        names = sorted({c[k] for c in cells})
        total = np.array([sum(t for c, t in zip(cells, tokens) if c[k] == n) for n in names])
        got = np.array([sum(t * s for c, t, s in zip(cells, tokens, share) if c[k] == n) for n in names])
        want = total**0.9 / (total**0.9).sum() * 0.3 * tokens.sum()
        assert np.allclose(got, want, rtol=1e-6)


def test_explicit_targets_and_scarce_values():
    cells = [("a", "x", "t"), ("b", "x", "t")]
    share = mixing.rake(cells, np.array([900.0, 100.0]), 0.5, mixing.FLATTEN, targets={"source": {"a": 0.5, "b": 0.5}})
    assert share[1] == 1 and 0 < share[0] < 1
    assert mixing.rake([], np.empty(0), 0.5, mixing.FLATTEN).size == 0


def test_spark_rakes_as_the_driver_does(spark, odd, monkeypatch):
    rows = mixing.described(odd).select(*mixing.DIMENSIONS, "n_tokens")
    near = {tuple(r[:3]): r.share for r in mixing.cell_shares(rows, rounds=3).collect()}
    monkeypatch.setattr(mixing, "SMALL", 0)
    far = {tuple(r[:3]): r.share for r in mixing.cell_shares(rows, rounds=3).collect()}
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k], rel=1e-6) for k in near)


def test_odd_rows(odd, repeated, none, odd_texts):
    assert mixing.mixed(odd).count() == len(odd_texts) and mixing.mixed(none).count() == 0
    rows = mixing.mixed(repeated).where("doc_id = 1").groupBy("draw").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in rows) == [1, 2]
    assert mixing.stage(odd.sparkSession, odd, "").columns == odd.columns
    kept = {r.doc_id for r in mixing.mixed(odd).where("kept").collect()}
    assert {r.doc_id for r in mixing.stage(odd.sparkSession, odd, "").collect()} == kept
