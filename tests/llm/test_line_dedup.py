import random

from verbatlas.llm import line_dedup


def one_edit(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    lines = [((2**63 - 1 if i is None else i, n), x, k) for k, (i, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n"))]
    out = [[] for _ in rows]
    for place, x, k in lines:
        if len(x) < line_dedup.MIN_CHARS or not any(p < place and abs(len(x) - len(y)) < 2 and one_edit(x, y) for p, y, _ in lines):
            out[k].append(x)
    return ["\n".join(x) for x in out]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, place int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.kept) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted((i if i is not None else -1, t or "", k) for (i, t), k in zip(rows, brute(rows)))


def test_against_every_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abé ", k=rng.randint(18, 40))) for _ in range(25)]
    base += ["z" * 20, "z" * 21, "z" * 22, "ab" * 15, "ba" * 15]

    def variant(x):
        i, kind = rng.randrange(len(x)), rng.randrange(5)
        if kind == 0:
            return x[:i] + x[i + 1 :]
        if kind == 1:
            return x[:i] + "Q" + x[i:]
        if kind == 2:
            return x[:i] + "R" + x[i + 1 :]
        return x if kind == 3 else x[:i] + "ST" + x[i + 1 :]

    rows = [(rng.choice([k, 7, None]), "\n".join(variant(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    check(spark, rows)


def test_odd_rows(spark, odd, repeated, none, odd_texts):
    out = {r.doc_id: r.kept for r in line_dedup.dedup_lines(odd).collect()}
    assert len(out) == len(odd_texts) and out[0] == "" and out[10] == odd_texts[10] and out[13] == "tail" and out[7] == ""
    assert line_dedup.dedup_lines(repeated).count() == 6 and line_dedup.dedup_lines(none).count() == 0
    kept = line_dedup.stage(spark, odd, "")
    assert kept.columns == odd.columns and all(r.row == "r" and r.kept == "k" for r in kept.collect())
    assert {r.doc_id for r in kept.collect()} == {k for k in range(len(odd_texts)) if k not in (7,) and not (odd_texts[k] and out[k] != odd_texts[k] and not out[k].strip())}
    assert "Python" not in line_dedup.dedup_lines(odd)._jdf.queryExecution().toString()
