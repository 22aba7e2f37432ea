import random
import re
from collections import defaultdict

from verbatlas.llm import jaccard_join as j


def brute(rows):
    """(class, links, copies) of each (doc_id, text)."""
    words = lambda t: tuple(w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in (t or "").split()) if w)
    nodes = defaultdict(list)
    for i, t in rows:
        if i is not None and words(t):
            nodes[words(t)].append(i)
    keys = list(nodes)
    sets = [{k[p : p + min(5, len(k))] for p in range(len(k) - min(5, len(k)) + 1)} for k in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    first = defaultdict(list)
    for a, k in enumerate(keys):
        first[top(a)] += nodes[k]
    at = {k: (min(first[top(a)]), links[a], len(nodes[k])) for a, k in enumerate(keys)}
    return sorted((-1 if i is None else i, *(at[words(t)] if i is not None and words(t) else (-1 if i is None else i, 0, 1))) for i, t in rows)


def found(df, **how):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links, r.n_copies) for r in j.jaccard_links(df, **how).collect())


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(4, 150))
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_against_every_pair(spark):
    rows = list(enumerate(texts(8)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert any(r[2] > 2 for r in want)
    assert found(df) == want
    assert found(df, block=300) == want  # runs cut into many blocks
    assert found(df, block_rows=2) == want


def test_depth():
    assert j.promised(j.prefix_depth()) >= j.RECALL > j.promised(j.prefix_depth() + 1)
    assert j.prefix_depth(recall=1.0) == 1


def test_prefixes_are_shortened_until_the_recall_suffices(spark, monkeypatch):
    """With a lenient target whole signatures do; with a strict one more links are found, at the estimate's word."""
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(150):
        base = rng.choices(vocabulary, k=60)
        rows.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sum(r[2] for r in brute(rows))
    monkeypatch.setattr(j, "SURE", 10)
    few = sum(r[2] for r in found(df, trees=3, recall=0.2))
    many = sum(r[2] for r in found(df, trees=3, recall=0.9))
    assert few < many <= want and many >= 0.8 * want
    assert sum(r[2] for r in found(df)) >= 0.999 * want > 600


def test_forest_against_grouping(spark):
    """Runs that go on over many ranges, one prefix holding most nodes."""
    rng = random.Random(9)
    rows = []
    for node in range(400):
        values = [7, 7, 7] if node % 3 else [rng.randrange(3) for _ in range(3)]
        rows.append((node, b"".join(x.to_bytes(2, "little") for x in [*values, *(rng.randrange(2) for _ in range(3))])))
    df = spark.createDataFrame(rows, "node bigint, signature binary")
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = j.forest(df.repartition(5), 2, 3, 2).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        for d in (2, 3):
            by_run, by_prefix = {}, {}
            for r in got:
                by_run.setdefault(r[f"run_{d}"], set()).add((r.tree, r.node))
            for node, sig in rows:
                for tree in (0, 1):
                    by_prefix.setdefault((tree, sig[6 * tree : 6 * tree + 2 * d]), set()).add((tree, node))
            groups = lambda x: sorted(sorted(v) for v in x.values() if len(v) > 1)
            assert groups(by_run) == groups(by_prefix)


def test_odd_rows(spark, odd, repeated, none, odd_texts):
    assert found(odd) == brute(list(enumerate(odd_texts)))
    assert found(repeated) == brute([(r.doc_id, r.text) for r in repeated.select("doc_id", "text").collect()])
    assert found(none) == []
    kept = j.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(list(enumerate(odd_texts))) if r[0] == r[1]}
    # of one id a copy and a text of its own: the copy goes; rows without words or id stay
    left = [(r.doc_id, (r.text or "")[:20]) for r in j.stage(spark, repeated, "").collect()]
    text = {r.text[:20] for r in repeated.where("doc_id = 1").collect()}
    assert sorted(x for i, x in left if i == 1) == sorted(text) and sum(i is None for i, _ in left) == 3
    assert j.stage(spark, none, "").count() == 0


def test_blocks_are_bounded_by_rows(spark):
    sizes = spark.range(20_000).selectExpr("id as node", "cast(0 as bigint) as run", "cast(10 as bigint) as n_shingles")
    counts = [r["count"] for r in j.in_blocks(sizes).groupBy("block").count().collect()]
    assert sum(counts) == 20_000 and max(counts) < 1.3 * j.ROWS
    texts = [(k, f"one two three four five six seven eight nine ten eleven twelve {'x' * (k % 60 + 1)}") for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    whole = found(docs)
    assert found(docs, block_rows=7) == whole and whole[0][2] == 59


def run_joins(spark, since):
    """The rows out of every join by run in the executions after that one."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = []
    for e in (store.executionsList().apply(k) for k in range(store.executionsList().size())):
        if e.executionId() <= since:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if re.search(r"Join \[run#\d+L\], \[run#\d+L\]", node.desc()):
                rows = [node.metrics().apply(k) for k in range(node.metrics().size()) if node.metrics().apply(k).name() == "number of output rows"]
                out += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in rows if values.get(m.accumulatorId()).isDefined()]
    return out


def test_near_copies_are_joined_with_their_runs_once(spark, monkeypatch):
    """A node has one place in a tree: joins by run make a row for it at most, so they grow with a group, not its square."""
    monkeypatch.setattr(j, "SURE", 10)  # whole signatures suffice
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = rng.choices(vocabulary, k=120)
    made = []
    for group in (100, 200):
        rows = []
        for k in range(group):
            copy = list(base)
            copy[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((k, " ".join(copy)))
        executions = spark._jsparkSession.sharedState().statusStore().executionsList()
        since = max((executions.apply(k).executionId() for k in range(executions.size())), default=-1)
        got, want = found(spark.createDataFrame(rows, "doc_id bigint, text string"), recall=0.9), brute(rows)
        assert [(i, c, n) for i, c, _, n in got] == [(i, c, n) for i, c, _, n in want]
        assert 0.999 * sum(r[2] for r in want) <= sum(r[2] for r in got) <= sum(r[2] for r in want)
        made.append(sum(run_joins(spark, since)))
        assert 0 < made[-1] <= j.TREES * group
    assert made[1] < 3 * made[0]
