"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Words are runs without white space, in lower case, without punctuation; a text's shingles are its runs of
WORDS words (of all its words if it has fewer). Texts of equal words are one node. A node has a signature of
DEPTH MinHash values in each of TREES trees. A tree is the sorted table of its signatures: nodes that share a
prefix stand together, so runs of equal prefixes are the trie's inner nodes, of any depth, from one sort. Ranges
of the sorted table are scanned side by side, and runs that go on from one range to the next are put together
by two rows a range.

Matching begins with whole signatures. All pairs of a run are verified exactly; then prefixes are shortened
by one value, and the pairs that meet only now are verified, until the recall reached suffices. It is estimated
from the links found, each weighted with the chance to be met at its own Jaccard; no prefix is shorter than
what promises that recall for a pair just at the threshold.

A run is cut into blocks of bounded rows and shingles, and each pair of its blocks is one unit of work: a matrix
product over the shingles that occur twice there. A pair of nodes that meets in several trees counts in the
first of them. A unit returns a count of links and one tie for each node, never the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common
from verbatlas.llm.components import components

WORDS = 5
LEAST = 0.8
RECALL = 0.9995
TREES, DEPTH = 20, 6
BLOCK = 400_000  # shingles aimed at in a block
ROWS = 1_000  # and nodes, as two blocks are compared in matrices of all their nodes
NEAR = 1_000_000  # rows of nodes or units (40 bytes each) that are sent to all tasks; more are met in a shuffle
SURE = 1_000  # links that an estimate of the recall takes at least
_PUNCTUATION = re.compile(r"[\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(common.WordCache):
    """From a raw word to its hash, 0 if nothing is left of it."""

    def look(self, raw: str) -> int:
        word = _PUNCTUATION.sub("", raw.lower())
        return (xxhash.xxh64_intdigest(word) >> 1) | 1 if word else 0


def shared_words() -> Words:
    return common.kept("jaccard_join", "words", Words)


def word_hashes(text: str, words: Words) -> np.ndarray:
    raw = text.split()
    value = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)).astype(np.uint64)
    return value[value != 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(value: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs, repeated ones too; none for a text without words."""
    n = min(words, value.size)
    if not n:
        return value
    h = np.zeros(value.size - n + 1, np.uint64)
    for k in range(n):
        h = _mix(h * _M2 + value[k : value.size - n + 1 + k])
    return h


def promised(depth: int, trees: int = TREES, least=LEAST):
    """The chance that a pair of that Jaccard (a number or an array) shares a prefix of that depth in a tree."""
    return 1 - (1 - least**depth) ** trees


def prefix_depth(recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, least: float = LEAST) -> int:
    """The longest prefix that promises the recall, 1 at least."""
    while depth > 1 and promised(depth, trees, least) < recall:
        depth -= 1
    return depth


@lru_cache(maxsize=4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(runs: list[np.ndarray], values: int) -> np.ndarray:
    """For each text (with one shingle at least) its MinHash values, 16 bits each."""
    at = np.concatenate([[0], np.cumsum([r.size for r in runs])])[:-1]
    h = np.concatenate(runs)
    a, b = _multipliers(values)
    out = np.empty((len(runs), values), np.uint16)
    for k in range(values):
        out[:, k] = _mix(np.minimum.reduceat(h * a[k] + b[k], at) >> np.uint64(16)) >> np.uint64(48)
    return out


def _node_hash(value: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(value.tobytes())


def _sign(values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared_words()
        for batch in common.slices(batches, "text", 1 << 18):
            value = [word_hashes(t, words) for t in batch.column("text").to_pylist()]
            runs = [shingles(v) for v in value]
            some = [k for k, r in enumerate(runs) if r.size]
            found: list = [None] * len(runs)
            if some:
                for k, row in zip(some, signatures([runs[k] for k in some], values)):
                    found[k] = row.tobytes()
            node = [_node_hash(v) if v.size else None for v in value]
            yield pa.record_batch([batch.column("doc_id"), pa.array(node, pa.binary()), pa.array([r.size for r in runs], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "words", "size", "signature"])

    return run


# --- the forest ---


def _unpack(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u1").reshape(batch.num_rows, -1, 2 * depth)
            trees = rows.shape[1]
            keys = np.empty((*rows.shape[:2], 2 * depth + 1), np.uint8)
            keys[:, :, 0], keys[:, :, 1:] = np.arange(trees), rows
            offsets = pa.py_buffer(np.arange(0, keys.size + 1, 2 * depth + 1, dtype=np.int32))
            key = pa.Array.from_buffers(pa.binary(), batch.num_rows * trees, [None, offsets, pa.py_buffer(keys.tobytes())])
            yield pa.record_batch([pa.array(np.repeat(batch.column("node").to_numpy(), trees)), key], ["node", "key"])

    return run


def _scan(depth: int, floor: int):
    """Rows come sorted by key; out come those that may share a prefix of floor values with another.

    run_d: where in the range the run of equal prefixes of d values begins; 0 is the range's first row. The keys
    of its first and last row go with them, as runs may go on in the ranges beside it.
    """
    depths = range(floor, depth + 1)
    names = ["part", "node", "tree", "key", *(f"run_{d}" for d in depths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, starts, before, held = TaskContext.get().partitionId(), 0, np.zeros(len(depths), np.int64), None, None

        def made(rows, edge: bool):
            node, key, start, _ = rows
            n = node.size
            shown = pa.array([k.tobytes() for k in key], pa.binary()) if edge else pa.nulls(n, pa.binary())
            return pa.record_batch([pa.array(np.full(n, part), pa.int32()), pa.array(node), pa.array(key[:, 0].astype(np.int32)), shown, *(pa.array(start[:, k]) for k in range(len(depths)))], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(n, -1)
            over = key if before is None else np.concatenate([before, key])
            same = over[1:] == over[:-1]
            start = np.empty((n, len(depths)), np.int64)
            for k, d in enumerate(depths):
                equal = same[:, : 2 * d + 1].all(1)
                equal = np.append(False, equal) if before is None else equal
                place = np.where(equal, -1, at + np.arange(n))
                start[:, k] = np.maximum.accumulate(np.maximum(place, starts[k]) if equal[0] else place)
                if k == 0:
                    joined = equal  # with the row before, at the floor
            starts, before, at = start[-1], key[-1:], at + n
            rows = (batch.column("node").to_numpy(), key, start, joined)
            if held is None:
                yield made(tuple(x[:1] for x in rows), True)  # the first row of the range
                held = tuple(x[:1] for x in rows[:3]) + (np.array([True]),)  # it is out already
                out = np.zeros(n, bool)
                out[0] = True
            else:
                if joined[0] and not held[3][0]:
                    yield made(held, False)
                    held[3][0] = True
                out = np.zeros(n, bool)
            wanted = joined | np.append(joined[1:], False)
            wanted[-1], last_wanted = False, bool(wanted[-1])
            wanted &= ~out
            if wanted.any():
                yield made(tuple(x[wanted] for x in rows), False)
            out |= wanted
            last = tuple(x[-1:] for x in rows[:3])
            if last_wanted and not out[-1]:
                yield made((*last, None), False)
                out[-1] = True
            held = (*last, out[-1:].copy())
        if held is not None and at > 1:
            # the last row: its key shows, and if it is out already it is marked by no node
            yield made(held, True) if not held[3][0] else made((np.array([-1]), *held[1:]), True)

    return run, "part int, node bigint, tree int, key binary, " + ", ".join(f"run_{d} bigint" for d in depths)


def forest(signed_nodes: DataFrame, trees: int, depth: int, floor: int) -> DataFrame:
    """(node, tree, run_floor .. run_depth): the trie places of the nodes that share a prefix with others.

    signed_nodes: node and signature. Sorted by ranges of (tree, signature, node), so nodes of one prefix, however
    many, are spread over tasks.
    """
    spark = signed_nodes.sparkSession
    keys = signed_nodes.mapInArrow(_unpack(depth), "node bigint, key binary")
    scan, schema = _scan(depth, floor)
    sorted_keys = keys.repartitionByRange(common.n_partitions(spark), "key", "node").sortWithinPartitions("key", "node")
    found = common.stored(sorted_keys.mapInArrow(scan, schema), "forest")
    edges: dict[int, list] = {}
    for r in found.where("key is not null").collect():  # two rows a range
        edges.setdefault(r.part, []).append(r)
    depths = range(floor, depth + 1)
    width = 1 << 36  # rows of a range
    carried, tail = [], None
    for part in sorted(edges):
        rows = sorted(edges[part], key=lambda r: bytes(r.key))
        rows.sort(key=lambda r: max(r[f"run_{d}"] for d in depths))
        first, last = rows[0], rows[-1]
        carry = {d: tail[1][d] if tail and bytes(tail[0])[: 2 * d + 1] == bytes(first.key)[: 2 * d + 1] else part * width for d in depths}
        tail = (last.key, {d: carry[d] if last[f"run_{d}"] == 0 else part * width + last[f"run_{d}"] for d in depths})
        carried.append((part, *(carry[d] for d in depths)))
    at = F.broadcast(spark.createDataFrame(carried, "part int, " + ", ".join(f"carry_{d} bigint" for d in depths)))
    resolved = [F.when(F.col(f"run_{d}") == 0, F.col(f"carry_{d}")).otherwise(F.col("part").cast("bigint") * width + F.col(f"run_{d}")).alias(f"run_{d}") for d in depths]
    return found.where("node >= 0").join(at, "part").select("node", "tree", *resolved)


def runs_at(places: DataFrame, depth: int, deepest: int) -> DataFrame:
    """(run, tree, n, total): runs of that depth with pairs that no longer prefix of that tree has brought together.

    places: with n_shingles, whose sum over the n nodes of a run is total. Runs of the same nodes in several trees
    are one, that of the first tree.
    """
    run = F.col(f"run_{depth}")
    deeper = F.col(f"run_{min(depth + 1, deepest)}")
    found = places.groupBy(run.alias("run")).agg(F.first("tree").alias("tree"), F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min(deeper).alias("lo"), F.max(deeper).alias("hi"), *(F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"nodes{k}") for k in (0, 1)))
    found = found.where("n > 1")
    if depth < deepest:
        found = found.where("lo <> hi")
    return found.groupBy("n", "nodes0", "nodes1").agg(F.min(F.struct("tree", "run", "total")).alias("r")).select("r.run", "r.tree", "n", "r.total")


# --- verification ---


def _texts_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = shared_words()
    for batch in common.slices(batches, "text", 1 << 20):
        node, sets, sizes = [], [], []
        for text, n, h in zip(*(batch.column(c).to_pylist() for c in ("text", "node", "words"))):
            value = word_hashes(text, words)
            if value.size and _node_hash(value) == h:  # else another row of that id
                found = np.unique(shingles(value))
                node.append(n)
                sizes.append(found.size)
                sets.append(found.tobytes())
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["node", "n_shingles", "shingles"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, by matrix products over 4096 values at a time."""
    n = len(sets)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [s.size for s in sets])
    twice = count[at] > 1
    at, owner = at[twice], owner[twice]
    _, at = np.unique(at, return_inverse=True)
    by = np.argsort(at, kind="stable")
    at, owner = at[by], owner[by]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(at[-1]) + 1 if at.size else 0, 4096):
        a, b = np.searchsorted(at, (low, low + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        both += m @ m.T
    return both


def met_before(signature: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Pairs that share a longer prefix in any tree, or one of that depth in an earlier tree. signature: n x trees x values."""
    n, trees, deepest = signature.shape
    if n <= 32:
        same = np.logical_and.accumulate(signature[:, None] == signature[None], axis=3)
        out = same[:, :, :tree, depth - 1].any(2)
        return out | same[:, :, :, depth].any(2) if depth < deepest else out
    out = np.zeros((n, n), bool)
    for t in range(trees):
        d = depth if t < tree else depth + 1
        if d > deepest:
            break
        rows = np.ascontiguousarray(signature[:, t, :d])
        code = np.unique(rows.view(np.dtype((np.void, 2 * d))).ravel(), return_inverse=True)[1]
        out |= code[:, None] == code[None, :]
    return out


def compared(nodes: np.ndarray, block: np.ndarray, sets: list[np.ndarray], signature: np.ndarray, tree: int, depth: int, least: float, across: bool) -> tuple:
    """Of each node: how many links count here, the least node that links connect it with here, and of the links
    that count the inverse chances to be met, by depth down to 1."""
    n = nodes.size
    size = np.array([s.size for s in sets], np.float32)
    both = common_counts(sets)
    likeness = both / np.maximum(size[:, None] + size[None, :] - both, 1)
    linked = likeness >= least - 1e-6
    np.fill_diagonal(linked, False)
    counted = linked & ~met_before(signature, tree, depth)
    if across:  # pairs within a block are of another unit
        counted &= block[:, None] != block[None, :]
    trees, deepest = signature.shape[1:]
    x, y = np.nonzero(counted)
    found = likeness[x, y].astype(np.float64)
    weights = [np.bincount(x, 1 / promised(d, trees, found), n) for d in range(1, deepest + 1)]
    label = np.argsort(np.argsort(nodes))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        if (new == label).all():
            return np.bincount(x, minlength=n), np.sort(nodes)[label], weights
        label = new


def _compare(trees: int, depth: int, deepest: int, least: float):
    """Rows come by (run, i, j); each such unit is compared and counted."""
    names = ["node", "n_links", "tie", *(f"weight_{d}" for d in range(1, deepest + 1))]

    def unit(rows: list[tuple]) -> pa.RecordBatch:
        nodes = np.array([r[3] for r in rows], np.int64)
        signature = np.frombuffer(b"".join(r[6] for r in rows), np.uint16).reshape(len(rows), trees, deepest)
        links, tie, weights = compared(nodes, np.array([r[4] for r in rows]), [np.frombuffer(r[7], np.uint64) for r in rows], signature, rows[0][5], depth, least, rows[0][1] != rows[0][2])
        some = (links > 0) | (tie != nodes)
        return pa.record_batch([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(tie[some]), *(pa.array(w[some].astype(np.float64)) for w in weights)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[pa.RecordBatch] = []
        for batch in common.slices(batches, "shingles"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "i", "j", "node", "block", "tree", "signature", "shingles"))):
                if held and held[0][:3] != row[:3]:
                    out.append(unit(held))
                    held = []
                    if len(out) > 500:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out = []
                held.append(row)
        if held:
            out.append(unit(held))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run, "node bigint, n_links bigint, tie bigint, " + ", ".join(f"weight_{d} double" for d in range(1, deepest + 1))


def in_blocks(members: DataFrame, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """members (run, node, n_shingles and others) with blocks, how many its run is cut into, and block.

    total and n, the run's shingles and nodes, are counted and joined only where members don't come with them.
    """
    if not {"total", "n"} <= {*members.columns}:
        members = members.join(members.groupBy("run").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n")), "run")
    blocks = F.greatest(F.ceil(F.col("total") / block), F.ceil(F.col("n") / rows)).cast("int")
    cut = members.withColumn("blocks", blocks).drop("total", "n")
    return cut.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))


def jaccard_links(docs: DataFrame, least: float = LEAST, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, block_rows: int = ROWS) -> DataFrame:
    """(doc_id, words, root, class_id, n_links, n_copies) of every row of docs.

    class_id: the least doc_id of the texts connected by links of a Jaccard of at least that much, root: one number
    for each class; n_links: how many other texts the row's text is linked with; n_copies: rows whose text has the
    same words (words: their hash). Texts without words (null ones too) and rows without an id are classes of their
    own (class_id is doc_id, no words and root, no links, one copy). Rows of one id with different texts are
    different nodes. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    texts = common.id_and_text(docs)
    floor = prefix_depth(recall, trees, depth, least)
    signed = common.stored(texts.mapInArrow(_sign(trees * depth), "doc_id bigint, words binary, size bigint, signature binary"), "signed")
    usable = signed.where("words is not null and doc_id is not null")
    nodes = usable.groupBy("words").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.max("signature").alias("signature"))
    nodes = common.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a number for each, without chance
    places = common.stored(forest(nodes.select("node", "signature"), trees, depth, floor), "places")
    several = places.groupBy(f"run_{floor}").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    met = places.join(several, f"run_{floor}", "left_semi").select("node").distinct()
    wanted = common.stored(nodes.join(met, "node", "left_semi").select(F.col("first_id").alias("doc_id"), "node", "words"), "met")
    wanted = F.broadcast(wanted) if wanted.count() <= NEAR else wanted
    sets = texts.join(wanted, "doc_id").select("text", "node", "words").mapInArrow(_texts_shingles, "node bigint, n_shingles bigint, shingles binary")
    sets = sets.dropDuplicates(["node"]).join(nodes.select("node", "signature").join(wanted.select("node"), "node"), "node")
    sets = common.stored(sets, "sets")
    places = common.stored(places.join(sets.select("node", "n_shingles"), "node"), "sized-places")  # nodes that meet none go

    links = None
    for d in range(depth, floor - 1, -1):
        runs = runs_at(places, d, depth)
        members = places.select("node", F.col(f"run_{d}").alias("run")).join(runs, "run")  # a place is in one run, so no row more
        placed = in_blocks(members, block, block_rows)
        units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("run", "tree", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
        units = common.stored(units, "units")
        units = F.broadcast(units) if units.count() <= NEAR else units
        units = units.join(sets.select("node", "signature", "shingles"), "node")
        compare, schema = _compare(trees, d, depth, least)
        found = common.stored(units.repartition(common.n_partitions(spark), "run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(compare, schema), "links")
        links = found if links is None else links.unionByName(found)
        reached = links.agg(F.sum("n_links").alias("n"), F.sum(f"weight_{d}").alias("w")).first()
        if d == floor or (reached.n or 0) >= recall * (reached.w or 0) and (reached.n or 0) >= SURE:
            break
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(links.where("tie <> node").select(F.col("node").alias("a"), F.col("tie").alias("b")))
    firsts = roots.join(nodes.select("node", "first_id"), "node")
    classes = firsts.join(firsts.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("node", "root", "class_id")
    known = nodes.join(classes, "node", "left").join(counts, "node", "left").select("words", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    known = common.stored(known, "classes")
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("words")).alias("words"))
    return rows.join(known, "words", "left").select("doc_id", "words", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(common.read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = shared_words()
    for batch in common.slices(batches, "text"):
        value = [word_hashes(t, words) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("row"), pa.array([_node_hash(v) if v.size else None for v in value], pa.binary())], ["row", "words"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, one of the least doc_id.

    Rows are told apart by their words, so another text of the same id stays. Rows without words or an id are
    classes of their own and stay, all of them.
    """
    common.ship(spark)
    numbered = common.stored(docs.select(F.struct("*").alias("doc")).withColumn("row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select("row", F.coalesce("doc.doc_id", F.lit(None)).cast("bigint").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    classes = jaccard_links(docs).where("root is not null").select("words", "root").distinct()
    hashed = texts.where("doc_id is not null").select("row", "text").mapInArrow(_with_words, "row bigint, words binary").where("words is not null")
    owned = common.stored(hashed.join(classes, "words").join(texts.select("row", "doc_id"), "row").select("row", "root", "doc_id"), "owned")
    stay = owned.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    gone = common.sent_if_small(common.stored(owned.select("row").join(stay, "row", "left_anti"), "gone"))
    return numbered.join(gone, "row", "left_anti").select("doc.*")
