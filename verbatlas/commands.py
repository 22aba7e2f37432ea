"""Commands: vocab, datagen, benchmark and loadtest. Each prints one line of JSON or writes what it makes."""

from __future__ import annotations

import argparse
import json
import math
import random
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.error import URLError
from urllib.request import urlopen

from pyspark.sql import SparkSession

from verbatlas.config import IndexConfig
from verbatlas.plans.search_index import SearchIndex
from verbatlas.service import search_url
from verbatlas.sources import documents, workload


def latencies(seconds: Sequence[float]) -> dict[str, float]:
    """Count, mean and nearest-rank percentiles in milliseconds."""
    row = sorted(seconds)
    at = lambda share: row[max(0, math.ceil(share * len(row)) - 1)]
    ms = {"mean": sum(row) / len(row), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "longest": row[-1]}
    return {"n": len(row), **{k: round(v * 1e3, 3) for k, v in ms.items()}}


def _words(spark: SparkSession, path: str) -> list[str]:
    """A benchmark's vocabulary: its queries are drawn from it here."""
    return [r.term for r in documents.read_vocabulary(spark, path).collect()]


def vocab(spark: SparkSession, a: argparse.Namespace) -> None:
    words = workload.vocabulary(a.size, a.seed)
    documents.write_vocabulary(spark.createDataFrame([(w,) for w in words], "term string"), a.out)


def datagen(spark: SparkSession, a: argparse.Namespace) -> None:
    workload.documents(spark, _words(spark, a.vocab), a.count, a.seed).write.mode("overwrite").json(a.out)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    """Builds an index, then times single queries in four modes, one at a time, results fetched."""
    words, docs = _words(spark, a.vocab), spark.read.json(a.data)
    began = time.perf_counter()
    index = SearchIndex.build(docs, IndexConfig(("title", "tags"), ("year",)))
    built, modes = time.perf_counter() - began, {}
    for kind, made in (("single", workload.single_queries), ("multi", workload.multi_queries)):
        for name, filters in ((kind, [None] * a.queries), (f"{kind}, filtered", workload.year_filters(a.queries, a.seed))):
            took = []
            for query, wanted in zip(made(words, a.queries, a.seed), filters):
                began = time.perf_counter()
                if (hits := index.search(query, wanted)) is not None:
                    hits.collect()
                took.append(time.perf_counter() - began)
            modes[name] = latencies(took)
    print(json.dumps({"documents": index.total_docs(), "build_seconds": round(built, 3), "modes": modes}))


def loadtest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sends searches to a running service from several threads; other answers than 2xx are errors."""
    rng, words, asked = random.Random(a.seed), _words(spark, a.vocab), []
    for _ in range(a.requests):
        several, filtered = rng.random() * 100 < a.multi_pct, rng.random() * 100 < a.filter_pct
        made = workload.multi_queries if several else workload.single_queries
        seed = rng.randrange(1 << 30)
        wanted = workload.year_filters(1, seed)[0] if filtered else None
        asked.append((f"{'multi' if several else 'single'}{', filtered' if filtered else ''}", search_url(a.url.removesuffix("/search"), a.index, made(words, 1, seed)[0], wanted)))

    def send(one: tuple[str, str]) -> tuple[str, float, bool]:
        began = time.perf_counter()
        try:
            with urlopen(one[1], timeout=a.timeout) as answer:
                answer.read()
            fine = True
        except (URLError, OSError):
            fine = False
        return one[0], time.perf_counter() - began, fine

    began = time.perf_counter()
    with ThreadPoolExecutor(a.workers) as pool:
        found = list(pool.map(send, asked))
    spent = time.perf_counter() - began
    modes = {m: latencies([s for name, s, _ in found if name == m]) for m in sorted({name for name, _, _ in found})}
    print(json.dumps({"requests": len(found), "errors": sum(not fine for *_, fine in found), "requests_a_second": round(len(found) / spent, 1), "all": latencies([s for _, s, _ in found]), "modes": modes}))


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="verbatlas")
    commands = parser.add_subparsers(dest="command", required=True)
    made = {}
    for run, numbers, texts in (
        (vocab, {"size": 100_000}, {"out": "vocab.txt"}),
        (datagen, {"count": 1_000_000}, {"vocab": "vocab.txt", "out": "data.json"}),
        (benchmark, {"queries": 100}, {"data": "data.json", "vocab": "vocab.txt"}),
        (loadtest, {"requests": 1000, "workers": 8, "timeout": 10, "filter-pct": 50, "multi-pct": 50}, {"url": "http://localhost:8080/search", "index": "bench", "vocab": "vocab.txt"}),
    ):
        made[run] = commands.add_parser(run.__name__, help=(run.__doc__ or "").split(".")[0])
        for name, value in {"seed": 42, **numbers}.items():
            made[run].add_argument(f"--{name}", type=int, default=value)
        for name, value in texts.items():
            made[run].add_argument(f"--{name}", default=value)
        made[run].set_defaults(run=run)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = _parser().parse_args(argv)
    asked.run(spark or SparkSession.builder.appName("verbatlas").getOrCreate(), asked)


if __name__ == "__main__":
    main()
