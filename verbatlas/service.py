"""Named indexes behind requests: SearchService answers (status, payload), serve() puts it on a port."""

from __future__ import annotations

import csv
import io
import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.config import IndexConfig
from verbatlas.functions.text import parse_filter
from verbatlas.plans.search_index import SearchIndex
from verbatlas.sources import documents, snapshot

Answer = tuple[int, dict | str]  # a string is plain text
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def duration_text(seconds: float) -> str:
    for unit, size in (("s", 1.0), ("ms", 1e-3), ("µs", 1e-6)):
        if seconds >= size:
            return f"{seconds / size:.6g}{unit}"
    return f"{int(seconds * 1e9)}ns"


def search_url(base: str, index: str, query: str, wanted: dict[str, list[str]] | None = None) -> str:
    pairs = {"index": index, "q": query}
    if wanted:
        pairs["filter"] = ",".join(f"{k}:{v}" for k, vs in wanted.items() for v in vs)
    return f"{base}/search?{urlencode(pairs)}"


class SearchService:
    def __init__(self, spark: SparkSession, data_dir: str = "./data"):
        self.spark, self.data_dir = spark, data_dir.rstrip("/")
        self.indexes: dict[str, SearchIndex] = {}
        self.lock = threading.Lock()  # of changes; readers take the generation they find

    def handle(self, method: str, path: str, query: dict[str, str] | None = None, body: bytes = b"", file: bytes | None = None) -> Answer:
        """One request; file: the uploaded part of a multipart body, None if there is none."""
        q, began = query or {}, time.perf_counter()
        route = {"/create-index": ("POST", self._create), "/search": ("GET", self._search), "/add-to-index": ("POST", self._add), "/save-controller": ("POST", self._save), "/load-controller": ("POST", self._load), "/health": ("GET", self._health)}.get(path)
        if path == "/document":
            route = {"POST": ("POST", self._upsert), "DELETE": ("DELETE", self._delete)}.get(method)
            if route is None:
                return 405, "method not allowed\n"
        if route is None:
            return 404, {"err": "not found"}
        if route[0] != method:
            return 405, {"err": "method not allowed"}
        try:
            return route[1](q, body, file, began)
        except _Refused as e:
            return e.status, {"err": str(e)}
        except Exception as e:
            return 500, {"err": str(e)}

    # --- routes ---

    def _create(self, q, body, file, began) -> Answer:
        asked = _json(body)
        name = asked.get("indexName") or ""
        if not name:
            raise _Refused(400, "indexName is required")
        k = asked.get("resultCount") or asked.get("resultSize") or 0
        wanted = asked.get("filters") or []
        config = IndexConfig(tuple(asked.get("indexFields") or ()), tuple(n for n in wanted if not isinstance(wanted, dict) or wanted[n]), k if k > 0 else 100)
        with self.lock:
            if name in self.indexes:
                raise _Refused(409, f"index {name} exists")
            self.indexes[name] = SearchIndex.empty(self.spark, config)
        return 201, {"indexName": name, "resultCount": config.k, "duration": duration_text(time.perf_counter() - began)}

    def _search(self, q, body, file, began) -> Answer:
        index = self._named(q.get("index"))
        hits = index.search(q.get("q", ""), parse_filter(q.get("filter")))
        response = None if hits is None else {"Docs": _docs(hits) or None}
        spent = time.perf_counter() - began
        return 200, {"status": "success", "statusCode": 200, "index": q["index"], "query": q.get("q", ""), "response": response, "duration": int(spent * 1e9), "durationInMs": spent * 1e3}

    def _add(self, q, body, file, began) -> Answer:
        name = q.get("indexName")
        index = self._named(name)
        if file is None:
            raise _Refused(400, "file is required")
        docs = _uploaded(self.spark, file)
        with self.lock:
            if docs:
                index = self.indexes[name].add(self._frame(docs), order=["position"])
                self.indexes[name] = index
        spent = time.perf_counter() - began
        return 200, {"indexName": name, "addedCount": len(docs), "duration": duration_text(spent), "durationMs": spent * 1e3, "totalDocs": index.total_docs()}

    def _upsert(self, q, body, file, began) -> Answer:
        asked = _json(body)
        name = q.get("indexName") or asked.get("indexName")
        self._named(name)
        doc = asked.get("document")
        if not isinstance(doc, dict):
            raise _Refused(400, "document is required")
        if doc.get("id") in (None, "", "<nil>"):
            raise _Refused(400, "document id is required")
        with self.lock:
            index = self.indexes[name] = self.indexes[name].add(self._frame([doc]), tokenless=True)
        spent = time.perf_counter() - began
        return 200, {"status": "success", "statusCode": 200, "indexName": name, "id": str(doc["id"]), "duration": duration_text(spent), "durationMs": spent * 1e3, "totalDocs": index.total_docs()}

    def _delete(self, q, body, file, began) -> Answer:
        name, i = q.get("indexName"), q.get("id")
        self._named(name)
        if not i:
            raise _Refused(400, "id is required")
        with self.lock:
            self.indexes[name], deleted = self.indexes[name].delete(i)
        spent = time.perf_counter() - began
        return 200, {"status": "success", "statusCode": 200, "indexName": name, "id": i, "deleted": deleted, "duration": duration_text(spent), "durationMs": spent * 1e3}

    def _save(self, q, body, file, began) -> Answer:
        name = _json(body).get("indexName")
        snapshot.save(self._named(name), self._path(name))
        return 200, {"status": "success", "statusCode": 200, "indexName": name}

    def _load(self, q, body, file, began) -> Answer:
        name = _json(body).get("indexName")
        if not name:
            raise _Refused(400, "indexName is required")
        index = snapshot.load(self.spark, self._path(name))
        with self.lock:
            self.indexes[name] = index
        spent = time.perf_counter() - began
        return 200, {"status": "success", "statusCode": 200, "indexName": name, "duration": duration_text(spent), "durationMs": spent * 1e3}

    def _health(self, q, body, file, began) -> Answer:
        spent = time.perf_counter() - began
        return 200, {"status": "ok", "duration": duration_text(spent), "durationMs": spent * 1e3}

    # --- parts ---

    def _named(self, name: str | None) -> SearchIndex:
        if not name:
            raise _Refused(400, "index name is required")
        if name not in self.indexes:
            raise _Refused(404, f"no index {name}")
        return self.indexes[name]

    def _path(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise _Refused(400, "an index name is letters, digits, dots, dashes")
        return f"{self.data_dir}/{name}"

    def _frame(self, docs: list[dict]) -> DataFrame:
        return documents.from_rows(self.spark, docs)


class _Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _json(body: bytes) -> dict:
    try:
        found = json.loads(body)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        raise _Refused(400, "invalid JSON")
    return found


def _uploaded(spark: SparkSession, data: bytes) -> list[dict]:
    """A JSON array of objects, else CSV with a header and a row at least."""
    text = data.decode("utf-8", "replace")
    try:
        return documents.from_json_text(spark, text)
    except ValueError:
        pass
    try:
        rows = list(csv.reader(io.StringIO(text), strict=True))
    except csv.Error as e:
        raise _Refused(400, f"neither JSON nor CSV: {e}") from e
    if len(rows) < 2 or any(len(r) != len(rows[0]) for r in rows):
        raise _Refused(400, "neither a JSON array nor a CSV file")
    return [dict(zip(rows[0], r)) for r in rows[1:]]


def _docs(hits: DataFrame) -> list[dict]:
    """Hits, k at most, as ID, Data and Score."""
    own = [c for c in hits.columns if c not in ("rank", "internal_id", "score", "external_id", "position")]
    data = F.to_json(F.struct(*(F.col(f"`{c}`") for c in own))) if own else F.lit("{}")
    return [{"ID": r.external_id, "Data": json.loads(r.data), "Score": r.score} for r in hits.select("rank", "external_id", "score", data.alias("data")).orderBy("rank").collect()]


def _file_part(kind: str, body: bytes) -> bytes | None:
    mark = re.search(r'boundary="?([^";]+)', kind or "")
    for part in body.split(b"--" + mark[1].encode())[1:] if mark else []:
        head, _, data = part.partition(b"\r\n\r\n")
        if b'name="file"' in head:
            return data.removesuffix(b"\r\n")
    return None


def serve(service: SearchService, port: int = 8080) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self):
            at = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            query = {k: v[0] for k, v in parse_qs(at.query, keep_blank_values=True).items()}
            status, payload = service.handle(self.command, at.path, query, body, _file_part(self.headers.get("Content-Type", ""), body))
            plain = isinstance(payload, str)
            data = payload.encode() if plain else json.dumps(payload).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if plain else "application/json")
            if plain:
                self.send_header("Allow", "POST, DELETE")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = do_PUT = _any

        def log_message(self, *a):
            pass

    return ThreadingHTTPServer(("", port), Handler)
