"""The engine's requests by path: a plain function, and a small server of it for one machine.

Answers are JSON and hold one page of rows at most, which is what is collected;
where there can be more, the answer tells how many there are and takes an offset.
Intermediate tables of a request go when it is answered.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from functools import wraps
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.errors import EngineError, InvalidArgument, NotFound, envelope
from brindle.operators import graph, knowledge, store
from brindle.shared import scope

LOG = logging.getLogger(__name__)
#: Rows of one answer.
MOST = 1000


def rows(d: DataFrame, most: int = MOST) -> list[dict]:
    return [json.loads(x) for x in d.limit(most).toJSON().collect()]


class Monitor:
    """Calls and failures of each operation and the time they took; a decorator counts them."""

    def __init__(self):
        self.calls: dict[str, list[float]] = {}

    def counted(self, name: str):
        def around(f: Callable) -> Callable:
            @wraps(f)
            def call(*a, **k):
                began, entry = time.monotonic(), self.calls.setdefault(name, [0, 0, 0.0])
                entry[0] += 1
                try:
                    return f(*a, **k)
                except Exception:
                    entry[1] += 1
                    raise
                finally:
                    entry[2] += time.monotonic() - began

            return call

        return around

    def lines(self, prefix: str = "brindle") -> list[str]:
        out = []
        for name, (n, bad, took) in sorted(self.calls.items()):
            out += [f'{prefix}_calls_total{{op="{name}"}} {n:.0f}', f'{prefix}_failures_total{{op="{name}"}} {bad:.0f}', f'{prefix}_seconds_total{{op="{name}"}} {took:.4f}']
        return out


class Service:
    """``handle(path, params)`` gives a status and a body; every failure is an envelope."""

    def __init__(self, engine: Engine, ontology: DataFrame | None = None):
        self.engine, self.ontology, self.monitor = engine, ontology, Monitor()
        self.routes = {
            "/health": self.health, "/stats": lambda p: self.engine.stats(), "/metrics": lambda p: self.monitor.lines(), "/documents": self.documents, "/documents/delete": self.delete, "/ingest": self.ingest,
            "/search": self.search, "/search/reranked": lambda p: rows(self.engine.reranked(self.need(p, "q"))), "/detect-domain": self.domain, "/graph/traverse": self.traverse, "/graph/entity": self.entity, "/graph/edges": self.edges,
            "/graph/communities": self.communities, "/graph/communities/detail": self.community,
        }

    @staticmethod
    def need(params: dict, name: str) -> str:
        if not params.get(name):
            raise InvalidArgument(f"{name} is required", field=name)
        return params[name]

    @staticmethod
    def number(params: dict, name: str, default: int, least: int = 1, most: int = MOST) -> int:
        try:
            n = int(params.get(name, default))
        except ValueError:
            raise InvalidArgument(f"{name} must be a number", field=name) from None
        if not least <= n <= most:
            raise InvalidArgument(f"{name} must lie in {least}..{most}", field=name)
        return n

    def handle(self, path: str, params: dict | None = None) -> tuple[int, object]:
        try:
            if path not in self.routes:
                raise NotFound(f"no such path: {path}")
            with scope(self.engine.spark):
                return 200, self.monitor.counted(path)(self.routes[path])(params or {})
        except Exception as e:  # every failure is told to the caller in one form
            if not isinstance(e, EngineError):
                LOG.exception("request %s failed", path)
            body = envelope(e)
            return body["error"]["code"], body

    def health(self, params: dict) -> dict:
        """Whether the session answers and which tables can be read."""
        up = {}
        for name, d in sorted(self.engine.tables.items()):
            try:
                up[name] = bool(d.schema)
            except Exception:  # a table that is gone is told as such
                up[name] = False
        return {"status": "ok" if all(up.values()) and self.engine.spark.range(1).count() == 1 else "degraded", "tables": up}

    def documents(self, params: dict) -> object:
        d = self.engine.tables["documents"]
        if params.get("id"):
            found = rows(d.where(F.col("document_id") == params["id"]), 1)
            if not found:
                raise NotFound(f"no such document: {params['id']}")
            return found[0]
        d = d.where(F.col("domain") == params["domain"]) if params.get("domain") else d
        return rows(store.page(d.drop("text"), ["document_id"], self.number(params, "offset", 0, 0, 1 << 40), self.number(params, "limit", 100)))

    def delete(self, params: dict) -> dict:
        key = self.documents({"id": self.need(params, "id")})["document_id"]
        self.engine.delete_document(key)
        return {"deleted": key}

    def ingest(self, params: dict) -> dict:
        failed = self.engine.ingest(self.need(params, "folder"), params.get("processed", ""))
        return {**self.paged("failed", failed, ["path"], params), "stats": self.engine.stats()}

    def search(self, params: dict) -> list[dict]:
        return rows(self.engine.search(self.need(params, "q"), params.get("mode", "hybrid"), self.number(params, "limit", 10, 1, 100)))

    def domain(self, params: dict) -> list[dict]:
        if self.ontology is None:
            raise NotFound("no ontology is loaded")
        d = self.engine.spark.createDataFrame([(0, self.need(params, "text"))], "doc_id int, text string")
        return rows(knowledge.domain_scores(d, self.ontology).drop("id").orderBy("rank"))

    def traverse(self, params: dict) -> dict:
        nodes, edges = self.engine.traverse(self.need(params, "start"), self.number(params, "depth", 2, 1, 5), limit=self.number(params, "limit", 100))
        return {"nodes": rows(nodes), **self.paged("edges", edges, ["src", "dst", "relation_type"], params)}

    def entity(self, params: dict) -> dict:
        entity, relations = self.engine.entity(self.need(params, "id"), self.number(params, "limit", 100))
        found = rows(entity, 1)
        if not found:
            raise NotFound(f"no such entity: {params['id']}")
        return {"entity": found[0], "relations": rows(relations)}

    def paged(self, name: str, d: DataFrame, order: list[str], params: dict) -> dict:
        """A page of rows under ``name``, from ``offset`` on, and how many there are in all."""
        return {name: rows(store.page(d, order, self.number(params, "offset", 0, 0, 1 << 40), MOST)), f"{name}_total": d.count()}

    def communities(self, params: dict) -> dict:
        """Communities of at least ``min_entities``, the largest first, with their summaries."""
        e = self.engine.tables["entities"].where("community is not null")
        sizes = e.groupBy("community").agg(F.count(F.lit(1)).alias("entity_count")).where(F.col("entity_count") >= self.number(params, "min_entities", 2))
        d = sizes.join(knowledge.summaries(e), "community").withColumnRenamed("community", "community_id").withColumn("_last", -F.col("entity_count"))
        return self.paged("communities", d, ["_last", "community_id"], params)

    def community(self, params: dict) -> dict:
        """One community's summary and members."""
        key = self.need(params, "id")
        e = self.engine.tables["entities"].where(F.col("community") == key)
        found = rows(knowledge.summaries(e), 1)
        if not found:
            raise NotFound(f"no such community: {key}")
        return {"community_id": key, "summary": found[0]["summary"], **self.paged("members", e.select("id", "name", "entity_type"), ["id"], params)}

    def edges(self, params: dict) -> list[dict]:
        return rows(graph.edge_scan(self.engine.tables["relations"], self.number(params, "limit", 500)))


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the service's paths, to be started by ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            at = urlsplit(self.path)
            code, body = service.handle(at.path, {k: v[-1] for k, v in parse_qs(at.query).items()})
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_POST = do_GET

        def log_message(self, *a) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
