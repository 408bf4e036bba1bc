"""The store's operations as functions from JSON-like arguments to JSON-like answers, by their tool names, each call written down."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.access import CallLog, safe_path
from tarn.operators import graph, scan, search
from tarn.sources.store import ContextStore

DETAILS = ("metadata", "summary", "full")


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


class Api:
    """Answers hold what one response can: limited lists, hits, one entry. ``subtree`` and ``edges`` can be large and come as frames with ``frames=True``."""

    def __init__(self, store: ContextStore, log: CallLog | None = None):
        self.store, self.log = store, log or CallLog()

    def call(self, tool: str, **arguments):
        if tool.startswith("_") or tool in ("call", "store", "log") or not hasattr(self, tool):
            raise KeyError(tool)
        return self.log.record(tool, getattr(self, tool), **arguments)

    # documents

    def store_context(self, content: str, collection: str = "", content_type: str = "", metadata: dict | None = None) -> dict:
        rows = self.store.spark.createDataFrame([(content, collection, content_type, metadata or {})], "content string, collection string, content_type string, metadata map<string,string>")
        return {"id": self.store.put(rows).first()["id"]}

    def get_context(self, id: str, detail: str = "summary") -> dict:
        return self.store.get(id, detail)

    def delete_context(self, id: str) -> dict:
        self.store.delete([id])
        return {"deleted": id}

    def list_contexts(self, collection: str = "", limit: int = 100) -> dict:
        return {"entries": _rows(scan.newest_first(self.store.entries(), limit, collection))}

    def list_collections(self) -> dict:
        return {"collections": [r["collection"] for r in scan.collections(self.store.entries()).collect()]}

    def delete_collection(self, name: str) -> dict:
        return {"deleted": self.store.delete_collection(name)}

    def compact_collection(self, name: str = "") -> dict:
        self.store.compact()
        return {"accepted": True}

    def get_stats(self) -> dict:
        return self.store.stats()

    def health(self) -> dict:
        return {"status": "ok"}

    # search

    def _found(self, hits: DataFrame) -> dict:
        rows = _rows(hits)
        for r in rows:
            if "entry" in r:
                r["entry"] = json.loads(r["entry"])
        sums = {f"total_{k}": sum(r[k] for r in rows) for k in ("token_count", "compact_token_count", "tokens_saved")}
        return {"hits": rows or None, "total_tokens": sums["total_token_count"], "total_compact_tokens": sums["total_compact_token_count"], "total_tokens_saved": sums["total_tokens_saved"]}

    def search_context(self, query: str, collection: str = "", filters: dict | None = None, top_k: int = 10, detail: str = "") -> dict:
        return self._found(self.store.search(query, top_k, filters, collection, detail))

    def graph_search(self, focus_node_id: str, query: str = "", collection: str = "", filters: dict | None = None, top_k: int = 10, detail: str = "", max_depth: int = 0) -> dict:
        return self._found(self.store.search(query, top_k, filters, collection, detail, focus_node_id, max_depth))

    def suggest_links(self, node_id: str, threshold: float = 0.7, top_k: int = 10) -> dict:
        return {"suggestions": _rows(self.store.suggest_links(node_id, threshold, top_k))}

    # graph

    def link_context(self, from_id: str, to_id: str, label: str = "", weight: float = 0.0, source: str = "user", metadata: dict | None = None) -> dict:
        schema = "from_id string, to_id string, label string, weight double, source string, metadata map<string,string>"
        return {"edge_id": self.store.put_edges(self.store.spark.createDataFrame([(from_id, to_id, label, float(weight), source, metadata or {})], schema)).first()["id"]}

    def unlink_context(self, id: str) -> dict:
        self.store.delete_edge(id)
        return {"deleted": id}

    def get_edge(self, id: str) -> dict:
        return self.store.edge(id)

    def list_edges(self, from_id: str = "", to_id: str = "") -> dict:
        return {"edges": _rows(graph.edges_of(self.store.edges(), from_id, to_id))}

    def get_neighbors(self, node_id: str, depth: int = 1) -> dict:
        near = graph.neighbourhood(self.store.edges(), node_id, depth)
        return {"neighbors": [{"ID": r["id"], "Score": r["score"]} for r in near.collect()]}

    def get_subtree(self, root: str, depth: int = 0, frames: bool = False) -> dict:
        edges = graph.subtree(self.store.edges(), root, depth)
        return {"root": root, "edges": edges if frames else _rows(edges)}

    def graph_overview(self, collection: str = "", limit: int = 500, frames: bool = False) -> dict:
        found = self.store.overview(collection, limit)
        return found if frames else found | {"edges": _rows(found["edges"])}

    # operations

    def storage_diagnostics(self) -> dict:
        return self.store.diagnostics()

    def audit_calls(self, limit: int = 100) -> dict:
        return {"calls": self.log.newest(limit if limit <= 500 else 100)}

    def stress(self, writes: int, searches: int, queries: tuple[str, ...], top_k: int = 10) -> dict:
        """Stores ``writes`` bodies and makes ``searches`` searches in turn; the report of both phases."""
        import time

        spark, report = self.store.spark, {}
        writes, searches = min(writes, 50_000), min(searches, 500_000)
        phases = {"write": (writes, lambda i: self.store_context(f"Note {i} on retrieval: counters make each body its own.", "stress")), "search": (searches, lambda i: self.search_context(queries[i % len(queries)], "stress", top_k=top_k))}
        for name, (n, run) in phases.items():
            took, began = [], time.time()
            for i in range(n):
                t = time.time()
                try:
                    run(i)
                    ok = True
                except Exception:  # counted as an error of the load, as its report has it
                    ok = False
                took.append(((time.time() - t) * 1000, ok))
            calls = spark.createDataFrame(took, "ms double, ok boolean")
            report[name] = scan.latency_report(calls, wall_seconds=max(time.time() - began, 1e-9)).first().asDict()
        return report

    def tree(self, path: str = "") -> dict:
        """Names and sizes below a folder of the store."""
        p = self.store.spark._jvm.org.apache.hadoop.fs.Path(safe_path(self.store.path, path))
        fs = p.getFileSystem(self.store.spark._jsc.hadoopConfiguration())
        return {"files": sorted(({"name": f.getPath().getName(), "bytes": f.getLen(), "folder": f.isDirectory()} for f in fs.listStatus(p)), key=lambda f: f["name"])}

    def read_file(self, path: str, most: int = 65_536) -> dict:
        """The first bytes of a text file of the store."""
        rows = self.store.spark.read.text(safe_path(self.store.path, path), wholetext=True).select(F.substring("value", 1, most).alias("t"))
        return {"text": rows.first()["t"]}
