"""The index as one object: inserts, deletes, searches, statistics, snapshots and compaction over a store folder."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CHANGES, Config, check_filter, dim_violations, tagged
from .operators import exact, filters, graph, routing, store
from .operators.store import DELETE, INSERT, Store
from .shipping import ready


class VectorIndex:
    """Batch-first: every mutation appends one group of changes, every search is one job."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.store = ready(spark), Store(spark, path)
        now = self.store.current()
        self.config = config or (Config(**now["config"]) if now and now.get("config") else Config())
        self.cache, self.escalations = filters.FilterCache(), 0

    # mutation

    def _append(self, rows: list[tuple]) -> None:
        """One batch under a number of its own: what a later number says of a node holds."""
        n = self.store.reserve()
        changes = [((n << 32) + i, *r) for i, r in enumerate(rows)]
        self.store.append(self.spark.createDataFrame(changes, CHANGES), n)

    def rows(self) -> DataFrame:
        return self.store.rows()

    def insert(self, node_id: int, vector, metadata: dict | None = None) -> None:
        self.batch_insert([vector], [node_id], [metadata])

    def batch_insert(self, vectors, node_ids: list[int] | None = None, metadatas: list | None = None) -> list[int]:
        """Whole or not at all.  Without ids they follow the largest; a live id, another dimension or a non-finite number fails."""
        vectors = [[float(x) for x in v] for v in vectors]
        if not vectors:
            return []
        live = self.rows()
        if node_ids is None:
            top = live.agg(F.max("node_id")).first()[0]
            node_ids = list(range(0 if top is None else top + 1, (0 if top is None else top + 1) + len(vectors)))
        node_ids = [int(i) for i in node_ids]
        if len(node_ids) != len(vectors) or len(set(node_ids)) != len(node_ids):
            raise ValueError("ids must be as many as vectors, and distinct")
        given = self.spark.createDataFrame([(i,) for i in node_ids], "node_id long")
        if taken := live.join(given, "node_id", "left_semi").select("node_id").limit(5).collect():
            raise ValueError(f"ids exist already: {[r[0] for r in taken]}")
        known = live.select(F.size("embedding")).limit(1).collect()
        dim = known[0][0] if known else len(vectors[0])
        if any(len(v) != dim for v in vectors):
            raise ValueError(f"vectors must have {dim} dimensions")
        if any(x != x or abs(x) == float("inf") for v in vectors for x in v):
            raise ValueError("vectors must be finite")
        metas = [*(metadatas or []), *[None] * len(vectors)][: len(vectors)]
        self._append([(INSERT, i, v, None if m is None else {k: t for k, x in m.items() if (t := tagged(x)) is not None}) for i, v, m in zip(node_ids, vectors, metas)])
        return node_ids

    def insert_frame(self, df: DataFrame) -> None:
        """Rows (node_id, embedding, and metadata as a map of kinds or none) as one batch, whole or not at all; nothing passes through the driver."""
        n, live = self.store.reserve(), self.rows()
        metadata = F.col("metadata") if "metadata" in df.columns else F.lit(None)
        rows = df.select(F.lit(n << 32).cast("long").alias("seq"), F.lit(INSERT).alias("op"), F.col("node_id").cast("long").alias("node_id"), F.col("embedding").cast("array<float>").alias("embedding"), metadata.cast("map<string,string>").alias("metadata"))
        sizes = rows.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("ids")).first()
        if not sizes["n"]:
            return
        known = live.select(F.size("embedding")).limit(1).collect()
        if sizes["ids"] != sizes["n"] or not rows.join(live.select("node_id"), "node_id", "left_semi").isEmpty():
            raise ValueError("ids must be distinct and new")
        dim = known[0][0] if known else sizes["most"]
        if sizes["least"] != sizes["most"] or not dim_violations(rows, dim).isEmpty():
            raise ValueError(f"vectors must be finite and have {dim} dimensions")
        self.store.append(rows, n)

    def delete(self, node_id: int) -> None:
        """Nothing happens if the id is absent."""
        if not self.rows().where(F.col("node_id") == int(node_id)).isEmpty():
            self._append([(DELETE, int(node_id), None, None)])

    # search

    def search(self, query, k: int = 10, ef: int | None = None, filter: dict | None = None, approximate: bool = False) -> list[tuple[int, float, dict | None]]:
        return self.batch_search([query], k, ef, filter, approximate=approximate)[0]

    def batch_search(self, queries, k: int = 10, ef: int | None = None, filter: dict | None = None, filters_: list | None = None, approximate: bool = False, return_visited: bool = False):
        """Hits (id, distance, metadata) of each query, in order.  ``filters_[i]`` replaces ``filter`` for query i; None there means no filter.

        Exact, or with ``approximate`` by way of ``search_frame``, with ``ef`` as the width of the beam.  With ``return_visited``, also the number of rows scored a query
        (of the graph route; exact searches score every row that passes).
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        queries = [[float(x) for x in q] for q in queries]
        live = self.rows()
        known = live.select(F.size("embedding")).limit(1).collect()
        if not known:
            return ([[] for _ in queries], [0] * len(queries)) if return_visited else [[] for _ in queries]
        if any(len(q) != known[0][0] for q in queries):
            raise ValueError(f"queries must have {known[0][0]} dimensions")
        specs = [check_filter(x) for x in (filters_ or [])[: len(queries)]]
        specs += [check_filter(filter)] * (len(queries) - len(specs))
        rows = [(i, q, {f: tagged(v) for f, v in s.items()} or None) for i, (q, s) in enumerate(zip(queries, specs))]
        q = self.spark.createDataFrame(rows, "query_id long, query array<float>, asked map<string,string>")
        same = specs[0] if specs and all(s == specs[0] for s in specs) else None
        if approximate and same is not None:
            hits = self.search_frame(q.drop("asked"), k, ef, same or None)
        elif same is not None:  # one filter: its rows are kept for the next search
            kept = self.cache.get(live, same, self._version()) if same else live
            hits = exact.knn(kept, q.drop("asked"), k, self.config.metric)
        else:
            hits = exact.knn(live, q, k, self.config.metric, None, filters.per_query(F.col("asked"), F.col("metadata")))
        out: list[list[tuple]] = [[] for _ in queries]
        for r in hits.join(live.select("node_id", "metadata"), "node_id").orderBy("query_id", "rank").collect():
            out[r["query_id"]].append((r["node_id"], r["distance"], r["metadata"]))
        if not return_visited:
            return out
        match = filters.per_query(F.col("asked"), F.col("metadata"))
        scored = {r["query_id"]: r["count"] for r in live.join(F.broadcast(q), match).groupBy("query_id").count().collect()}
        scored.update(self._visited if approximate and same is not None else {})
        return out, [scored.get(i, 0) for i in range(len(queries))]

    def _version(self) -> tuple:
        now = self.store.current()
        return now and now["version"], self.store.tip()

    def search_frame(self, queries: DataFrame, k: int = 10, ef: int | None = None, spec: dict | None = None) -> DataFrame:
        """queries(query_id, query): routed hits as a frame.  The approximate route walks the graph of the current version, deleted rows as bridges, and
        looks at all rows that came after it exactly."""
        live, edges, now = self.rows(), self.store.edges(), self.store.current()
        self._visited: dict = {}
        approximate = again = None
        if edges is not None and now.get("entry_point") is not None:
            base, later = self.store.base(now), store.fold(self.store.changes(now["seq"]))
            allowed = filters.where(base, spec).join(later.select("node_id"), "node_id", "left_anti")
            fresh = later.where(F.col("op") == INSERT).select("node_id", "embedding", "metadata")
            ground, width = edges.where("layer = 0").select("src", "dst"), ef or self.config.ef_search

            def approximate(q, k, budget, width=width):
                start = graph.descend(base, edges, q, now["entry_point"], now["max_level"], self.config.metric)
                old = graph._cut(graph.beam_search(base, ground, q, start, k, max(k, width), self.config.metric, budget=budget, allowed=allowed))
                for r in old.groupBy("query_id").agg(F.max("visited").alias("n")).limit(10_000).collect():  # for the statistics of small batches
                    self._visited[r["query_id"]] = r["n"]
                new = exact.knn(fresh, q, k, self.config.metric, spec)
                both = old.select("query_id", "node_id", "distance").union(new.select("query_id", "node_id", "distance"))
                return exact.top_k(both, k)

            def again(q, k, budget):
                return approximate(q, k, budget, max(width, 2 * k))

        def escalated(n: int) -> None:
            self.escalations += n

        return routing.search(live, queries, k, ef or self.config.ef_search, spec, self.config.metric, self.config.filter_fallback_threshold, approximate, escalated, again)

    # state

    def stats(self) -> dict:
        live = self.rows()
        r = live.agg(F.count(F.lit(1)).alias("size"), F.max(F.size("embedding")).alias("dim")).first()
        top = graph.entry_point(graph.levels(live, self.config.M, self.config.seed)).first()
        return {"size": r["size"], "dim": r["dim"], "max_level": -1 if top["max_level"] is None else top["max_level"], "entry_point": top["entry_point"], "config": asdict(self.config)}

    def save_snapshot(self, with_graph: bool = False) -> dict:
        live = self.rows()
        edges = graph.build(live, self.config.M, self.config.ef_construction, self.config.metric, self.config.heuristic, self.config.keep_pruned_connections, self.config.seed) if with_graph else None
        top = graph.entry_point(graph.levels(live, self.config.M, self.config.seed)).first()
        return self.store.snapshot(asdict(self.config), edges, extra={"entry_point": top["entry_point"], "max_level": top["max_level"]})

    def compact(self) -> dict:
        """A new version without deleted rows; later changes start from it, and changes and versions before the one before it go."""
        self.cache.clear()
        new = self.save_snapshot(self.store.edges() is not None)
        self.store.truncate()
        return new

    @classmethod
    def load_snapshot(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path)
