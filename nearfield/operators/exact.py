"""Exact nearest neighbours: as expressions, or in Arrow batches that prune to k before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..functions.distance import distance
from ..shipping import ready
from . import filters

#: a query frame of so many rows at most is broadcast; a larger one is dealt in blocks of so many rows
BROADCAST_ROWS, BLOCK_ROWS = 4096, 1024
#: so many queries at most are scored by expressions
EXPRESSED_ROWS = 32
#: pairs of a block scored together
PAIRS = 1 << 16


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, node_id, distance: the k smallest distances a query, ties to the smaller id (pruned before the shuffle)."""
    order = W.partitionBy("query_id").orderBy("distance", "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def is_small(queries: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return queries.limit(rows + 1).count() <= rows


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", spec: dict | None = None, match: Column | None = None) -> DataFrame:
    """vectors(node_id, embedding, ...), queries(query_id, query): exact hits.

    ``spec`` filters all queries below the join; ``match`` is a condition on both sides.  A few queries are broadcast and scored by expressions; for
    more the kernel gives the same hits and distances, bit for bit, in a small part of the time (it takes no rows without an id; with any, expressions score up to BROADCAST_ROWS queries).  Vectors that are null, hold a null, or have another dimension than the query take no part.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if match is None and not is_small(queries, EXPRESSED_ROWS) and (not is_small(queries) or vectors.where("node_id IS NULL").isEmpty() and queries.where("query_id IS NULL").isEmpty()):
        return knn_arrow(vectors, queries, k, metric, spec)
    q = F.broadcast(queries) if is_small(queries) else queries
    pairs = filters.where(vectors, spec).join(q, F.lit(True) if match is None else match)
    scored = pairs.select("query_id", "node_id", distance(metric)(F.col("query"), F.col("embedding")).alias("distance"))
    return top_k(scored.where("distance IS NOT NULL"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "node_id", "distance")


def _as_expressed(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, bit for bit as the column expressions have them: sums in double, in component order."""

    def total(a, b, term):
        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            s += term(a[:, j].astype(np.float64), b[:, j].astype(np.float64))
        return s

    if metric == "l2":
        return np.sqrt(total(q, v, lambda x, y: (x - y) * (x - y)))
    product = lambda x, y: x * y
    na, nb = np.sqrt(total(q, q, product)), np.sqrt(total(v, v, product))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((na == 0) | (nb == 0), 1.0, 1.0 - total(q, v, product) / (na * nb))


def block_hits(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of v): each query's k smallest by (distance, id) of a block.

    Of equal vectors the k smallest ids take part.  A matrix product in double bounds each distance from both sides; what lies
    above the k-th upper bound is cut, and where more than k are left, they are scored as the expressions do and cut by (distance, id).
    """
    _, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    some = np.sort(order[nth < k])
    a, b = q.astype(np.float64), v[some].astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        na, nb = (np.sqrt((x * x).sum(1)) for x in (a, b))
        if metric == "cosine":
            a, b = (x / np.where(n == 0, 1.0, n)[:, None] for x, n in ((a, na), (b, nb)))
            na, nb = np.ones(len(a)), np.ones(len(b))
        d = -2 * a @ b.T + (0.0 if metric == "cosine" else (b * b).sum(1))  # a zero vector's cosine is 0
        # rounding of the product, of the expression, and of its root: under (n + 8) units each of (|q| + |v|)**2
        slack = 4 * (a.shape[1] + 8) * np.finfo(np.float64).eps * (na[:, None] + nb) ** 2
        low, high = d - slack, d + slack
    if len(some) > k:
        near = ~(low > np.partition(high, k - 1, axis=1)[:, k - 1 : k])  # what is no number stays
    else:
        near = np.ones(d.shape, bool)
    row, col = np.nonzero(near)
    crowded = near.sum(1) > k
    if crowded.any():
        again = crowded[row]
        done = [row[~again]], [col[~again]]
        r, c = row[again], col[again]
        exact = np.concatenate([_as_expressed(q[r[i : i + PAIRS]], v[some[c[i : i + PAIRS]]], metric) for i in range(0, len(r), PAIRS)])
        order = np.lexsort((ids[some[c]], exact, r))
        r, c = r[order], c[order]
        first = np.flatnonzero(np.r_[True, np.diff(r) != 0])
        keep = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)])) < k
        row, col = np.concatenate([*done[0], r[keep]]), np.concatenate([*done[1], c[keep]])
    return row, some[col]


def knn_arrow(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", spec: dict | None = None) -> DataFrame:
    """The same hits from matrix products: queries in blocks, and each task keeps a query's k best by (distance, node_id) over all its vectors."""
    ready(vectors.sparkSession)
    few = is_small(queries)
    dims = sorted(r[0] for r in queries.where("size(query) > 0").select(F.size("query")).distinct().collect()) or [0]

    # single precision only where the rows are: the cut is made in double
    kinds = {c: np.float32 if df.schema[c].dataType.elementType == FloatType() else np.float64 for df, c in ((queries, "query"), (vectors, "embedding"))}

    def packed(df: DataFrame, key: str, value: str, to: str, dim: int) -> DataFrame:
        kind = kinds[value]

        def pack(batches):
            for b in batches:
                for a in range(0, b.num_rows, BLOCK_ROWS):
                    p = b.slice(a, BLOCK_ROWS)
                    x = np.array(p.column(1).to_pylist(), kind)
                    yield pa.record_batch([pa.array([p.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

        return df.where((F.size(value) == dim) & F.forall(value, lambda x: x.isNotNull())).select(F.col(key).cast("long"), value).mapInArrow(pack, "ids binary, x binary").toDF(f"{to}_ids", f"{to}_x")

    def score(batches):
        best: dict = {}  # by block of queries: (row of the block, node_id, distance), k a query at most
        for b in batches:
            for block, qx, vi, vx in zip(*(c.to_pylist() for c in b.columns)):
                qi, vi = np.frombuffer(block, np.int64), np.frombuffer(vi, np.int64)
                q, v = (np.frombuffer(x, kinds[c]).reshape(len(i), -1) for x, i, c in ((qx, qi, "query"), (vx, vi, "embedding")))
                row, col = block_hits(q, v, vi, k, metric)
                away = np.concatenate([np.zeros(0), *(_as_expressed(q[row[i : i + PAIRS]], v[col[i : i + PAIRS]], metric) for i in range(0, len(row), PAIRS))])
                row, node = row.astype(np.int64), vi[col]
                if block in best:
                    row, node, away = (np.concatenate(x) for x in zip(best[block], (row, node, away)))
                order = np.lexsort((node, away, row))
                row, node, away = row[order], node[order], away[order]
                start = np.flatnonzero(np.r_[True, np.diff(row) != 0])[: len(row)]
                keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
                best[block] = row[keep], node[keep], away[keep]
        for block, (row, node, away) in best.items():
            yield pa.record_batch([pa.array(np.frombuffer(block, np.int64)[row]), pa.array(node), pa.array(away)], ["query_id", "node_id", "distance"])

    kept = filters.where(vectors, spec).select("node_id", "embedding")
    near = None
    for dim in dims:  # one, unless the queries differ
        blocks = packed(queries, "query_id", "query", "q", dim)
        pairs = packed(kept, "node_id", "embedding", "v", dim).join(F.broadcast(blocks) if few else blocks, F.lit(True)).select("q_ids", "q_x", "v_ids", "v_x")
        hits = pairs.mapInArrow(score, "query_id long, node_id long, distance double")
        near = hits if near is None else near.union(hits)
    return top_k(near, k).select("query_id", F.col("rank").cast("int").alias("rank"), "node_id", "distance")


def post_filter_knn(vectors: DataFrame, queries: DataFrame, k: int, ef: int, spec: dict, metric: str = "l2") -> DataFrame:
    """The baseline that searches ``ef`` rows first and filters what it found."""
    hits = knn(vectors, queries, ef, metric)
    ok = filters.where(vectors, spec).select("node_id")
    return top_k(hits.drop("rank").join(ok, "node_id"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "node_id", "distance")


class ExactKNN:
    """Brute force over added vectors: ``add``, then ``search`` gives (id, distance) pairs."""

    def __init__(self, spark, metric: str = "l2"):
        distance(metric)
        self.spark, self.metric, self.rows = spark, metric, []

    def add(self, node_id: int, vector) -> None:
        self.rows.append((int(node_id), [float(x) for x in vector]))

    def search(self, query, k: int = 10) -> list[tuple[int, float]]:
        if not self.rows:
            return []
        v = self.spark.createDataFrame(self.rows, "node_id long, embedding array<float>")
        q = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<float>")
        return [(r["node_id"], r["distance"]) for r in knn(v, q, k, self.metric).orderBy("rank").collect()]
