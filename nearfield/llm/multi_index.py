"""Approximate nearest neighbours (operator 4): inverted multi-index with exact rerank.

The two halves of each normalised vector are quantised on their own; a pair of centroids is a cell.  A query walks cells in
order of the summed distances to both centroids, from a heap over the two sorted lists (the multi-sequence walk), until the
cells hold its share of the vectors.  All vectors of those cells are reranked by the cosine in double precision.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors with the smallest hash of their id); every vector is
indexed.  Equal vectors are one entry with their smallest ids, as no more can be in a result.  Cells are dealt to groups of
bounded size, a large cell to several (by a salt), and a query goes, packed with others, only to groups that hold its
cells.  Queries are dealt to blocks of bounded size as well, each with its own copy of the groups: a task holds one group and one block.  The driver knows the cells' sizes only: at most MOST**2 numbers.

Vectors null, of another dimension than most, zero, or holding null or non-finite components take no part.  Ties go to the smaller
vec_id.  Rows with a query's vec_id are its own row; of several rows with one query vec_id the smallest vector asks.  Empty table: empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SAMPLE, SHARE, LEAST, MOST, GROUP, ASKED, TOP, EVERY = 20_000, 0.65, 64, 64, 8192, 8192, 5, 50


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds from k distinct points of the sample."""
    x = x[np.lexsort(x.T)]
    own = np.unique(x, axis=0)
    c = own[np.random.default_rng(seed).permutation(len(own))[:k]].copy()
    for _ in range(rounds):
        near = (2 * x @ c.T - (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * x @ c.T - (c**2).sum(1)).argmax(1)


def walk(near: np.ndarray, far: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
    """Cells in order of summed distance until they hold ``want`` vectors; near, far: distances to both halves' centroids."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    x, y = near[a].tolist(), far[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, out, got, rows = [(x[0] + y[0], 0, 0)], [], 0, len(b)
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * rows + b[j]
        if sizes[cell]:
            out.append(cell)
            got += int(sizes[cell])
        if j + 1 < rows:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, share: float = SHARE, sample: int = SAMPLE, block: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query (vec_id, embedding), its own vec_id left out."""
    spark = C.ready(vectors.sparkSession)
    shape = vectors.select(F.size("embedding").alias("dim")).where("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    dim, half = shape["dim"], shape["dim"] // 2
    real = F.col("embedding").cast("array<double>")
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = (F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(real, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    fit_for = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), real.alias("v"))
    asks = queries.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), real.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    few = W.partitionBy("v").orderBy("vec_id")
    entries = fit_for.withColumn("n", F.row_number().over(few)).where(F.col("n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = C.cut(entries)

    def rows(x: list) -> np.ndarray:
        return np.array(x, np.float64).reshape(-1, dim)

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    some = unit(rows([r["v"] for r in entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v").collect()]))
    if not len(some):
        return spark.createDataFrame([], result)
    n = entries.count()
    k = max(8, min(MOST, int(math.sqrt(n) / 3)))
    one, two = kmeans(some[:, :half], k) if half else np.zeros((1, 0)), kmeans(some[:, half:], k)
    wide = len(two)

    def cells_of(x: np.ndarray) -> np.ndarray:
        u = unit(x)
        return (_nearest(u[:, :half], one) if half else np.zeros(len(u), np.int64)) * wide + _nearest(u[:, half:], two)

    def index(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(cells_of(rows(b.column(0).to_pylist())), pa.int64())], ["v", "ids", "cell"])

    placed = C.cut(entries.mapInArrow(index, "v array<double>, ids array<long>, cell long"))
    sizes = np.zeros(len(one) * wide, np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row a cell, MOST**2 at most
        sizes[r["cell"]] = r["count"]
    groups = max(C.shuffle_partitions(spark), n // GROUP)
    asks = C.cut(asks)
    blocks = -(-asks.count() // block)
    parts = np.maximum(1, -(-sizes // GROUP))

    def group_of(cell, salt):
        return (C.mix64(np.asarray(cell, np.uint64) * np.uint64(1 << 20) + np.asarray(salt, np.uint64)) % np.uint64(groups)).astype(np.int64)

    known = spark.sparkContext.broadcast((sizes, parts))

    def deal(batches):
        _, parts = known.value
        for b in batches:
            cell = b.column("cell").to_numpy()
            first = np.array([x[0] for x in b.column("ids").to_pylist()], np.int64)
            salt = C.mix64(first.view(np.uint64)) % parts[cell].astype(np.uint64)
            for q in range(blocks):
                yield pa.record_batch([pa.array(group_of(cell, salt) * blocks + q), *b.columns], ["group", "v", "ids", "cell"])

    def ask(batches):
        sizes, parts = known.value
        want = max(LEAST, math.ceil(share * int(sizes.sum())))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                if not p.num_rows:
                    continue
                ids, x = p.column(0).to_numpy(), rows(p.column(1).to_pylist())
                u = unit(x)
                near = ((u[:, None, :half] - one) ** 2).sum(2)
                far = ((u[:, None, half:] - two) ** 2).sum(2)
                asked = np.zeros((len(ids), len(sizes)), bool)
                for i in range(len(ids)):
                    asked[i, walk(near[i], far[i], sizes, want)] = True
                spread: dict = {}
                for c in np.flatnonzero(asked.any(0)).tolist():
                    for g in group_of(np.full(parts[c], c), np.arange(parts[c])).tolist():
                        spread.setdefault(g, set()).add(c)
                out = []
                mine = C.mix64(ids.view(np.uint64)) % np.uint64(blocks)
                for g, cells in spread.items():
                    told = asked[:, sorted(cells)].any(1)
                    for q in np.unique(mine[told]).tolist():
                        own = np.flatnonzero(told & (mine == q))
                        out.append((g * blocks + q, ids[own].tobytes(), x[own].tobytes(), np.packbits(asked[own], axis=1).tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["group", "ids", "x", "cells"])

    def rerank(v: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not v.num_rows or not q.num_rows:
            return schema.empty_table()
        x, ids, cell = rows(v["v"].to_pylist()), v["ids"].to_pylist(), v["cell"].to_numpy()
        size = np.linalg.norm(x, axis=1)
        order = np.argsort(cell, kind="stable")
        edge = np.r_[np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0]), len(order)]
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        for qi, qx, qc in zip(q["ids"].to_pylist(), q["x"].to_pylist(), q["cells"].to_pylist()):
            qi = np.frombuffer(qi, np.int64)
            qx = np.frombuffer(qx, np.float64).reshape(len(qi), -1)
            asked = np.unpackbits(np.frombuffer(qc, np.uint8).reshape(len(qi), -1), axis=1).astype(bool)
            norm = np.linalg.norm(qx, axis=1)
            best: list[list] = [[] for _ in qi]
            for a, b in zip(edge, edge[1:]):
                own, who = order[a:b], np.flatnonzero(asked[:, cell[order[a]]])
                if not len(who):
                    continue
                s = (qx[who] @ x[own].T) / (norm[who, None] * size[own])
                m = min(top + 1, len(own))
                kth = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                for i, row, least in zip(who.tolist(), s, kth.tolist()):
                    for j in np.flatnonzero(row >= least).tolist():
                        for w in ids[own[j]]:
                            if w != qi[i]:
                                best[i].append((-float(row[j]), w))
                    if len(best[i]) > 64:
                        best[i] = heapq.nsmallest(top, best[i])
            for i, hits in enumerate(best):
                for s, w in heapq.nsmallest(top, hits):
                    out["query_id"].append(int(qi[i]))
                    out["vec_id"].append(w)
                    out["score"].append(-s)
        return pa.table(out, schema=schema)

    dealt = placed.mapInArrow(deal, "group long, v array<double>, ids array<long>, cell long").groupBy("group")
    asked = asks.mapInArrow(ask, "group long, ids binary, x binary, cells binary").groupBy("group")
    hits = dealt.cogroup(asked).applyInArrow(rerank, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"])
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
