"""Proximity graphs as edge tables: building, pruning, levels, checks, and beam search by joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distance import distance, node_level
from ..shipping import ready
from . import exact, routing

#: members of a cell that meet in one task
CELL_ROWS = 4096
#: queries that a measured recall rests on, and what it has to be there, so that 0.9 holds for all
SAMPLE, RECALL = 256, 0.95


def closest(vectors: DataFrame, m: int, metric: str = "l2", candidates: int | None = None) -> DataFrame:
    """src, dst, distance, rank: each node's ``candidates`` (m) nearest others."""
    n = candidates or m
    queries = vectors.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = exact.knn_arrow(vectors, queries, n + 1, metric).where("query_id != node_id")
    order = W.partitionBy("query_id").orderBy("distance", "node_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"), "distance", "rank")


def sampled_truth(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", spec: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """SAMPLE of the queries, by a hash of their ids, and their exact hits: what recall is measured by."""
    sample = _cut(queries.select("query_id", "query").orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE))
    return sample, _cut(exact.knn_arrow(vectors, sample, k, metric, spec).select("query_id", "node_id"))


def enough(counts: list, share: float):
    """Of (value, count) pairs, the least value up to which there is ``share`` of all; None without any."""
    total, got = sum(c for _, c in counts), 0
    for value, c in sorted(counts):
        got += c
        if got >= share * total:
            return value
    return None


def candidates(vectors: DataFrame, m: int, metric: str = "l2", probes: int = 6, seed: int = 42) -> DataFrame:
    """src, dst, distance, rank: each node's m nearest others among the cells nearest to it, so that work grows with n ** 1.5 and not with n ** 2.

    ``probes`` cells at least, and as many as hold RECALL of the nearest others of a sample of nodes.  Vectors without structure need a share of all cells,
    whatever their number: where that is more than half of them, all pairs are compared (``closest``), and work does grow with n ** 2.
    A cell holds 4 sqrt(n) vectors on average; members and askers of a cell meet in blocks of bounded size, so a large cell is many tasks.
    """
    spark = ready(vectors.sparkSession)
    v = vectors.select("node_id", "embedding")
    n = v.count()
    if n < 2:
        return spark.createDataFrame([], "src long, dst long, distance double, rank int")
    k = max(2, round(n**0.5 / 4))
    placed, centres = routing.cells(v, k, seed)
    placed, centres = _cut(placed.select("node_id", "embedding", "cell")), centres.select(F.col("cell").cast("long").alias("node_id"), F.col("centre").alias("embedding"))
    asked = v.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    if probes < k:
        sample, truth = sampled_truth(v, asked, m + 1, metric)
        away = exact.knn_arrow(centres, sample, k, metric).select("query_id", F.col("node_id").cast("int").alias("cell"), "rank")
        held = truth.where("query_id != node_id").join(placed.select("node_id", "cell"), "node_id").join(away, ["query_id", "cell"])
        probes = max(probes, enough(held.groupBy("rank").count().collect(), RECALL) or 0)
        if 2 * probes > k:
            return closest(v, m, metric)
    nearest = exact.knn_arrow(centres, asked, probes, metric).select("query_id", F.col("node_id").cast("int").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"))
    members = placed.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("node_id"), "blocks").cast("int").alias("block"), "node_id", "embedding")
    askers = nearest.join(sizes, "cell").join(asked, "query_id").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "query")

    def score(t: pa.Table, q: pa.Table) -> pa.Table:
        none = pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not t.num_rows or not q.num_rows:
            return none
        x, ids = np.array(t["embedding"].to_pylist(), np.float32), t["node_id"].to_numpy()
        out = []
        for at in range(0, q.num_rows, exact.BLOCK_ROWS):
            part = q.slice(at, exact.BLOCK_ROWS)
            y, src = np.array(part["query"].to_pylist(), np.float32), part["query_id"].to_numpy()
            row, col = exact.block_hits(y, x, ids, m + 1, metric)
            other = src[row] != ids[col]
            row, col = row[other], col[other]
            away = np.concatenate([np.zeros(0), *(exact._as_expressed(y[row[i : i + exact.PAIRS]], x[col[i : i + exact.PAIRS]], metric) for i in range(0, len(row), exact.PAIRS))])
            out.append(pa.table({"src": src[row], "dst": ids[col], "distance": away}))
        return pa.concat_tables(out) if out else none

    near = members.groupBy("cell", "block").cogroup(askers.groupBy("cell", "block")).applyInArrow(score, "src long, dst long, distance double")
    order = W.partitionBy("src").orderBy("distance", "dst")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)


def diverse(candidates: DataFrame, vectors: DataFrame, m: int, metric: str = "l2", keep_pruned: bool = True) -> DataFrame:
    """src, dst, distance: of each node's candidates, nearest first, those nearer to it than to any chosen before; then the nearest rejected ones up to m."""
    dist = distance(metric)
    v = vectors.select(F.col("node_id").alias("dst"), "embedding")
    lists = candidates.join(v, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.col("distance").alias("d"), F.col("dst").alias("id"), F.col("embedding").alias("v")))).alias("c"))
    item = "array<struct<d:double,id:bigint,v:array<float>>>"
    empty = F.struct(F.array().cast(item).alias("chosen"), F.array().cast(item).alias("rest"))

    def step(s, x):
        full = F.size(s["chosen"]) >= m
        bad = F.exists(s["chosen"], lambda r: dist(x["v"], r["v"]) < x["d"])
        return F.struct(F.when(full | bad, s["chosen"]).otherwise(F.concat(s["chosen"], F.array(x))).alias("chosen"), F.when(~full & bad, F.concat(s["rest"], F.array(x))).otherwise(s["rest"]).alias("rest"))

    picked = lists.select("src", F.aggregate("c", empty, step).alias("s"))
    both = F.slice(F.concat(F.col("s.chosen"), F.col("s.rest")), 1, m) if keep_pruned else F.col("s.chosen")
    return picked.select("src", F.explode(both).alias("x")).select("src", F.col("x.id").alias("dst"), F.col("x.d").alias("distance"))


def reverse_prune(edges: DataFrame, m_max: int, vectors: DataFrame | None = None, metric: str = "l2", keep_pruned: bool = True) -> DataFrame:
    """Edges in both directions, m_max out-edges of each node: the nearest, or with ``vectors`` for nodes of more than m_max a diverse choice of their 4 m_max nearest."""
    both = edges.select("src", "dst", "distance").union(edges.select("dst", "src", "distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    order = W.partitionBy("src").orderBy("distance", "dst")
    if vectors is None:
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m_max)
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 4 * m_max)
    ranked = ranked.withColumn("degree", F.count(F.lit(1)).over(W.partitionBy("src")))
    few = ranked.where(F.col("degree") <= m_max).select("src", "dst", "distance")
    chosen = few.union(diverse(ranked.where(F.col("degree") > m_max), vectors, m_max, metric, keep_pruned).select("src", "dst", "distance"))
    return chosen.withColumn("rank", F.row_number().over(order))


def healed(edges: DataFrame, vectors: DataFrame, removed: DataFrame, m_max: int, metric: str = "l2") -> DataFrame:
    """src, dst, distance without the removed nodes: nodes that pointed at one get the nodes behind it, over runs of removed nodes as well, m_max nearest of all.

    Only pairs that lead into removed nodes are followed; edges of all other nodes stay as they are.
    """
    gone = removed.select("node_id").distinct()
    own = edges.groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    into, out_of = gone.withColumnRenamed("node_id", "dst"), gone.withColumnRenamed("node_id", "src")
    kept = own.join(out_of, "src", "left_anti").join(into, "dst", "left_anti")
    behind = own.join(out_of, "src", "left_semi").select(F.col("src").alias("via"), "dst")
    step = _cut(own.join(out_of, "src", "left_anti").join(into, "dst", "left_semi").select("src", F.col("dst").alias("via")))
    hurt, seen, found = step.select("src").distinct(), step, step.select("src", F.col("via").alias("dst")).limit(0)
    while not step.isEmpty():
        reached = _cut(step.join(behind, "via").where("src != dst").select("src", "dst").distinct())
        found = found.union(reached.join(into, "dst", "left_anti").select("src", "dst"))
        step = _cut(reached.join(into, "dst", "left_semi").select("src", F.col("dst").alias("via")).join(seen, ["src", "via"], "left_anti"))
        seen = seen.union(step)
    new = found.distinct().join(kept, ["src", "dst"], "left_anti")
    a, b = vectors.select(F.col("node_id").alias("src"), F.col("embedding").alias("a")), vectors.select(F.col("node_id").alias("dst"), F.col("embedding").alias("b"))
    new = new.join(a, "src").join(b, "dst").select("src", "dst", distance(metric)(F.col("a"), F.col("b")).alias("distance"))
    order = W.partitionBy("src").orderBy("distance", "dst")
    chosen = kept.join(hurt, "src", "left_semi").select("src", "dst", "distance").union(new).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m_max)
    return kept.join(hurt, "src", "left_anti").select("src", "dst", "distance").union(chosen.drop("rank"))


def levels(vectors: DataFrame, m: int = 16, seed: int = 42) -> DataFrame:
    return vectors.select("node_id", node_level(F.col("node_id"), m, seed).alias("level"))


def entry_point(leveled: DataFrame) -> DataFrame:
    """One row: the smallest node of the highest level."""
    return leveled.agg(F.min(F.struct((-F.col("level")).alias("down"), "node_id")).alias("x")).select(F.col("x.node_id").alias("entry_point"), (-F.col("x.down")).alias("max_level"))


def build(vectors: DataFrame, m: int = 16, ef_construction: int = 100, metric: str = "l2", heuristic: bool = True, keep_pruned: bool = True, seed: int = 42) -> DataFrame:
    """layer, src, dst, distance of every layer: a node stands on the layers up to its level; layer 0 keeps 2 m edges a node."""
    leveled = _cut(vectors.select("node_id", "embedding").join(levels(vectors, m, seed), "node_id"))
    top = leveled.agg(F.max("level")).first()[0]
    layers = []
    for layer in range((top if top is not None else -1) + 1):
        here = leveled.where(F.col("level") >= layer).select("node_id", "embedding")
        near = candidates(here, ef_construction if heuristic else m, metric, seed=seed)
        chosen = _cut(diverse(near, here, m, metric, keep_pruned) if heuristic else near)
        pruned = reverse_prune(chosen, 2 * m if layer == 0 else m, here if heuristic else None, metric, keep_pruned)
        layers.append(_cut(pruned).select(F.lit(layer).alias("layer"), "src", "dst", "distance"))
    if not layers:
        return vectors.sparkSession.createDataFrame([], "layer int, src long, dst long, distance double")
    out = layers[0]
    for x in layers[1:]:
        out = out.union(x)
    return out


def violations(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """dangling and loops: edges to or from no node, and edges from a node to itself."""
    ids = vectors.select("node_id")
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    dangling = ends.join(ids, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    loops = edges.where("src = dst").agg(F.count(F.lit(1)).alias("loops"))
    return dangling.crossJoin(loops)  # one row each


def degree_stats(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return degree.agg(F.count(F.lit(1)).alias("nodes"), F.sum("degree").alias("edges"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def reachable(edges: DataFrame, start: int) -> DataFrame:
    """node_id, hop: all nodes reached from ``start`` along edges, by frontier joins until nothing is new; each hop is checkpointed."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "node_id long, hop int")
    frontier, hop = seen, 0
    while True:
        hop += 1
        frontier = frontier.join(edges, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = _cut(frontier)
        if frontier.isEmpty():
            return seen
        seen = _cut(seen.union(frontier))


def _cut(df: DataFrame) -> DataFrame:
    """Written as Parquet to the folder that driver and executors share, and read again.

    The plan that is left is a scan that knows its size.  A checkpoint keeps the size that was estimated for its plan, and that of a join is a product: in a
    loop of joins the number's digits double with each turn, until the driver has no room for it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_nearfield_cuts", None)
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = sc._nearfield_cuts = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    path = f"{at.rstrip('/')}/nearfield-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _read([path], df.schema, spark)


def _read(paths: list[str], schema, spark) -> DataFrame:
    out = spark.read.schema(schema).parquet(*paths)
    out._nearfield_paths = paths
    return out


def _together(cuts: list[DataFrame]) -> DataFrame:
    """One scan of what several cuts of one schema wrote."""
    return _read([p for c in cuts for p in c._nearfield_paths], cuts[0].schema, cuts[0].sparkSession)


def _forget(*cuts: DataFrame) -> None:
    """Deletes what cuts wrote and nothing reads any more."""
    for c in cuts:
        sc = c.sparkSession.sparkContext
        for path in c._nearfield_paths:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _scored(pairs: DataFrame, v: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    d = distance(metric)
    return pairs.join(v, "node_id").join(queries, "query_id").select("query_id", "node_id", d(F.col("query"), F.col("embedding")).alias("distance"))


def descend(vectors: DataFrame, edges: DataFrame, queries: DataFrame, entry: int, top: int, metric: str = "l2") -> DataFrame:
    """query_id, node_id: where each query's walk of layer 0 starts, by greedy steps to nearer neighbours on the layers above, from the top down."""
    v = vectors.select("node_id", "embedding")
    here = _cut(_scored(queries.select("query_id", F.lit(entry).cast("long").alias("node_id")), v, queries, metric))
    for layer in range(top, 0, -1):
        steps = edges.where(F.col("layer") == layer).select("src", "dst")
        moved = here
        while not moved.isEmpty():
            around = moved.join(steps, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"))
            best = _scored(around, v, queries, metric).groupBy("query_id").agg(F.min(F.struct("distance", "node_id")).alias("x"))
            last = here, moved
            moved = _cut(here.join(best, "query_id").where("x.distance < distance").select("query_id", "x.node_id", "x.distance"))
            here = _cut(here.join(moved.select("query_id"), "query_id", "left_anti").unionByName(moved))
            _forget(*last)
    return here.select("query_id", "node_id")


def beam_search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, entry: int | DataFrame, k: int = 10, ef: int = 50, metric: str = "l2", expand: int = 8, budget: int | None = None, allowed: DataFrame | None = None, recall: float | None = None) -> DataFrame:
    """query_id, rank, node_id, distance, visited: all queries walk the graph together, from one node or from each query's own (query_id, node_id).

    Each hop expands a query's ``expand`` best unexpanded nodes among its ``ef`` best, joins their neighbours, drops the
    visited, and scores the rest.  A query ends when its ``ef`` best are all expanded, or when it has visited ``budget`` nodes.  Nodes outside ``allowed``
    are walked through but not returned.  From hop to hop go the ``ef`` best; what a hop visits is written once.
    With ``recall`` the walk goes on with twice the beam, from all it has seen, until it has this share of the exact hits of a sample of queries; where that
    doesn't pay (less than a quarter of what is missing is gained, or an eighth of all rows stands in the beam), all vectors are scored.
    """
    if recall is not None and (budget is not None or allowed is not None):
        raise ValueError("recall is measured for walks without a budget or a filter")
    ef = max(ef, k)
    queries = _cut(queries.select("query_id", "query"))
    v, links = vectors.select("node_id", "embedding"), edges.select("src", "dst")
    of_query = W.partitionBy("query_id")
    best = of_query.orderBy("distance", "node_id")
    upto = best.rowsBetween(W.unboundedPreceding, W.currentRow)

    def ranked(new: DataFrame, beam: DataFrame | None = None) -> DataFrame:
        """The ``ef`` best of a beam and of what its hop visited; turn: is expanded next."""
        expanded = F.col("expanded") if "expanded" in new.columns else F.lit(False)
        rows = new.select("query_id", "node_id", "distance", expanded.alias("expanded"), F.lit(0).cast("long").alias("visited"), F.lit(1).alias("new"))
        if beam is not None:
            rows = rows.union(beam.select("query_id", "node_id", "distance", F.col("expanded") | F.col("turn"), "visited", F.lit(0)))
        rows = rows.withColumn("visited", F.max("visited").over(of_query) + F.sum("new").over(of_query)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= ef)
        turn = ~F.col("expanded") & (F.sum((~F.col("expanded")).cast("int")).over(upto) <= expand) & (F.lit(True) if budget is None else F.col("visited") < budget)
        return _cut(rows.select("query_id", "node_id", "distance", "expanded", "visited", turn.alias("turn")))

    start = entry if isinstance(entry, DataFrame) else queries.select("query_id", F.lit(entry).cast("long").alias("node_id"))
    seen = [_cut(_scored(start, v, queries, metric))]
    beam, turns = ranked(seen[0]), []
    truth = None if recall is None else sampled_truth(vectors, queries, k, metric)[1]
    missing, rows, short = None, None, False
    while True:
        if (turn := beam.where("turn")).isEmpty():
            if truth is None:
                break
            last, missing = missing, truth.join(_together(seen), ["query_id", "node_id"], "left_anti").count()
            if missing <= (1 - recall) * truth.count():
                break
            rows = rows or vectors.count()
            if 8 * ef > rows or last is not None and missing > 0.75 * last:
                short = True
                break
            ef, expand = 2 * ef, 2 * expand
            marks = _together(turns).where("turn").select("query_id", "node_id", F.lit(True).alias("expanded"))
            wider = _together(seen).join(marks, ["query_id", "node_id"], "left").withColumn("expanded", F.coalesce("expanded", F.lit(False)))
            turns.append(beam)
            beam = ranked(wider)
            continue
        near = turn.join(links, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id")).distinct()
        seen.append(_cut(_scored(near.join(_together(seen).select("query_id", "node_id"), ["query_id", "node_id"], "left_anti"), v, queries, metric)))
        old, beam = beam, ranked(seen[-1], beam)
        if truth is None:
            _forget(old)
        else:
            turns.append(old)
    visited = beam.groupBy("query_id").agg(F.max("visited").alias("visited"))
    ok = beam if allowed is None else _together(seen).join(allowed.select("node_id"), "node_id", "left_semi")
    if short:
        out = exact.knn_arrow(vectors, queries, k, metric).withColumn("visited", F.lit(rows).cast("long"))
    else:
        out = exact.top_k(ok.select("query_id", "node_id", "distance"), k).join(visited, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "node_id", "distance", "visited")
    out = _cut(out)
    _forget(queries, beam, *turns, *seen)
    return out
