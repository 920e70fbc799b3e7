"""The index between snapshots: rows that came later, deleted bridges, beams, budgets, caches, writers, truncation."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance
from nearfield.index import VectorIndex
from nearfield.model import Config
from nearfield.operators import evaluate, exact, filters, graph, routing


def frame(spark, x, name="node_id", value="embedding"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, {value} array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(42)
    centres = 3 * rng.standard_normal((10, 16))
    return (centres[np.arange(600) % 10] + 0.5 * rng.standard_normal((600, 16))).astype(np.float32)


def test_approximate_search_sees_later_rows_and_passes_deleted_ones(spark, tmp_path, clustered):
    x = clustered
    ix = VectorIndex(spark, f"file://{tmp_path}/ix", Config(M=8, ef_construction=40, filter_fallback_threshold=20))
    ix.insert_frame(frame(spark, x[:500]).withColumn("metadata", F.create_map(F.lit("even"), F.when(F.col("node_id") % 2 == 0, "n:1.0").otherwise("n:0.0"))))
    with pytest.raises(ValueError):
        ix.insert_frame(frame(spark, x[:2]))
    with pytest.raises(ValueError):
        ix.insert_frame(frame(spark, x[:3, :4]).withColumn("node_id", F.col("node_id") + 900))
    now = ix.save_snapshot(with_graph=True)
    assert now["entry_point"] is not None
    ix.insert(700, x[5] + 1e-4)
    entry = now["entry_point"]
    for gone in (entry, 7, 8):
        ix.delete(gone)
    asked = frame(spark, x[[5, 7, 40, 123, 250, 499]], "query_id", "query")
    found = ix.search_frame(asked, 10, 80)
    assert {r["route"] for r in found.select("route").distinct().collect()} == {"approximate"}
    truth = exact.knn(ix.rows(), asked, 10)
    assert evaluate.recall(found, truth).first()["recall"] >= 0.95
    assert [h[0] for h in ix.search(x[5], 2, approximate=True)] == [5, 700] == [h[0] for h in ix.search(x[5], 2)]
    assert not {entry, 7, 8} & {r["node_id"] for r in found.select("node_id").collect()}
    few, many = (ix.batch_search(x[:6], 5, ef=ef, approximate=True, return_visited=True)[1] for ef in (5, 200))
    assert sum(many) > sum(few) > 0 and ix.escalations == 0
    hits, visited = ix.batch_search(x[:2], 5, filter={"even": True}, return_visited=True)
    assert all(h[0] % 2 == 0 for own in hits for h in own) and visited[0] == sum(i % 2 == 0 and i not in (entry, 7, 8) for i in range(500))


def test_budget_ends_the_walk_and_escalation_is_counted(spark, clustered):
    v, q = frame(spark, clustered).persist(), frame(spark, clustered[:8], "query_id", "query")
    edges = graph._cut(graph.build(v, 8, 40))
    top = graph.entry_point(graph.levels(v, 8)).first()
    start = graph._cut(graph.descend(v, edges, q, top["entry_point"], top["max_level"]))
    ground = edges.where("layer = 0")
    small, whole = (graph.beam_search(v, ground, q, start, 5, 64, budget=b).agg(F.max("visited")).first()[0] for b in (40, None))
    assert small < whole and small < 40 + 8 * 16
    told = []
    only = v.where("node_id < 3").select("node_id")
    got = routing.search(v, q, 5, 16, {"node_id": 4}, threshold=0, approximate=lambda q, k, b: graph.beam_search(v, ground, q, start.join(q.select("query_id"), "query_id"), k, 16, budget=20, allowed=only.where("node_id > 9")), escalated=told.append)
    assert {r["route"] for r in got.collect()} == {"escalated"} and told == [8]


def test_hot_copies_and_far_clusters(spark):
    """A third of the rows equal, and clusters far apart: descent and later exact routes still reach the right part."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((200, 8)), 50 + rng.standard_normal((200, 8)), -50 + rng.standard_normal((200, 8))]).astype(np.float32)
    v = frame(spark, x).persist()
    near = graph.candidates(v, 10).persist()
    assert near.groupBy("src").count().where("count != 10").isEmpty() and near.where("src < 200 AND distance > 0").isEmpty()
    assert graph.candidates(v.limit(1), 4).isEmpty() and graph.build(v.limit(0)).isEmpty()
    edges = graph._cut(graph.build(v, 8, 40))
    bad = graph.violations(edges, v).first()
    degree = edges.where("layer = 0").groupBy("src").count().agg(F.max("count")).first()[0]
    assert (bad["dangling"], bad["loops"]) == (0, 0) and degree <= 16


def test_reachable_goes_to_the_end(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(75)], "src long, dst long")
    got = graph.reachable(line.coalesce(1), 0)
    assert got.count() == 76 and got.agg(F.max("hop")).first()[0] == 75


def test_filter_cache_is_used_and_follows_writes(spark, tmp_path):
    ix = VectorIndex(spark, f"file://{tmp_path}/ix")
    ix.batch_insert(np.eye(8), metadatas=[{"tier": "gold" if i < 3 else "basic"} for i in range(8)])
    for _ in range(2):
        assert {h[0] for h in ix.search(np.ones(8), 8, filter={"tier": "gold"})} == {0, 1, 2}
    assert (ix.cache.misses, ix.cache.hits) == (1, 1)
    other = VectorIndex(spark, f"file://{tmp_path}/ix")
    other.insert(50, np.ones(8), {"tier": "gold"})
    other.delete(1)
    assert {h[0] for h in ix.search(np.ones(8), 8, filter={"tier": "gold"})} == {0, 2, 50} and ix.cache.misses == 2
    small = filters.FilterCache(max_bytes=100)
    assert small.get(ix.rows(), {"tier": "gold"}, 1).count() == 3 and not small.kept
    lru = filters.FilterCache(max_entries=2)
    for t in ("a", "b", "a", "c"):
        lru.get(ix.rows(), {"tier": t}, 1)
    assert [k[0][1] for k in lru.kept] == ["s:a", "s:c"] and lru.hits == 1


def test_writers_at_once_and_truncation(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    VectorIndex(spark, path).insert(0, [0.0] * 4)

    def work(w):
        ix = VectorIndex(spark, path)
        for i in range(3):
            ix.insert(100 * (w + 1) + i, [float(w), float(i), 0.0, 0.0])
        ix.delete(100 * (w + 1))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    ix = VectorIndex(spark, path)
    want = {0} | {100 * (w + 1) + i for w in range(4) for i in (1, 2)}
    seqs = [r["seq"] for r in ix.store.changes().collect()]
    assert len(seqs) == len(set(seqs)) == 17 and {r["node_id"] for r in ix.rows().collect()} == want
    for n in range(3):
        ix.insert(1000 + n, [1.0] * 4)
        ix.compact()
    assert len(ix.store._names("commits")) == len(ix.store._names("versions")) == 2 and len(ix.store._names("changes")) == 1
    assert {r["node_id"] for r in VectorIndex(spark, path).rows().collect()} == want | {1000, 1001, 1002}
    # a commit whose writer broke off doesn't count
    ix.store._create("commits/000000000099.json", '{"version": "x"')
    assert ix.stats()["size"] == len(want) + 3


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.standard_normal(5000), np.full(700, 0.25), 1e9, -1e9]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    shares = (0.0, 0.01, 0.5, 0.95, 1.0)
    assert evaluate.quantiles(df, "x", shares, few=60) == pytest.approx(np.quantile(x, shares).tolist(), abs=1e-12)
    assert evaluate.quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_kernel_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [None, 1.0]), (4, [1.0, 2.5]), (5, [])]
    v = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 2.0]), (10, None)], "query_id long, query array<float>")
    want = [(9, 1, 0, 0.0), (9, 2, 4, 0.5)]
    assert [tuple(r) for r in exact.knn(v, q, 3).orderBy("rank").collect()] == want == [tuple(r) for r in exact.knn_arrow(v, q, 3).orderBy("rank").collect()]
    assert exact.knn_arrow(v, q.limit(0), 3).isEmpty()


def test_kernel_on_many_batches(spark, clustered):
    """Hits of one query over many blocks of one task, and more queries than are broadcast."""
    v = frame(spark, clustered).coalesce(1)
    more = v.crossJoin(spark.range(12).select(F.col("id").alias("n"))).select((F.col("node_id") + 600 * F.col("n")).alias("node_id"), F.transform("embedding", lambda x: x + F.col("n").cast("float")).alias("embedding"))
    q = frame(spark, clustered[:7], "query_id", "query")
    a, b = (f(more, q, 12).orderBy("query_id", "rank").collect() for f in (exact.knn, exact.knn_arrow))
    assert a == b
    everything = more.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    got = exact.knn(v, everything, 3)
    assert got.where("query_id < 7").orderBy("query_id", "rank").collect() == exact.knn(v, q, 3).orderBy("query_id", "rank").collect() and got.count() == 3 * 7200


def test_sql_functions(spark, clustered):
    v = frame(spark, clustered[:100])
    distance.register(v)
    got = spark.sql("SELECT * FROM knn((SELECT embedding FROM nearfield_vectors WHERE node_id = 4), 3) ORDER BY rank").collect()
    q = frame(spark, clustered[4:5], "query_id", "query")
    assert [(r["node_id"], r["distance"]) for r in got] == [(r["node_id"], r["distance"]) for r in exact.knn(v, q, 3).orderBy("rank").collect()]
    assert spark.sql("SELECT cosine_distance(array(1F, 0F), array(0F, 2F)) AS d").first()["d"] == 1.0


def test_healing_bridges_runs_of_removed_nodes(spark):
    v = frame(spark, [[float(i), 0.0] for i in range(8)])
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)] + [(3, 2, 1.0), (0, 7, 7.0)], "src long, dst long, distance double")
    gone = v.where("node_id IN (2, 3, 4)")
    got = {(r["src"], r["dst"]): r["distance"] for r in graph.healed(line, v, gone, 4).collect()}
    assert got == {(0, 1): 1.0, (0, 7): 7.0, (1, 5): 4.0, (5, 6): 1.0, (6, 7): 1.0}
    assert {(r["src"], r["dst"]) for r in graph.healed(line, v, v.limit(0), 1).collect()} == {(r["src"], r["dst"]) for r in line.collect()}


def test_second_try_goes_its_own_way(spark, clustered):
    v, q = frame(spark, clustered), frame(spark, clustered[:6], "query_id", "query")
    first = lambda q, k, b: exact.knn(v, q.where("query_id < 4"), k)
    told = []
    got = routing.search(v, q, 5, 16, None, threshold=0, approximate=first, again=lambda q, k, b: exact.knn(v, q.where("query_id = 4"), k), escalated=told.append)
    assert {(r["query_id"], r["route"]) for r in got.collect()} == {(0, "approximate"), (1, "approximate"), (2, "approximate"), (3, "approximate"), (4, "retried"), (5, "escalated")} and told == [1]


def test_candidates_without_structure_and_with(spark):
    """Six cells hold too few of the nearest others where vectors have no structure, and are enough in clusters."""
    rng = np.random.default_rng(8)
    name = {"src": "query_id", "dst": "node_id"}
    for x in (rng.standard_normal((2500, 48)), rng.standard_normal((12, 48)).repeat(209, 0) * 20 + rng.standard_normal((2508, 48))):
        v = frame(spark, x.astype(np.float32)).persist()
        found, truth = (f(v, 10).withColumnsRenamed(name).persist() for f in (graph.candidates, graph.closest))
        assert evaluate.recall(found, truth).first()["recall"] >= 0.9 and found.groupBy("query_id").count().where("count != 10").isEmpty()


def test_cell_search_has_the_budget_that_recall_needs(spark):
    """A budget of 100 rows holds few of the exact hits where vectors have no structure; filters and rows outside them count as before."""
    x = np.random.default_rng(9).standard_normal((2000, 48)).astype(np.float32)
    v = frame(spark, x).withColumn("m", (F.col("node_id") % 2).cast("int")).persist()
    q = v.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query")).persist()
    placed, centres = routing.cells(v, 16)
    truth = exact.knn(v, q, 10, spec={"m": 1}).persist()
    few, whole = (routing.cell_search(placed, centres, q, 10, 100, spec={"m": 1}, recall=r).persist() for r in (None, 0.95))
    assert evaluate.recall(few, truth).first()["recall"] < 0.9 <= evaluate.recall(whole, truth).first()["recall"]
    assert whole.where("node_id % 2 = 0 OR visited > 1000").isEmpty() and whole.groupBy("query_id").count().where("count != 10").isEmpty()
    near = v.withColumn("embedding", F.array_repeat(F.floor(F.col("node_id") / 125).cast("float"), 4))
    placed, centres = routing.cells(near, 16)
    asked = near.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = routing.cell_search(placed, centres, asked, 5, 100, recall=0.95).persist()
    assert evaluate.recall(hits, exact.knn(near, asked, 5)).first()["recall"] >= 0.95 and hits.agg(F.max("visited")).first()[0] < 1000


def test_walks_widen_until_a_sample_is_found(spark):
    """A beam of 10 is too narrow without structure; a graph in parts is not walked to the end, so all vectors are scored."""
    v = frame(spark, np.random.default_rng(10).standard_normal((800, 32)).astype(np.float32)).persist()
    q = v.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query")).persist()
    edges, truth = graph.reverse_prune(graph.closest(v, 4), 6).persist(), exact.knn(v, q, 10).persist()
    narrow, wide, parts = (graph.beam_search(v, e, q, 0, 10, 10, recall=r) for e, r in ((edges, None), (edges, 0.95), (edges.where("src % 2 = dst % 2 AND src < 0"), 0.95)))
    assert evaluate.recall(narrow, truth).first()["recall"] < 0.9 <= evaluate.recall(wide, truth).first()["recall"]
    assert wide.groupBy("query_id").count().where("count != 10").isEmpty() and wide.agg(F.max("visited")).first()[0] <= 800
    assert parts.drop("visited").exceptAll(truth).isEmpty() and parts.count() == truth.count()
    with pytest.raises(ValueError):
        graph.beam_search(v, edges, q, 0, 10, 10, budget=5, recall=0.95)
