"""Index behaviour: recall floors, filters, recovery, compaction, streams, formats."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.distance import distance
from nearfield.index import VectorIndex
from nearfield.model import CHANGES, Config, check_filter, tagged
from nearfield.operators import evaluate, exact, graph, routing
from nearfield.operators.store import Store
from nearfield.plans import catalog
from nearfield.sources import formats
from nearfield.streaming import apply as streaming

SF = "/root/testdata/sf0.001"


def frame(spark, x, name="node_id", value="embedding"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, {value} array<float>")


def test_beam_search_recall_and_monotone(spark):
    x = np.random.default_rng(42).standard_normal((600, 16)).astype(np.float32)
    v, q = frame(spark, x).persist(), frame(spark, np.random.default_rng(1).standard_normal((20, 16)), "query_id", "query")
    edges = graph.build(v, m=8, ef_construction=40).where("layer = 0").persist()
    start = graph.entry_point(graph.levels(v)).first()[0]
    truth = exact.knn(v, q, 10).persist()
    seen = []
    for ef in (10, 60):
        hits = graph.beam_search(v, edges, q, start, 10, ef).persist()
        seen.append((evaluate.recall(hits, truth).first()["recall"], hits.agg(F.avg("visited")).first()[0]))
    assert seen[1][0] > 0.9 and seen[1][0] >= seen[0][0] and seen[1][1] > seen[0][1]
    bad = graph.violations(edges, v).first()
    assert (bad["dangling"], bad["loops"]) == (0, 0)


def test_a_long_walk_keeps_its_plans_small(spark, monkeypatch):
    """Each of 30 hops joins what the last one left: the sizes that plans are told must not multiply from hop to hop."""
    v = frame(spark, [[float(i)] for i in range(31)])
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    cut, bits = graph._cut, []

    def told(df):
        out = cut(df)
        size = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        bits.append(size.bit_length() if isinstance(size, int) else size.bitLength())
        return out

    monkeypatch.setattr(graph, "_cut", told)
    hits = graph.beam_search(v, edges, frame(spark, [[30.0]], "query_id", "query"), 0, 3, 4, expand=1).orderBy("rank").collect()
    assert [(r["node_id"], r["visited"]) for r in hits] == [(30, 31), (29, 31), (28, 31)]
    assert len(bits) > 60 and max(bits) < 64


def test_diverse_selection_matches_plain_python(spark):
    x = np.random.default_rng(3).standard_normal((60, 8)).astype(np.float32)
    v = frame(spark, x)
    near = graph.closest(v, 20)
    got = {}
    for r in graph.diverse(near, v, 6).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), d[i])) if j != i][:20]
        chosen, rest = [], []
        for j in order:
            if len(chosen) < 6:
                (rest if any(d[j, r] < d[i, j] for r in chosen) else chosen).append(j)
        assert got[i] == set((chosen + rest)[:6])


def test_routes(spark):
    v = catalog.vectors(spark, SF).persist()
    q = catalog.asked(v)
    placed, centres = routing.cells(v, 8)
    got = routing.search(v, q, 10, 50, {"m5": 2}, threshold=5, approximate=lambda q, k, b: routing.cell_search(placed, centres, q, k, 20, spec={"m5": 2}))
    assert {r["route"] for r in got.select("route").distinct().collect()} <= {"approximate", "retried", "escalated"}
    assert got.groupBy("query_id").count().where("count != 10").isEmpty()
    assert got.join(v.where("m5 != 2"), "node_id").isEmpty()
    assert routing.search(v, q, 10, 50, {"m5": 99}).isEmpty()


def test_index_lifecycle(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((40, 8))
    ix = VectorIndex(spark, f"file://{tmp_path}/ix", Config(M=4))
    assert ix.search(x[0]) == []
    ix.batch_insert(x[:30], metadatas=[{"color": "blue" if i % 2 else "red", "n": i} for i in range(30)])
    assert [h[0] for h in ix.search(x[7], 1)] == [7]
    assert {h[0] % 2 for h in ix.search(x[7], 20, filter={"color": "blue"})} == {1}
    assert [h[0] for h in ix.search(x[7], 5, filter={"n": 3.0})] == [3] and ix.search(x[7], 5, filter={"n": "3"}) == []
    per = ix.batch_search(x[:2], 30, filter={"color": "red"}, filters_=[None, {"color": "blue"}])
    assert len(per[0]) == 30 and len(per[1]) == 15
    with pytest.raises(ValueError):
        ix.insert(3, x[3])
    with pytest.raises(ValueError):
        ix.batch_insert([x[31], [1.0]])
    with pytest.raises(ValueError):
        ix.insert(99, [float("nan")] * 8)
    ix.save_snapshot()
    ix.delete(7), ix.delete(7), ix.delete(555)
    ix.insert(30, x[30])
    again = VectorIndex.load_snapshot(spark, f"file://{tmp_path}/ix")
    assert again.config == Config(M=4) and again.stats()["size"] == 30
    assert 7 not in [h[0] for h in again.search(x[7], 30)] and again.search(x[30], 1)[0][0] == 30
    again.insert(7, x[8])
    assert {h[0] for h in again.search(x[8], 2)} == {7, 8}
    again.delete(1)
    again.compact()
    assert again.stats()["size"] == 30 and again.batch_insert([x[31]]) == [31]


def test_stream_applies_each_batch_once(spark, tmp_path):
    rows = [(i, "I", i % 7, [float(i)] * 4, None) for i in range(20)] + [(20, "D", 3, None, None)]
    for n, part in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    store = Store(spark, f"file://{tmp_path}/store")
    stream = streaming.changes_stream(spark, f"{tmp_path}/in/*", 1)
    for _ in range(2):
        streaming.apply(stream, store, f"{tmp_path}/ck").awaitTermination(60)
    got = {r["node_id"]: r["embedding"][0] for r in store.rows().collect()}
    assert got == {k: max(i for i in range(20) if i % 7 == k) for k in range(7) if k != 3}


def test_formats(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(6, 4)
    for name, y in (("a.fvecs", x), ("a.ivecs", x.astype(np.int32))):
        (tmp_path / name).write_bytes(b"".join(struct.pack("<i", 4) + r.tobytes() for r in y))
    formats.register(spark)
    assert [r["embedding"] for r in spark.read.format("fvecs").load(f"{tmp_path}/a.fvecs").orderBy("node_id").collect()] == x.tolist()
    assert spark.read.format("ivecs").option("maxCount", 2).load(f"{tmp_path}/a.ivecs").count() == 2
    meta = json.dumps({"a": 1, "b": [2]}).encode()
    log = struct.pack("<BI2f", 1, 5, 1, 2) + struct.pack("<BI2fI", 3, 6, 3, 4, len(meta)) + meta + struct.pack("<BI", 2, 5)
    (tmp_path / "log").write_bytes(log + b"\x01\x07")
    got = formats.read_log(spark, f"{tmp_path}/log", 2).orderBy("seq").collect()
    assert [(r["op"], r["node_id"]) for r in got] == [("I", 5), ("I", 6), ("D", 5)] and got[1]["metadata"] == {"a": "n:1.0"}
    with pytest.raises(ValueError):
        formats.parse_log(b"\x09\0\0\0\0", 2)
    a, b = (formats.gaussian_mixture(spark, 50, 4, 3).repartition(n).orderBy("node_id").collect() for n in (1, 3))
    assert a == b and len(a) == 50


def test_checks():
    assert check_filter(None) == {} and tagged(True) == tagged(1) == tagged(1.0) != tagged("1")
    for bad in ([], {"": 1}, {"a": None}, {"a": [1]}):
        with pytest.raises(ValueError):
            check_filter(bad)
    with pytest.raises(ValueError):
        Config(M=1)
    with pytest.raises(ValueError):
        Config(metric="dot")


def test_exact_edges(spark):
    with pytest.raises(ValueError):
        exact.ExactKNN(spark, "dot")
    e = exact.ExactKNN(spark, "cosine")
    assert e.search([1, 0]) == []
    e.add(0, [0, 0]), e.add(1, [2, 0]), e.add(2, [1, 0])
    assert e.search([1, 0], 5) == [(1, 0.0), (2, 0.0), (0, 1.0)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_kernel_keeps_copies_and_near_copies(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[::3] = x[0]  # a hot vector
    x[1:900:3] = x[1] + (1e-5 * rng.standard_normal((300, 16))).astype(np.float32)  # tight near copies
    x[2], x[5] = 0, 0
    v = frame(spark, x).coalesce(1).persist()
    q = frame(spark, x[[0, 1, 2, 4, 8, 300]], "query_id", "query")
    want = exact.knn(v, q, 10, metric).orderBy("query_id", "rank").collect()
    assert exact.knn_arrow(v, q, 10, metric).orderBy("query_id", "rank").collect() == want
    if metric == "l2":
        assert [r["node_id"] for r in want[:10]] == list(range(0, 30, 3))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_more_than_a_few_queries_take_the_kernel(spark, metric):
    rng = np.random.default_rng(6)
    rows = [(i, [float(y) for y in rng.standard_normal(4 if i % 3 else 6)]) for i in range(120)]
    v = spark.createDataFrame(rows, "node_id long, embedding array<float>").persist()
    q = v.toDF("query_id", "query").persist()
    got = exact.knn(v, q, 5, metric)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    pairs = v.join(q, F.size("query") == F.size("embedding")).select("query_id", "node_id", distance(metric)(F.col("query"), F.col("embedding")).alias("distance"))
    want = exact.top_k(pairs, 5).select("query_id", F.col("rank").cast("int").alias("rank"), "node_id", "distance")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    unnamed = v.union(spark.createDataFrame([(None, rows[0][1])], v.schema))
    assert exact.knn(unnamed, q, 5, metric).where("query_id = 0 AND node_id IS NULL").count() == 1
