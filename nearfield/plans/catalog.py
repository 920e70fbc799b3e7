"""The engine's queries over the driver tables, each with its DuckDB equivalent.

``vectors`` is ``embeddings`` with node_id = vec_id and a second field m5 = vec_id % 5; the query set is every row whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..model import dim_violations as dim_rows
from ..operators import evaluate, exact, filters, graph, routing, store
from ..shipping import ready

EVERY, K = 50, 10
_TERM = "list_transform(list_zip({0}, {1}), lambda z: {2})"
_DOT = "list_sum(" + _TERM.format("{0}", "{1}", "z[1]::DOUBLE * z[2]::DOUBLE") + ")"


def _l2(a: str, b: str) -> str:
    return "sqrt(list_sum(" + _TERM.format(a, b, "(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)") + "))"


def _cosine(a: str, b: str) -> str:
    na, nb = _DOT.format(a, a), _DOT.format(b, b)
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_DOT.format(a, b)} / (sqrt({na}) * sqrt({nb})) END"


_V = "v AS (SELECT vec_id AS node_id, embedding, label, (vec_id % 5)::INT AS m5 FROM embeddings)"
_S = "v AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: (x * (1 + vec_id % 7))::FLOAT) AS embedding, label FROM embeddings)"
_Q = f"q AS (SELECT node_id AS query_id, embedding AS query FROM v WHERE node_id % {EVERY} = 0)"


def _hits(where: str = "TRUE", metric: str = "l2", k: int = K, base: str = _V, q: str = _Q, extra: str = "") -> str:
    d = (_l2 if metric == "l2" else _cosine)("query", "embedding")
    return f"WITH {base}, {q}{extra}, s AS (SELECT query_id, node_id, {d} AS distance FROM q, v WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, node_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, node_id, distance FROM r WHERE rank <= {k}"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = ready(spark).read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("node_id"), "embedding", "label", (F.col("vec_id") % 5).cast("int").alias("m5"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.col("node_id") % 7)).cast("float")))


def asked(v: DataFrame) -> DataFrame:
    return v.where(F.col("node_id") % EVERY == 0).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("query"))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_hits())
def knn_l2(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), K)


@query(_hits(metric="cosine"))
def knn_cosine(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), K, "cosine")


@query(_hits(base=_S))
def knn_l2_scaled(spark, sf):
    v = scaled(spark, sf)
    return exact.knn(v, asked(v), K)


@query(_hits(base=_S, metric="cosine"))
def knn_cosine_scaled(spark, sf):
    v = scaled(spark, sf)
    return exact.knn(v, asked(v), K, "cosine")


@query(_hits())
def knn_arrow(spark, sf):
    v = vectors(spark, sf)
    return exact.knn_arrow(v, asked(v), K)


_O = "v AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: (1000 + x / 100)::FLOAT) AS embedding FROM embeddings)"


def offset(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors far from the origin and close together: what a product in single precision can't tell apart."""
    return vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: (1000 + x / 100).cast("float")))


@query(_hits(base=_O))
def knn_offset(spark, sf):
    v = offset(spark, sf)
    return exact.knn(v, asked(v), K)


@query(_hits(base=_O))
def knn_arrow_offset(spark, sf):
    v = offset(spark, sf)
    return exact.knn_arrow(v, asked(v), K)


@query(_hits(metric="cosine"))
def knn_arrow_cosine(spark, sf):
    v = vectors(spark, sf)
    return exact.knn_arrow(v, asked(v), K, "cosine")


@query(_hits("label = 3"))
def knn_filtered_label(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), K, spec={"label": 3})


@query(_hits("label = 3 AND m5 = 2"))
def knn_filtered_and(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), K, spec={"label": 3, "m5": 2})


@query(_hits("query_id % 3 = 0 OR label = (query_id // 50) % 10"))
def knn_per_query_filter(spark, sf):
    v = vectors(spark, sf).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    wanted = F.when(F.col("query_id") % 3 == 0, F.lit(None)).otherwise(F.create_map(F.lit("label"), F.expr("CAST((query_id DIV 50) % 10 AS STRING)")))
    return exact.knn(v, asked(v).withColumn("asked", wanted), K, match=filters.per_query(F.col("asked"), F.col("metadata")))


@query(_hits("label = 3 AND m5 = 2", k=100000))
def knn_k_gt_n(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), 100000, spec={"label": 3, "m5": 2})


@query("SELECT 0::BIGINT AS n")
def knn_empty_filter_result(spark, sf):
    v = vectors(spark, sf)
    return exact.knn(v, asked(v), K, spec={"label": 99}).agg(F.count(F.lit(1)).alias("n"))


@query(_hits("node_id % 10 != 0"))
def knn_tombstones(spark, sf):
    v = vectors(spark, sf)
    gone = v.where("node_id % 10 = 0").select("node_id")
    return exact.knn(v.join(gone, "node_id", "left_anti"), asked(v), K)


@query("SELECT vec_id AS node_id, label, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, sf):
    return vectors(spark, sf).where("node_id = 7").select("node_id", "label", F.col("embedding")[0].cast("double").alias("first"))


_LOG = """log AS (SELECT vec_id AS seq, 'I' AS op, vec_id AS node_id, embedding, label FROM embeddings
  UNION ALL SELECT 1000000 + vec_id, 'D', vec_id, NULL, NULL FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL SELECT 2000000 + vec_id, 'I', vec_id, list_transform(embedding, lambda x: (x * 2)::FLOAT), label FROM embeddings WHERE vec_id % 20 = 0),
 last AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS n FROM log),
 v AS (SELECT node_id, embedding, label, seq, op FROM last WHERE n = 1)"""


def log(spark, sf):
    v = vectors(spark, sf).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    none, row = F.lit(None).cast("array<float>"), ("embedding", "metadata")
    one = v.select(F.col("node_id").alias("seq"), F.lit("I").alias("op"), "node_id", *row)
    two = v.where("node_id % 10 = 0").select((F.col("node_id") + 1000000).alias("seq"), F.lit("D").alias("op"), "node_id", none.alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"))
    three = v.where("node_id % 20 = 0").select((F.col("node_id") + 2000000).alias("seq"), F.lit("I").alias("op"), "node_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"), "metadata")
    return one.unionByName(two).unionByName(three)


@query(f"WITH {_LOG} SELECT node_id, seq, op, embedding[1]::DOUBLE AS first FROM v")
def upsert_fold(spark, sf):
    return store.fold(log(spark, sf)).select("node_id", "seq", "op", F.col("embedding")[0].cast("double").alias("first"))


@query(_hits("op = 'I'", base=_LOG, q=f"q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % {EVERY} = 0)"))
def knn_after_replay(spark, sf):
    changes = log(spark, sf)
    base = store.live(changes.where("seq < 1000000"))
    return exact.knn(store.replayed(base, changes.where("seq >= 1000000")), asked(vectors(spark, sf)), K)


@query("SELECT count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings WHERE vec_id % 10 != 0")
def compact_rows(spark, sf):
    v = vectors(spark, sf)
    rows, _ = store.compact(v, _ring(v), v.where("node_id % 10 = 0"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))


def _ring(v: DataFrame) -> DataFrame:
    """Edges to the ids one and seven further, where both exist."""
    ids = v.select(F.col("node_id").alias("dst"))
    return v.select(F.col("node_id").alias("src"), F.explode(F.array(F.col("node_id") + 1, F.col("node_id") + 7)).alias("dst")).join(ids, "dst").select("src", "dst")


_RING = "e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 7))"


@query(f"WITH {_RING} SELECT src, dst FROM e WHERE src % 10 != 0 AND dst % 10 != 0")
def compact_edges(spark, sf):
    v = vectors(spark, sf)
    return store.compact(v, _ring(v), v.where("node_id % 10 = 0"))[1]


@query("SELECT 'label' AS field, 'n:' || label::VARCHAR AS value, count(*) AS n FROM embeddings GROUP BY 2 UNION ALL SELECT 'm5', 'n:' || (vec_id % 5)::VARCHAR, count(*) FROM embeddings GROUP BY 2")
def postings_counts(spark, sf):
    return filters.postings(vectors(spark, sf), ["label", "m5"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM embeddings WHERE label = 3 AND vec_id % 5 = 2")
def postings_and_bitmap(spark, sf):
    maps = filters.bitmaps(filters.postings(vectors(spark, sf), ["label", "m5"]))
    return filters.bitmap_and(maps, {"label": 3, "m5": 2}).agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias("n"))


def _kinds(spark, sf):
    """A boolean, a float and a string field, the string written like a number."""
    return vectors(spark, sf).select("node_id", (F.col("node_id") % 2 == 0).alias("even"), (F.col("label") / 4.0).alias("quarter"), F.col("label").cast("string").alias("written"), "label")


@query("SELECT count(*) FILTER (vec_id % 2 = 0 AND label / 4.0 = 0.75) AS both, 0::BIGINT + count(*) FILTER (label / 4.0 = 1) AS whole, count(*) FILTER (label::VARCHAR = '3') AS written FROM embeddings")
def bitmaps_of_kinds(spark, sf):
    v = _kinds(spark, sf)
    maps = filters.bitmaps(filters.postings(v, ["even", "quarter", "written"]))
    n = lambda spec, name: filters.bitmap_and(maps, spec).agg(F.coalesce(F.sum(F.expr("bitmap_count(bits)")), F.lit(0)).alias(name))
    return n({"even": True, "quarter": 0.75}, "both").join(n({"quarter": 1}, "whole")).join(n({"written": "3"}, "written"))  # one row each


@query("SELECT count(*) FILTER (vec_id % 2 = 0) AS even, count(*) FILTER (label = 1) AS label_true, count(*) FILTER (label::VARCHAR = '3') AS written, (SELECT count(*) FROM embeddings WHERE label::VARCHAR = 'x') AS other FROM embeddings")
def filter_kinds(spark, sf):
    v = _kinds(spark, sf)
    return v.agg(F.count_if(filters.predicate(v, {"even": 1.0})).alias("even"), F.count_if(filters.predicate(v, {"label": True})).alias("label_true"), F.count_if(filters.predicate(v, {"written": "3"})).alias("written"), F.count_if(filters.predicate(v, {"written": 3}) | filters.predicate(v, {"label": "3"})).alias("other"))


@query(
    """WITH c AS (SELECT count(*) AS rows, count(*) FILTER (label = 3) AS matches FROM embeddings), s AS (SELECT *, matches / rows AS share FROM c),
 b AS (SELECT *, least(10, matches)::BIGINT AS target_k, least(least(10000, rows), greatest(50, round_even(4 * 50 / greatest(share, 1e-4), 0)))::BIGINT AS budget FROM s)
 SELECT rows, matches, share, target_k, budget, least(20000, greatest(2 * budget, 5000))::BIGINT AS retry, CASE WHEN matches = 0 THEN 'empty' WHEN matches <= 20 THEN 'exact' ELSE 'approximate' END AS route FROM b"""
)
def route_decision(spark, sf):
    return routing.route(vectors(spark, sf), {"label": 3}, threshold=20)


_POST = _hits(k=100).replace("SELECT query_id, rank::INT AS rank, node_id, distance FROM r WHERE rank <= 100", "")
_POST_SQL = _POST + ", p AS (SELECT r.query_id, r.node_id, r.distance, row_number() OVER (PARTITION BY r.query_id ORDER BY r.distance, r.node_id) AS n FROM r JOIN v USING (node_id) WHERE r.rank <= 100 AND v.label = 3)"


@query(_POST_SQL + " SELECT query_id, n::INT AS rank, node_id, distance FROM p WHERE n <= 10")
def post_filter_knn(spark, sf):
    v = vectors(spark, sf)
    return exact.post_filter_knn(v, asked(v), K, 100, {"label": 3})


@query(
    _POST_SQL
    + ", t AS (SELECT r.query_id, r.node_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.distance, r.node_id) AS n FROM r JOIN v USING (node_id) WHERE v.label = 3), g AS (SELECT t.query_id, count(p.node_id) / count(*) AS recall FROM t LEFT JOIN (SELECT * FROM p WHERE n <= 10) p ON p.query_id = t.query_id AND p.node_id = t.node_id WHERE t.n <= 10 GROUP BY 1) SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall FROM g"
)
def recall_at_k(spark, sf):
    v = vectors(spark, sf)
    return evaluate.recall(exact.post_filter_knn(v, asked(v), K, 100, {"label": 3}), exact.knn(v, asked(v), K, spec={"label": 3}))


_GRAPH = f"WITH {_V}, d AS (SELECT a.node_id AS src, b.node_id AS dst, {_l2('a.embedding', 'b.embedding')} AS distance FROM v a, v b WHERE a.node_id != b.node_id), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d), g AS (SELECT src, dst, distance, rank FROM n WHERE rank <= 8)"
_PRUNED = _GRAPH + ", b AS (SELECT src, dst, min(distance) AS distance FROM (SELECT src, dst, distance FROM g UNION ALL SELECT dst, src, distance FROM g) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM b)"


@query(_GRAPH + " SELECT src, dst, distance, rank::INT AS rank FROM g")
def knn_graph_closest_m(spark, sf):
    return graph.closest(vectors(spark, sf), 8).withColumn("rank", F.col("rank").cast("int"))


@query(_PRUNED + " SELECT src, dst, distance, rank::INT AS rank FROM o WHERE rank <= 12")
def graph_reverse_prune(spark, sf):
    return graph.reverse_prune(graph.closest(vectors(spark, sf), 8), 12).withColumn("rank", F.col("rank").cast("int"))


_BRIDGED = "x(src, dst) AS (SELECT src, dst FROM g WHERE src % 10 != 0 AND dst % 10 = 0 UNION SELECT x.src, g.dst FROM x JOIN g ON g.src = x.dst WHERE x.dst % 10 = 0 AND g.dst != x.src)"


@query(
    "WITH RECURSIVE " + _GRAPH.removeprefix("WITH ") + f", {_BRIDGED}, c AS (SELECT src, dst FROM x WHERE dst % 10 != 0 UNION SELECT src, dst FROM g WHERE src % 10 != 0 AND dst % 10 != 0)"
    " SELECT src, dst, distance FROM (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM c JOIN d USING (src, dst)) WHERE rank <= 9"
)
def healed_edges(spark, sf):
    v = vectors(spark, sf)
    return graph.healed(graph.closest(v, 8), v, v.where("node_id % 10 = 0"), 9)


_NEAR = f"d AS (SELECT a.node_id AS src, b.node_id AS id, b.embedding AS v, {_l2('a.embedding', 'b.embedding')} AS d FROM v a, v b WHERE a.node_id != b.node_id), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, id) AS rank FROM d), c AS (SELECT src, list({{'d': d, 'id': id, 'v': v}} ORDER BY rank) AS c FROM n WHERE rank <= 30 GROUP BY src)"
_STEP = f"SELECT s.src, s.i + 1 AS i, s.chosen, s.rest, c.c[s.i + 1] AS x, len(s.chosen) >= 8 AS whole, len(list_filter(s.chosen, lambda r: {_l2('c.c[s.i + 1].v', 'r.v')} < c.c[s.i + 1].d)) > 0 AS bad FROM s JOIN c ON c.src = s.src WHERE s.i < len(c.c)"


@query(
    f"WITH RECURSIVE {_V}, {_NEAR}, s AS (SELECT src, 0::BIGINT AS i, c[1:0] AS chosen, c[1:0] AS rest FROM c UNION ALL SELECT src, i, CASE WHEN whole OR bad THEN chosen ELSE list_append(chosen, x) END, CASE WHEN bad AND NOT whole THEN list_append(rest, x) ELSE rest END FROM ({_STEP}))"
    " SELECT src, p.id AS dst, p.d AS distance FROM (SELECT src, unnest(list_concat(chosen, rest)[1:8]) AS p FROM (SELECT s.src, s.chosen, s.rest FROM s JOIN c ON c.src = s.src WHERE s.i = len(c.c)))"
)
def graph_diverse_m(spark, sf):
    v = vectors(spark, sf)
    return graph.diverse(graph.closest(v, 30), v, 8)


@query("SELECT count(*) AS nodes, true AS good FROM embeddings")
def graph_candidates_recall(spark, sf):
    """Share of the 10 nearest others that the cells' candidates hold: 0.9 or more."""
    v = vectors(spark, sf)
    name = {"src": "query_id", "dst": "node_id"}
    r = evaluate.recall(graph.candidates(v, K).withColumnsRenamed(name), graph.closest(v, K).withColumnsRenamed(name))
    return r.select(F.col("n_queries").alias("nodes"), (F.col("recall") >= 0.9).alias("good"))


@query("SELECT vec_id AS node_id, floor(-ln((('0x' || substr(md5(vec_id::VARCHAR || ':42'), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) / ln(16.0::DOUBLE))::INT AS level FROM embeddings")
def node_levels(spark, sf):
    return graph.levels(vectors(spark, sf))


@query(_PRUNED + ", c AS (SELECT src, count(*) AS degree FROM o WHERE rank <= 12 GROUP BY 1) SELECT count(*) AS nodes, sum(degree)::BIGINT AS edges, round(avg(degree), 6) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM c")
def degree_stats(spark, sf):
    return graph.degree_stats(graph.reverse_prune(graph.closest(vectors(spark, sf), 8), 12))


@query(_GRAPH + " SELECT count(*) AS edges FROM g")
def edge_count(spark, sf):
    return graph.closest(vectors(spark, sf), 8).agg(F.count(F.lit(1)).alias("edges"))


@query("WITH RECURSIVE " + _PRUNED.removeprefix("WITH ") + ", w(node_id) AS (SELECT 0::BIGINT UNION SELECT o.dst FROM w JOIN o ON o.src = w.node_id AND o.rank <= 12) SELECT count(*) AS reached FROM w")
def reachability(spark, sf):
    edges = graph.reverse_prune(graph.closest(vectors(spark, sf), 8), 12).select("src", "dst").persist()
    return graph.reachable(edges, 0).agg(F.count(F.lit(1)).alias("reached"))


@query("SELECT 0::BIGINT AS dangling, 0::BIGINT AS loops")
def graph_invariants(spark, sf):
    v = vectors(spark, sf)
    rows, edges = store.compact(v, graph.closest(v, 8), v.where("node_id % 10 = 0"))
    return graph.violations(edges, rows)


_MEAN = "c AS (SELECT i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1)"


@query(f"WITH {_MEAN} SELECT pos::INT AS pos, mean FROM c")
def centroid(spark, sf):
    return evaluate.centroid(vectors(spark, sf))


@query(f"WITH {_MEAN}, m AS (SELECT list(mean ORDER BY pos) AS c FROM c), {_V} SELECT node_id, {_l2('embedding', 'c')} AS distance FROM v, m ORDER BY distance, node_id LIMIT 50")
def correlated_subset(spark, sf):
    return evaluate.nearest_to_centroid(vectors(spark, sf), 50)


@query("SELECT vec_id AS node_id FROM embeddings WHERE vec_id % 10 = 0")
def uncorrelated_subset(spark, sf):
    return vectors(spark, sf).where("node_id % 10 = 0").select("node_id")


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events")
def latency_percentiles(spark, sf):
    return evaluate.percentiles(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("WITH m AS (SELECT quantile_cont(value, 0.5) AS middle FROM events) SELECT count(*) AS n, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max FROM events, m WHERE value >= 0.5 * middle")
def robust_range(spark, sf):
    return evaluate.robust(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("WITH p AS (SELECT event_type, count(*) AS n, round(count(*) / nullif(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 0), 9) AS per_second FROM events GROUP BY 1) SELECT event_type, n, per_second, round(per_second / max(per_second) OVER (), 6) AS ratio FROM p")
def throughput_ratio(spark, sf):
    return evaluate.throughput(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "ts")


@query(f"WITH l AS ({ORACLE_SQL['node_levels']}) SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 10 != 0) AS size, 64::BIGINT AS dim, max(level) AS max_level FROM l WHERE node_id % 10 != 0")
def index_stats(spark, sf):
    live = vectors(spark, sf).where("node_id % 10 != 0")
    return evaluate.index_stats(live, graph.levels(live))


@query("SELECT count(*) AS n FROM embeddings WHERE len(embedding) != 64")
def dim_violations(spark, sf):
    return dim_rows(vectors(spark, sf), 64).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM embeddings GROUP BY label")
def selectivity(spark, sf):
    v = vectors(spark, sf)
    total = F.lit(v.count())
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


@query(
    "WITH s AS (SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM embeddings GROUP BY label)"
    " SELECT label, least(10000, greatest(10, round_even(10 / share, 0)))::BIGINT AS post_filter, greatest(50, 2 * least(n, 40))::BIGINT AS retry FROM s"
)
def search_widths(spark, sf):
    """Widths that a filter on each label asks for: of a search that filters afterwards (k = 10), and of a second try (ef = 50, k = 40)."""
    s = selectivity(spark, sf)
    return s.select("label", D.post_filter_ef(10, F.col("share")).alias("post_filter"), D.retry_ef(F.lit(50), F.least("n", F.lit(40))).alias("retry"))


@query(f"WITH {_V}, n AS (SELECT node_id, list_transform(embedding, lambda x: (x * 10::DOUBLE / sqrt({_DOT.format('embedding', 'embedding')}))::FLOAT) AS embedding FROM v WHERE {_DOT.format('embedding', 'embedding')} > 0) SELECT node_id, round({_DOT.format('embedding', 'embedding')}, 3) AS square, round(embedding[1]::DOUBLE, 4) AS first FROM n")
def scaled_vectors(spark, sf):
    """Vectors brought to length 10."""
    v = vectors(spark, sf).select("node_id", D.scaled_to(F.col("embedding"), 10.0).alias("e"))
    return v.select("node_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("square"), F.round(F.get("e", F.lit(0)).cast("double"), 4).alias("first")).where("square > 0")


@query()
def ivf_knn(spark, sf):
    v = vectors(spark, sf)
    placed, centres = routing.cells(v, 16)
    return routing.cell_search(placed, centres, asked(v), K, budget=400)


@query()
def routed_knn(spark, sf):
    v = vectors(spark, sf)
    placed, centres = routing.cells(v, 16)
    spec = {"m5": 2}
    return routing.search(v, asked(v), K, 50, spec, threshold=20, approximate=lambda q, k, b: routing.cell_search(placed, centres, q, k, b, spec=spec, recall=graph.RECALL))


@query()
def beam_search_knn(spark, sf):
    v = vectors(spark, sf)
    edges = graph.reverse_prune(graph.closest(v, 16), 32).select("src", "dst").persist()
    start = graph.entry_point(graph.levels(v)).first()["entry_point"]
    return graph.beam_search(v, edges, asked(v), start, K, 50)


_GOOD = f"SELECT count(*) AS n_queries, true AS good FROM embeddings WHERE vec_id % {EVERY} = 0"


def _good(found: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.recall(found, truth).select("n_queries", (F.col("recall") >= 0.9).alias("good"))


@query(_GOOD)
def beam_search_recall(spark, sf):
    """The layered graph, its descent and a beam of 100, widened where a sample of queries needs it, against the exact hits: recall 0.9 or more."""
    v = vectors(spark, sf)
    edges = graph._cut(graph.build(v, m=16, ef_construction=60))
    top = graph.entry_point(graph.levels(v)).first()
    start = graph.descend(v, edges, asked(v), top["entry_point"], top["max_level"])
    return _good(graph.beam_search(v, edges.where("layer = 0"), asked(v), start, K, 100, recall=graph.RECALL), exact.knn(v, asked(v), K))


@query(_GOOD)
def routed_recall(spark, sf):
    """Routed searches under a filter against the exact hits: recall 0.9 or more."""
    v = vectors(spark, sf)
    placed, centres = routing.cells(v, 16)
    spec = {"m5": 2}
    found = routing.search(v, asked(v), K, 50, spec, threshold=20, approximate=lambda q, k, b: routing.cell_search(placed, centres, q, k, b, spec=spec, recall=graph.RECALL))
    return _good(found, exact.knn(v, asked(v), K, spec=spec))
