"""Distances and budgets as column expressions.  Sums run in double precision, in component order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - _dot(a, b) / (na * nb))


def distance(metric: str):
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    return l2_distance if metric == "l2" else cosine_distance


def scaled_to(v: Column, norm: float) -> Column:
    """``v`` with another length; a zero vector stays."""
    n = F.sqrt(_dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x * norm / n).cast("float")))


def visit_budget(ef: Column, rows: Column, share: Column) -> Column:
    """Rows a filtered approximate search may score, from the filter's share of rows."""
    return F.least(F.least(F.lit(10000), rows), F.greatest(ef, F.bround(4 * ef / F.greatest(share, F.lit(1e-4))))).cast("long")


def retry_budget(budget: Column) -> Column:
    return F.least(F.lit(20000), F.greatest(2 * budget, F.lit(5000))).cast("long")


def retry_ef(ef: Column, target_k: Column) -> Column:
    """Width of the second try, for queries that found too few."""
    return F.greatest(ef, 2 * target_k).cast("long")


def post_filter_ef(k: int, share: Column, c: float = 1.0) -> Column:
    return F.least(F.lit(10000), F.greatest(F.lit(k), F.bround(c * k / share))).cast("long")


def node_level(node_id: Column, m: int = 16, seed: int = 42) -> Column:
    """Top layer of a node, drawn from a hash of its id: geometric with ratio 1 / m."""
    u = (F.conv(F.substring(F.md5(F.concat(node_id.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    return F.floor(-F.log(u) / F.log(F.lit(float(m)))).cast("int")


def register(df: DataFrame, view: str = "nearfield_vectors") -> None:
    """SQL functions l2_distance(a, b), cosine_distance(a, b) and the table function knn(query, k): node_id, distance, rank by l2 over ``df`` (node_id, embedding)."""
    term = "zip_with(a, b, (x, y) -> {})"
    fold = "aggregate({}, 0D, (s, x) -> s + x)"
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    spark = df.sparkSession
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt({fold.format(term.format('(double(x) - double(y)) * (double(x) - double(y))'))})")
    aa, bb, ab = dot.format("a", "a"), dot.format("b", "b"), dot.format("a", "b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN {aa} = 0 OR {bb} = 0 THEN 1D ELSE 1D - {ab} / (sqrt({aa}) * sqrt({bb})) END")
    df.select("node_id", "embedding").createOrReplaceTempView(view)
    # two levels of ranks: the k best of each of 1,024 hash ranges first, so that no task sees all rows
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION knn(query ARRAY<FLOAT>, k INT) RETURNS TABLE(node_id BIGINT, distance DOUBLE, rank INT) RETURN
        SELECT node_id, d, r FROM (SELECT node_id, d, row_number() OVER (ORDER BY d, node_id) AS r FROM
            (SELECT node_id, d, row_number() OVER (PARTITION BY pmod(xxhash64(node_id), 1024) ORDER BY d, node_id) AS p FROM
                (SELECT v.node_id, l2_distance(query, v.embedding) AS d FROM {view} v)) WHERE p <= k) WHERE r <= k"""
    )
