"""Metadata filters: conjunctions of equalities, their postings and bitmaps, and filters that differ by query."""

from __future__ import annotations

from collections import OrderedDict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import check_filter, tagged

_KINDS = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}


def _equal(df: DataFrame, field: str, value) -> Column:
    """A real column against a value of the filter: numbers and booleans equal each other, never a string."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.StringType) or isinstance(value, str):
        same = isinstance(kind, T.StringType) and isinstance(value, str)
        return F.col(field) == F.lit(value) if same else F.lit(False)
    if isinstance(kind, T.BooleanType):
        return F.col(field) == F.lit(bool(value)) if value in (0, 1) else F.lit(False)
    return F.col(field) == F.lit(int(value) if isinstance(value, bool) else value) if isinstance(kind, T.NumericType) else F.lit(False)


def predicate(df: DataFrame, spec: dict | None) -> Column:
    """The filter as a column: fields that are columns compare as such (and reach the scan), others in ``metadata``."""
    terms = [_equal(df, k, v) if k in df.columns else F.coalesce(F.col("metadata")[k] == F.lit(tagged(v)), F.lit(False)) for k, v in check_filter(spec).items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def where(df: DataFrame, spec: dict | None) -> DataFrame:
    return df.where(predicate(df, spec)) if spec else df


def per_query(query_filter: Column, metadata: Column) -> Column:
    """Whether a row's metadata holds all that the query's map asks; a null map asks nothing."""
    return query_filter.isNull() | F.forall(F.map_entries(query_filter), lambda e: F.coalesce(metadata[e["key"]] == e["value"], F.lit(False)))


def typed(value: Column, kind: T.DataType) -> Column:
    """A value as text that keeps its kind: n: for numbers and booleans (1 = 1.0 = true), s: for strings; null for what is no scalar."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s:"), value)
    if isinstance(kind, T.BooleanType | T.IntegralType):
        return F.concat(F.lit("n:"), value.cast("bigint").cast("string"))
    if not isinstance(kind, T.NumericType):
        return F.lit(None).cast("string")
    x = value.cast("double")
    return F.concat(F.lit("n:"), F.when((x == F.floor(x)) & (F.abs(x) < 2.0**62), x.cast("bigint").cast("string")).otherwise(x.cast("string")))


def postings(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value (typed), node_id of every field of every row."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), typed(F.col(f), df.schema[f].dataType).alias("value")) for f in fields))
    return df.select("node_id", F.explode(pairs).alias("p")).select("p.field", "p.value", "node_id").where("value IS NOT NULL")


def bitmaps(posted: DataFrame) -> DataFrame:
    """A bitmap of node ids for each field, value and range of 32,768 ids."""
    at = F.expr("bitmap_bucket_number(node_id)")
    return posted.groupBy("field", "value", at.alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(node_id))").alias("bits"))


def bitmap_and(maps: DataFrame, spec: dict) -> DataFrame:
    """bucket, bits of the ids that have every field of ``spec``."""
    named = reduce(lambda a, b: a | b, ((F.col("field") == k) & (F.col("value") == typed(F.lit(v), _KINDS[type(v)])) for k, v in check_filter(spec).items()))
    return maps.where(named).groupBy("bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(spec)).drop("n")


class FilterCache:
    """Persisted filtered frames of one version of the data, the least recently used dropped first (by number, and by bytes that they may take)."""

    def __init__(self, max_entries: int = 16, max_bytes: int = 256 << 20):
        self.max_entries, self.max_bytes, self.kept, self.version = max_entries, max_bytes, OrderedDict(), None
        self.hits = self.misses = 0

    def get(self, df: DataFrame, spec: dict, version) -> DataFrame:
        """Rows of ``df`` that pass; a new version drops all frames of the one before."""
        if version != self.version:
            self.clear()
            self.version = version
        key = tuple(sorted((k, tagged(v)) for k, v in check_filter(spec).items()))
        if key in self.kept:
            self.hits += 1
        else:
            self.misses += 1
            found = where(df, spec).persist()
            size = found.agg(F.sum(8 * F.size("embedding") + 64)).first()[0] or 0
            if size > self.max_bytes:
                return found.unpersist()
            self.kept[key] = found, size
        self.kept.move_to_end(key)
        while len(self.kept) > self.max_entries or sum(n for _, n in self.kept.values()) > self.max_bytes:
            self.kept.popitem(last=False)[1][0].unpersist()
        return self.kept[key][0]

    def clear(self) -> None:
        while self.kept:
            self.kept.popitem()[1][0].unpersist()
