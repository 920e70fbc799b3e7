"""Document fingerprints (operator 1, native): Order MinHash.

A document's k-mers are k consecutive words, numbered by occurrence so that repeats are told apart.  Every numbered k-mer
hashes to a point of a ring.  Component j of the fingerprint starts at its own point of the ring (points are evenly
spaced) and takes the next ``picks`` k-mers: the minimal ones under the order "distance from point j", for
which every k-mer is equally likely to be first.  The picked k-mers are put back in text order and their tuple is hashed, so a component agrees
only if both texts hold the picked k-mers in one order: likeness (the share of equal components) follows edit
distance, not just overlap.

All of it is array expressions on the JVM: one sort of the k-mers for occurrence numbers, one for the ring with the
start points sorted in, no exploded rows.  The next document is found by dealing ids to ranges (bounds from a
distributed quantile) with a copy of each range's first row handed to the range before it, so no window spans the table.
Bounds and first rows are array literals, looked up by place, so the plan has the same size for any number of ranges.

Null text: empty.  A text under k words: its whole word sequence is the one k-mer (for no words, of nothing); components wrap round the ring.
Equal texts have equal fingerprints.  Null doc_id: after all others in descending order.  Rows with one doc_id follow each other by text.
One row: its next document is itself.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

GRAM, PICKS, COMPONENTS = 3, 2, 64
#: low bits of a packed value hold the place in the text, the upper ones the hash
PLACE_BITS = 26
PLACE = (1 << PLACE_BITS) - 1
HASH_BITS = 62 - PLACE_BITS
WORD_BREAK = r"[\x20\x09-\x0D]+"


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, picks: int = PICKS, components: int = COMPONENTS) -> DataFrame:
    """Adds ``out``: 8 hexadecimal digits a component.  Works in named steps so that no array is computed twice."""
    names = [f"__{out}_{x}" for x in ("words", "grams", "starts", "ring", "sorted", "points")]
    words, grams, starts, ring, merged, points = names
    long = "long"
    df = df.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAK), ""))
    w = F.col(words)
    last = F.greatest(F.size(w) - gram, F.lit(0))
    one = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(gram)))
    df = df.withColumn(grams, F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _packed(one(i), i))))
    g = F.col(grams)
    gram_at = lambda i: F.shiftright(F.get(g, i), PLACE_BITS)
    df = df.withColumn(starts, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (gram_at(i) != gram_at(i - 1))))
    s = F.col(starts)
    # k-mers numbered by occurrence, as points of the ring
    numbered = F.flatten(F.transform(s, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(s, r + 1), F.size(g)) - 1), lambda i: _packed(F.xxhash64(gram_at(i), i - a), F.get(g, i).bitwiseAND(F.lit(PLACE))))))
    df = df.withColumn(ring, F.sort_array(numbered))
    # a start point is packed with place 0 minus 1: just below every k-mer of the same hash
    step = 1 << (62 - (components - 1).bit_length())
    marks = F.array(*(F.lit(j * step - 1).cast(long) for j in range(components)))
    df = df.withColumn(merged, F.sort_array(F.concat(F.col(ring), marks)))
    m = F.col(merged)
    mark = lambda x: ((x + 1) % F.lit(step)) == 0
    df = df.withColumn(points, F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: mark(F.get(m, i))))
    r, p = F.col(ring), F.col(points)
    n = F.size(r)

    def component(at: Column, j: Column) -> Column:
        picked = [F.get(r, (at - j + t) % n) for t in range(picks)]
        in_order = F.sort_array(F.array(*(F.shiftleft(x.bitwiseAND(F.lit(PLACE)), HASH_BITS).bitwiseOR(F.shiftright(x, PLACE_BITS)) for x in picked)))
        only = F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
        return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(only))), 16, "0"), 1, 8)

    df = df.withColumn(out, F.array_join(F.transform(F.slice(p, 1, components), component), ""))
    return df.drop(*names)


def likeness(a: str, b: str, components: int = COMPONENTS) -> Column:
    """Share of equal components of two fingerprint columns."""
    same = lambda i: F.when(F.substring(F.col(a), i * 8 + 1, F.lit(8)) == F.substring(F.col(b), i * 8 + 1, F.lit(8)), 1.0).otherwise(0.0)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(components - 1)), same), F.lit(0.0), lambda x, y: x + y) / components


def _literal(values: list, kind: str) -> Column:
    """An array literal: one node of the plan, however long it is."""
    written = ",".join("" if x is None else repr(x) for x in values)
    return F.split(F.lit(written), ",").try_cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>: of the next row by descending doc_id (then ascending text); after the last row, of the first."""
    spark = df.sparkSession
    n = C.shuffle_partitions(spark) * 2
    bounds = df.select(F.percentile_approx(F.col("doc_id"), _literal([i / n for i in range(1, n)], "double"), max(10_000, 8 * n))).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    step = int(len(bounds) ** 0.5) + 1
    below = lambda x: F.size(F.filter(x, lambda b: F.col("doc_id") < b))
    passed = below(_literal(bounds[step - 1 :: step], "bigint")) * step  # every step-th bound first, then those up to the next
    key = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(passed + below(F.slice(_literal(bounds, "bigint"), passed + 1, step)))
    df = df.withColumn("__own", key)
    order = [F.col("doc_id").isNull().cast("int"), -F.col("doc_id").cast("decimal(20,0)"), F.xxhash64("doc_id", "text")]
    ids = df.select(F.struct(*(c.alias(x) for c, x in zip(order, "abc"))).alias("o"), F.col("__own").alias("range"))
    firsts = [(x["range"], x["o"]) for x in ids.groupBy("range").agg(F.min("o").alias("o")).orderBy("range").collect()]  # a row a range, n at most
    if not firsts:
        return df.drop("__own").select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    first = {r: (o, firsts[i - 1][0]) for i, (r, o) in enumerate(firsts)}
    every = [first.get(r) for r in range(len(bounds) + 1)]
    ids_of = _literal([None if x is None or x[0][1] is None else int(-x[0][1]) for x in every], "bigint")
    hash_of = _literal([x and x[0][2] for x in every], "bigint")
    before = _literal([x and x[1] for x in every], "int")
    is_first = F.col("doc_id").eqNullSafe(F.get(ids_of, "__own")) & (order[2] == F.get(hash_of, "__own"))
    own = F.struct(F.col("__own").cast("int").alias("range"), F.lit(False).alias("copy"))
    extra = F.when(is_first, F.struct(F.get(before, "__own").alias("range"), F.lit(True).alias("copy")))
    both = df.withColumn("__at", F.explode(F.filter(F.array(own, extra), lambda x: x.isNotNull()))).select("*", F.col("__at.range").alias("__range"), F.col("__at.copy").alias("__copy")).drop("__at", "__own")
    w = W.partitionBy("__range").orderBy(F.col("__copy"), *order)
    out = both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead(F.lit(1)).over(w).alias("__has"))
    return out.where(~F.col("__copy")).drop("__range", "__copy", "__has")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_fingerprint(docs, "text", "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "fingerprint", "next_fingerprint")
    df = with_fingerprint(df, "edited", "edited_fingerprint")
    return df.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
