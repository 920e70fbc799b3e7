"""Quality classifier (operator 9): a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)): all pairwise interactions at
rank ``RANK`` in time linear in the number of features of a text (the sum-of-squares identity).

Features of a whole text: its distinct words hashed to 2**BITS slots (each 1 / sqrt(number of words)), structure statistics
(lengths, shares of letters, capitals, digits, symbols, repeats, line shape), each also cut into bins, and as metadata its length class.  Labels, lang,
source and doc_id are never inputs.

Fitting takes at most ``SAMPLE`` labelled rows whose crc32(doc_id) mod 5 is not 0, those with the smallest hash of doc_id (then of the text), and
of these, in that order, as many as have ``SLOTS`` features together: documented bounds, so the driver holds at most 12 * SLOTS bytes of
features.  Scoring runs over all rows with the fitted numbers (2 MB at any input).

Null or empty text: scored by its (zero) statistics.  Null doc_id: not held out (crc32 of nothing), scored.  No usable labels: score 0.5.  Rows with one
doc_id: a row each, and each a labelled row of its own; of several labels of one doc_id the largest counts.  Ties of the hash go to the smaller doc_id.
Very long texts: read whole, one at a time; a text has at most WORDS word slots.  Empty table: empty result.  Extra columns are carried; the score takes the
place of a column of its name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS, RANK, SAMPLE, SLOTS, EPOCHS, FOLDS, THRESHOLD = 14, 8, 8000, 8_000_000, 12, 5, 0.3
CLASSES = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    CLASSES[_i] = 1 if _i > 127 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t\n\r\v\f" else 5 if _c in ".,;:'\"-()!?" else 6
N_STATS, BINS = 14, 8
WORDS = 1 << BITS
DIM = WORDS + N_STATS * (BINS + 1) + 16
CUTS = np.linspace(0, 1, BINS + 1)[1:-1]


def statistics(raw: bytes, words: list[bytes], distinct: int) -> np.ndarray:
    """Structure statistics of a text, each within 0 to 1."""
    n, m = len(raw), len(words)
    if not m:
        return np.zeros(N_STATS, np.float32)
    share = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=7) / n
    lines = raw.split(b"\n")
    again = sum(a == b for a, b in zip(words, words[1:])) / m
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    ends = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    mean = min(1.0, (n / m) / 20)
    size = min(1.0, math.log1p(m) / 12)
    return np.array([size, mean, *share[1:7], distinct / m, again, marked, ends, 1 - len(set(lines)) / len(lines), min(1.0, len(lines) / m * 4)], np.float32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    distinct = set(words)
    slots = np.unique(np.fromiter((xxhash.xxh32_intdigest(w) & (WORDS - 1) for w in distinct), np.int64, len(distinct)))
    s = statistics(raw, words, len(distinct))
    k = np.arange(N_STATS)
    length = np.array([DIM - 16 + min(15, len(raw).bit_length() * 16 // 32)])
    at = np.concatenate([slots, WORDS + k, WORDS + N_STATS + k * BINS + np.searchsorted(CUTS, s), length])
    return at, np.concatenate([np.full(len(slots), 1 / math.sqrt(max(1, len(slots)))), s, np.full(N_STATS + 1, 0.5)]).astype(np.float32)


def _margins(at: np.ndarray, x: np.ndarray, first: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vx = v[at] * x[:, None]
    s = np.add.reduceat(vx, first)
    return w0 + np.add.reduceat(w[at] * x, first) + 0.5 * (s**2 - np.add.reduceat(vx**2, first)).sum(1), s


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by AdaGrad over shuffled minibatches; (w0, w, v)."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(DIM, np.float32), rng.normal(0, 0.05, (DIM, RANK)).astype(np.float32)
    g0, gw, gv = 1e-6, np.full(DIM, 1e-6, np.float32), np.full((DIM, RANK), 1e-6, np.float32)
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 128):
            part = [rows[i] for i in order[b : b + 128]]
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            size = [len(p[0]) for p in part]
            first = np.r_[0, np.cumsum(size)[:-1]]
            z, s = _margins(at, x, first, w0, w, v)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([p[2] for p in part])) / len(part)
            e = np.repeat(d, size) * x
            own, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, e) + decay * w[own]
            each = e[:, None] * (np.repeat(s, size, 0) - v[at] * x[:, None])
            dv = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], 1) + decay * v[own]
            d0 = d.sum()
            g0, gw[own], gv[own] = g0 + d0**2, gw[own] + dw**2, gv[own] + dv**2
            w0 -= rate * d0 / math.sqrt(g0)
            w[own] -= rate * dw / np.sqrt(gw[own])
            v[own] -= rate * dv / np.sqrt(gv[own])
    return float(w0), w, v


def _held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, slots: int = SLOTS) -> tuple[float, np.ndarray, np.ndarray]:
    """Fits on ``sample`` labelled rows of ``slots`` features together at most, none of them held out."""
    C.ready(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(folds)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` rows of two numbers: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # one doc_id may have many rows
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)

    def rows(batches):
        for b in batches:
            out = [features(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in out], pa.binary()), pa.array([x.tobytes() for _, x in out], pa.binary()), pa.array([len(a) for a, _ in out], pa.int64())], ["id", "y", "at", "x", "n"])

    made = texts.select("doc_id", "text", "quality").mapInArrow(rows, "id long, y int, at binary, x binary, n long")
    before = W.orderBy(F.xxhash64("id"), "id", "at").rowsBetween(W.unboundedPreceding, 0)  # over ``sample`` rows at most
    got = sorted(made.withColumn("upto", F.sum("n").over(before)).where(F.col("upto") <= slots).select("id", "at", "x", "y").collect())
    return fit([(np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(x, np.float32), y) for _, at, x, y in got])


def score(docs: DataFrame, model: tuple, out: str = "score") -> DataFrame:
    """``docs`` (all columns) with the model's score of each text; a column of the name ``out`` gives way."""
    spark = C.ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # (2 + RANK) * DIM numbers, whatever the input
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    place = docs.columns.index("text")

    def run(batches):
        w0, w, v = held.value
        for b in batches:
            for a in range(0, b.num_rows, 500):
                p = b.slice(a, 500)
                rows = [features(t) for t in p.column(place).to_pylist()]
                first = np.r_[0, np.cumsum([len(r[0]) for r in rows])[:-1]]
                z, _ = _margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), first, w0, w, v)
                yield pa.record_batch([*p.columns, pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), pa.float64())], [*p.schema.names, out])

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", _held_out(FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
