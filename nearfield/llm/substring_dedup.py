"""Substring dedup (operator 5): Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeated windows merge into maximal removal intervals.

Plan: texts are dealt once to blocks of bounded bytes (one exchange, reused by both passes).  Pass 1 hashes every
window of a block and sends each distinct hash once, with the smallest document that has it in this block, packed by
hash range.  A range's task finds the smallest document over all blocks and tells a block which of its hashes also
start in a smaller document elsewhere.  Pass 2 recomputes the windows, marks and merges the intervals.
A window found in a third of all documents is one entry a block, so no task holds an unbounded group.

Windows are equal if their 64-bit hashes are; for n windows about n * n / 2**65 pairs agree by chance.

Null text: no words.  Null doc_id: greater than every other.  Rows with one doc_id count as one document
for "smaller", and each gets its own row.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = np.int64(2**63 - 1)


def _windows(texts: list[str | None], window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text; hash of the window at each word of all texts together, and whether one fits there."""
    words = [t.encode().split() if t else [] for t in texts]
    n = sum(map(len, words))
    w = np.fromiter((xxhash.xxh3_64_intdigest(x) for ws in words for x in ws), np.uint64, n)
    left = np.concatenate([np.arange(len(ws), 0, -1, dtype=np.int64) for ws in words] or [np.zeros(0, np.int64)])
    if n < window:
        return words, np.zeros(n, np.uint64), np.zeros(n, bool)
    h = np.zeros(n - window + 1, np.uint64)
    for j in range(window):  # Horner's rule: the polynomial that a rolling hash keeps, for all windows at once
        h = h * BASE + w[j : j + len(h)]
    return words, np.concatenate([C.mix64(h), np.zeros(window - 1, np.uint64)]), left >= window


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return np.array([LAST if x is None else x for x in col.to_pylist()], np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = C.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the words kept, joined by a space), removed (intervals of words, end exclusive)."""
    spark = C.ready(docs.sparkSession)
    total = C.text_bytes(docs)
    blocks, buckets = C.n_blocks(spark, total, block_bytes), C.n_blocks(spark, total, 2 * block_bytes)
    docs = docs.select(C.block_of(blocks).alias("block"), "doc_id", "text")

    def hashes(t: pa.Table) -> pa.Table:
        ids = _ids(t["doc_id"])
        order = np.argsort(ids, kind="stable")
        texts = t["text"].to_pylist()
        words, h, fits = _windows([texts[i] for i in order], window)
        at = np.repeat(np.arange(len(order)), [len(x) for x in words])[fits]
        h, first = np.unique(h[fits], return_index=True)  # the first is of the smallest doc_id
        docs_of = at[first]
        found, bounds = C.by_bucket(h, buckets)
        rows: dict = {"bucket": found, "block": [t["block"][0].as_py()] * len(found), "hashes": [], "docs": [], "index": []}
        ids = ids[order]
        for a, b in zip(bounds, bounds[1:]):
            if b > a:
                own, inverse = np.unique(docs_of[a:b], return_inverse=True)
                rows["hashes"].append(C.pack_sorted(h[a:b]))
                rows["docs"].append(ids[own].tobytes())
                rows["index"].append(inverse.astype("<u2" if len(own) < 65536 else "<u4").tobytes())
        return pa.table(rows, schema=pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("index", pa.binary())]))

    def repeats(t: pa.Table) -> pa.Table:
        hs, ds, bs = [], [], []
        for block, h, d, ix in zip(*(t[c].to_pylist() for c in ("block", "hashes", "docs", "index"))):
            h, d = C.unpack_sorted(h), np.frombuffer(d, np.int64)
            hs.append(h)
            ds.append(d[np.frombuffer(ix, "<u2" if len(d) < 65536 else "<u4")])
            bs.append(np.full(len(h), block, np.int32))
        h, d, b = np.concatenate(hs), np.concatenate(ds), np.concatenate(bs)
        order = np.argsort(h, kind="stable")
        h, d, b = h[order], d[order], b[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        least = np.repeat(np.minimum.reduceat(d, first), np.diff(np.r_[first, len(h)]))
        take = d > least
        h, b = h[take], b[take]
        order = np.lexsort((h, b))
        h, b = h[order], b[order]
        own, first = np.unique(b, return_index=True)
        bounds = np.append(first, len(b))
        return pa.table({"block": pa.array(own, pa.int32()), "hashes": pa.array([C.pack_sorted(h[x:y]) for x, y in zip(bounds, bounds[1:])], pa.binary())})

    def mark(t: pa.Table, told: pa.Table) -> pa.Table:
        ids = _ids(t["doc_id"])
        raw, texts = t["doc_id"].to_pylist(), t["text"].to_pylist()
        order = np.argsort(ids, kind="stable")
        words, h, fits = _windows([texts[i] for i in order], window)
        at = np.repeat(np.arange(len(order)), [len(x) for x in words])
        elsewhere = [C.unpack_sorted(x) for x in told["hashes"].to_pylist()]
        hit = np.isin(h, np.concatenate(elsewhere)) if elsewhere else np.zeros(len(h), bool)
        # inside the block: the same hash in a smaller doc_id
        places = np.flatnonzero(fits)
        if len(places):
            ids_at = ids[order][at[places]]
            _, first, inverse = np.unique(h[places], return_index=True, return_inverse=True)
            hit[places[ids_at > ids_at[first][inverse]]] = True
        hit &= fits
        gone = C.covered(np.flatnonzero(hit), window, len(h))
        out: dict = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "removed": []}
        begin = 0
        for i, ws in zip(order, words):
            mask = gone[begin : begin + len(ws)]
            begin += len(ws)
            edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
            out["doc_id"].append(raw[i])
            out["n_words"].append(len(ws))
            out["n_removed"].append(int(mask.sum()))
            out["kept"].append(b" ".join(ws if not len(edge) else [w for w, m in zip(ws, mask.tolist()) if not m]).decode())
            out["removed"].append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    sent = docs.groupBy("block").applyInArrow(hashes, "bucket long, block int, hashes binary, docs binary, index binary")
    told = sent.groupBy("bucket").applyInArrow(repeats, "block int, hashes binary")
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """The same in DuckDB SQL, window by window."""
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d)),
    f AS (SELECT words, min(doc_id) AS first FROM g GROUP BY words),
    c AS (SELECT DISTINCT g.doc_id, g.i + j AS place FROM g JOIN f ON f.words = g.words AND f.first < g.doc_id, range({window}) t(j)),
    k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM d),
    r AS (SELECT k.doc_id, count(c.place) AS n_removed, string_agg(word, ' ' ORDER BY k.place) FILTER (c.place IS NULL) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.place = k.place GROUP BY k.doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""
