"""Suffix-array dedup (operator 10): every byte covered by a 200-byte string that starts anywhere else is removed.

Candidates.  Each 200-byte window has an anchor: the 64-byte string in it with the smallest hash (the leftmost of
equals).  Equal windows have equal anchors at equal offsets, so a window can only repeat if its anchor's string occurs
twice in the corpus.  Anchors are about one in seventy bytes; their hashes are counted over all blocks and only the
fragments around repeated anchors are looked at further.

Order.  The fragments of a range of anchor hashes meet in one task, equal fragments once.  Their right contexts (from the
anchor on) and their left contexts (read backwards) are put in suffix order by deep-shallow sorting: multikey
quicksort on 8-byte characters to a shallow depth, then a blind trie for each group that still shares its prefix.
Neighbours' common prefixes split each order into classes for every offset of a window around the anchor; a window
repeats exactly if another fragment is in the same right and the same left class.

Equality inside an order is by bytes, never by hash.  Blocks of whole documents (see ``common``) send each fragment
once, so copies held by a third of all documents cost one entry a block.

An anchor with more than HOT fragments (the edges of a passage that very many documents share) doesn't go to one task:
its windows are dealt to tasks by their own 128-bit hash, each once a block, and counted there.  So what meets in a task is
bounded by the number of blocks, not of documents; equality of these windows is by that hash.

Memory.  A block is BLOCK bytes of text or one document; windows, hits and places are flat arrays, so a task of any
phase holds a small multiple of that.  A very long text is hashed in slices and is a block of its own.

Null text: empty.  Texts under 200 bytes keep everything.  Rows with one doc_id get a row each and count as separate
places.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 200
GRAM = 64
SHALLOW = 64
#: bytes of text in a block: its fragments are about four times as many
BLOCK = 2 << 20
#: fragments of one anchor that are ordered in one task
HOT = 4096
BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 19


# ---------------------------------------------------------------- deep-shallow sorting


def multikey_quicksort(words: np.ndarray, order: np.ndarray, depth: int, last: int, out: list) -> None:
    """Ternary partition of ``order`` by the 8-byte character at ``depth``; appends (ordered rows, equal down to ``last``?)."""
    stack = [(order, depth)]
    while stack:
        rows, d = stack.pop()
        if len(rows) < 2 or d == last:
            if len(rows):
                out.append(rows)
            continue
        key = words[rows, d]
        if len(rows) < 4096:  # small: one sort does the partitioning
            s = np.argsort(key, kind="stable")
            rows, key = rows[s], key[s]
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            stack.extend((part, d + 1) for part in reversed(np.split(rows, edge)))
            continue
        pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
        stack.append((rows[key > pivot], d))
        stack.append((rows[key == pivot], d + 1))
        stack.append((rows[key < pivot], d))


def _common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` or more."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(texts: list[bytes], rows: list[int], at: int) -> tuple[list[int], list[int]]:
    """Rows in order of their texts, and each one's common prefix with the one before; all share ``at`` bytes.

    A node is [depth, {byte or -1 at the end: node or row}].  A text goes down blind, looking only at branching bytes;
    one comparison with the leaf it meets tells the depth of the new branch.
    """
    if len(rows) == 2:
        a, b = rows
        n = _common(texts[a], texts[b], at)
        return ([a, b] if texts[a] <= texts[b] else [b, a]), [at, n]
    root: list | int = rows[0]
    for r in rows[1:]:
        s = texts[r]
        node = root
        while type(node) is list:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) if (s[node[0]] if node[0] < len(s) else -1) in node[1] else next(iter(node[1].values()))
        leaf = texts[node]
        n = _common(s, leaf, at)
        up, key, node = None, None, root
        while type(node) is list and node[0] < n:
            up, key = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][key]
        own = s[n] if n < len(s) else -1
        if type(node) is list and node[0] == n:
            node[1][own if own not in node[1] else -2 - r] = r  # in the second case an equal text: next to it
            continue
        other = leaf[n] if n < len(leaf) else -1
        new = [n, {other: node, own: r}] if other != own else [n, {-1: node, -2 - r: r}]
        if up is None:
            root = new
        else:
            up[1][key] = new
    order, lcp = [], []
    stack: list = [(root, at)]
    while stack:
        node, above = stack.pop()
        if type(node) is not list:
            order.append(node)
            lcp.append(above)
            continue
        for i, k in reversed(list(enumerate(sorted(node[1])))):
            stack.append((node[1][k], node[0] if i else above))
    return order, lcp


def deep_shallow_sort(texts: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``texts`` and the common prefix of each with the one before it (0 for the first)."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = shallow // 8
    flat = np.frombuffer(b"".join(t[:shallow].ljust(shallow, b"\0") for t in texts), np.uint8).reshape(n, shallow)
    words = flat.view(">u8").astype(np.uint64)
    groups: list = []
    multikey_quicksort(words, np.arange(n), 0, k, groups)
    order, lcp = np.empty(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for g in groups:
        if len(g) > 1:
            rows = g.tolist()
            # texts that end before the shallow depth compare by their own length
            own, shared = blind_trie(texts, rows, 0 if min(len(texts[r]) for r in rows) < shallow else shallow)
            order[at : at + len(g)], lcp[at : at + len(g)] = own, shared
        else:
            order[at] = g[0]
        at += len(g)
    first = np.cumsum([0, *map(len, groups)])[:-1]
    first = first[first > 0]
    differ = flat[order[first]] != flat[order[first - 1]]
    size = np.fromiter(map(len, texts), np.int64, n)
    lcp[first] = np.minimum(np.where(differ.any(1), differ.argmax(1), shallow), np.minimum(size[order[first]], size[order[first - 1]]))
    lcp[0] = 0
    return order, lcp


# ---------------------------------------------------------------- anchors

_POW = np.full(SLICE + LENGTH, BASE, np.uint64)
_POW[0] = 1
_POW = np.cumprod(_POW, dtype=np.uint64)
_INV = np.full(SLICE + LENGTH, pow(BASE, -1, 2**64), np.uint64)
_INV[0] = 1
_INV = np.cumprod(_INV, dtype=np.uint64)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over texts laid end to end: (anchor hash, anchor place, first start, last start) of each run of windows with one anchor."""
    out: list = []
    spread = np.arange(256, dtype=np.uint64)
    spread = C.mix64(spread + np.uint64(1))
    width = length - gram + 1
    begin = 0
    for end in ends.tolist():
        for a in range(begin, max(begin, end - length + 1), SLICE - length + 1):
            b = min(a + SLICE, end)
            n = b - a
            if n < length:
                break
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(spread[text[a:b]] * _INV[:n], out=s[1:])
            h = C.mix64((s[gram:] - s[:-gram]) * _POW[: n - gram + 1])
            place = np.arange(len(h), dtype=np.uint64)
            least = _slide_min((h & ~np.uint64(2 * SLICE - 1)) | place, width) & np.uint64(2 * SLICE - 1)
            least = least.astype(np.int64)
            first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            last = np.r_[first[1:] - 1, len(least) - 1]
            # minima lie near 0: mixed again, they spread over the ranges
            out.append((C.mix64(h[least[first]]), least[first] + a, first + a, last + a))
        begin = end
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_starts(fragments: list[bytes], left: np.ndarray, first: np.ndarray, last: np.ndarray, many: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, offset before its anchor) of each window that repeats.

    Distinct fragments; the anchor stands ``left`` bytes in; windows start ``last``..``first`` bytes before it.  ``many``: the fragment stands in
    more than one place, so that all of its windows repeat.
    """
    n = len(fragments)
    right_order, right = deep_shallow_sort([f[k:] for f, k in zip(fragments, left.tolist())])
    left_order, back = deep_shallow_sort([f[:k][::-1] for f, k in zip(fragments, left.tolist())])
    rows, offsets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(int(first.max(initial=-1)) + 1):
        r, l = np.empty(n, np.int64), np.empty(n, np.int64)
        r[right_order] = np.cumsum(right < length - a)
        l[left_order] = np.cumsum(back < a)
        own = np.flatnonzero((last <= a) & (a <= first))
        if not len(own):
            continue
        key = r[own] * (n + 1) + l[own]
        s = np.argsort(key, kind="stable")
        same = key[s][1:] == key[s][:-1]
        again = np.zeros(len(own), bool)
        again[s] = np.r_[same, False] | np.r_[False, same]
        hit = own[again | many[own]].astype(np.int32)
        rows.append(hit)
        offsets.append(np.full(len(hit), a, np.int32))
    return np.concatenate(rows), np.concatenate(offsets)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (maximal removed runs, end exclusive)."""
    spark = C.ready(docs.sparkSession)
    total = C.text_bytes(docs)
    blocks, buckets = C.n_blocks(spark, total, block_bytes), C.n_blocks(spark, total, block_bytes)
    docs = docs.select(C.block_of(blocks).alias("block"), "doc_id", "text")

    def laid(t: pa.Table) -> tuple[list, list[bytes], np.ndarray, np.ndarray]:
        rows = sorted(zip(((2**63 if x is None else x) for x in t["doc_id"].to_pylist()), t["text"].to_pylist(), t["doc_id"].to_pylist()), key=lambda x: (x[0], x[1] or ""))
        texts = [(x[1] or "").encode() for x in rows]
        return [x[2] for x in rows], texts, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts], dtype=np.int64)

    def count(t: pa.Table) -> pa.Table:
        _, _, text, ends = laid(t)
        h, place, first, last = anchors(text, ends, length, gram)
        _, one = np.unique(place, return_index=True)
        h, first, last = h[one], first[one], last[one]
        own, which, times = np.unique(h, return_inverse=True, return_counts=True)
        # distinct fragments of each anchor; a fragment with copies counts as two
        n = np.minimum(times, 2)
        some = np.flatnonzero(times[which] > 2)
        if len(some):
            raw = memoryview(text)
            of = [xxhash.xxh3_64_intdigest(raw[a : b + length]) for a, b in zip(first[some].tolist(), last[some].tolist())]
            pairs = np.unique(np.stack([which[some].astype(np.uint64), np.array(of, np.uint64)], 1), axis=0)[:, 0]
            n = np.maximum(n, np.bincount(pairs.astype(np.int64), minlength=len(own)))
        n = np.minimum(n, 65535).astype(np.uint16)
        found, bounds = C.by_bucket(own, buckets)
        cuts = [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]
        return pa.table({"bucket": found, "block": pa.array([t["block"][0].as_py()] * len(found), pa.int32()), "once": pa.array([C.pack_sorted(own[a:b]) for a, b in cuts], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in cuts], pa.binary())})

    def survive(t: pa.Table) -> pa.Table:
        hs, ns, bs = [], [], []
        for block, once, n in zip(*(t[c].to_pylist() for c in ("block", "once", "n"))):
            h = C.unpack_sorted(once)
            hs.append(h)
            ns.append(np.frombuffer(n, np.uint16).astype(np.int64))
            bs.append(np.full(len(h), block, np.int32))
        h, n, b = np.concatenate(hs), np.concatenate(ns), np.concatenate(bs)
        order = np.argsort(h, kind="stable")
        h, n, b = h[order], n[order], b[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        times = np.repeat(np.add.reduceat(n, first), np.diff(np.r_[first, len(h)]))
        h, b, many = h[times > 1], b[times > 1], times[times > 1] > hot
        order = np.lexsort((h, many, b))
        h, b, many = h[order], b[order], many[order]
        first = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (many[1:] != many[:-1])]) if len(b) else np.zeros(0, np.int64)
        bounds = np.append(first, len(b))
        return pa.table({"block": pa.array(b[first], pa.int32()), "hot": pa.array(many[first], pa.bool_()), "hashes": pa.array([C.pack_sorted(h[x:y]) for x, y in zip(bounds, bounds[1:])], pa.binary())})

    def cut_out(t: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("hash", pa.binary()), ("text", pa.binary()), ("shape", pa.binary()), ("many", pa.binary()), ("places", pa.binary())])
        if not told.num_rows or not t.num_rows:
            return schema.empty_table()
        again: list = [np.zeros(0, np.uint64)]
        crowded: list = [np.zeros(0, np.uint64)]
        for x, many in zip(told["hashes"].to_pylist(), told["hot"].to_pylist()):
            (crowded if many else again).append(C.unpack_sorted(x))
        crowded = np.concatenate(crowded)
        _, _, text, ends = laid(t)
        h, place, first, last = anchors(text, ends, length, gram)
        own = np.flatnonzero(np.isin(h, np.concatenate([*again, crowded])))
        raw = text.tobytes()
        groups: dict = {}
        for i in own.tolist():
            a, p, b = int(first[i]), int(place[i]), int(last[i])
            groups.setdefault((int(h[i]), raw[a : b + length], p - a, p - b), []).append(a)
        parts: dict = {}
        crowded = set(crowded.tolist())
        digests, sizes, where = bytearray(), [], []
        for (x, f, up, down), places in groups.items():
            if x not in crowded:
                parts.setdefault(((x >> 32) * buckets) >> 32, []).append((x, f, up, down, places))
                continue
            for o in range(len(f) - length + 1):
                digests += xxhash.xxh3_128_digest(f[o : o + length])
            sizes.append(len(f) - length + 1)
            where.append(places)
        rows = []
        if sizes:  # windows of crowded anchors, by hash and without text: each distinct one with its places
            key = np.frombuffer(digests, np.uint64).reshape(-1, 2)
            times = np.array(list(map(len, where)), np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            offset = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((key[:, 1], key[:, 0]))
            key, of, offset = key[order], of[order], offset[order]
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            each = np.cumsum(times) - times
            at = np.repeat(each[of] - np.cumsum(times[of]) + times[of], times[of]) + np.arange(times[of].sum())
            places = (np.concatenate([np.array(p, np.int64) for p in where])[at] + np.repeat(offset, times[of])).astype(np.uint32)
            upto = np.r_[0, np.cumsum(times[of])]
            many = np.add.reduceat(times[of], first)
            found, bounds = C.by_bucket(key[first, 0], buckets)
            ends = np.append(first, len(key))
            for bucket, x, y in zip(found.tolist(), bounds, bounds[1:]):
                rows.append({"bucket": bucket, "block": t["block"][0].as_py(), "hash": key[first[x:y]].tobytes(), "many": many[x:y].astype(np.uint32).tobytes(), "places": places[upto[ends[x]] : upto[ends[y]]].tobytes()})
        for bucket, items in parts.items():
            rows.append({"bucket": bucket, "block": t["block"][0].as_py(), "hash": np.array([x[0] for x in items], np.uint64).tobytes(), "text": b"".join(x[1] for x in items), "shape": np.array([(len(x[1]), x[2], x[3]) for x in items], np.uint16).tobytes(), "many": np.array([len(x[4]) for x in items], np.uint32).tobytes(), "places": np.array([p for x in items for p in x[4]], np.uint32).tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    def compare(t: pa.Table) -> pa.Table:
        starts: dict = {}
        apart = t.filter(pa.compute.is_null(t["text"]))
        t = t.filter(pa.compute.is_valid(t["text"]))
        if apart.num_rows:
            key, many, places = (np.frombuffer(b"".join(apart[c].to_pylist()), kind) for c, kind in (("hash", np.uint64), ("many", np.uint32), ("places", np.uint32)))
            key = key.reshape(-1, 2)
            block = np.repeat(apart["block"].to_numpy(), pa.compute.binary_length(apart["many"]).to_numpy() // 4)
            order = np.lexsort((key[:, 1], key[:, 0]))
            first = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]).any(1)])
            times = np.repeat(np.add.reduceat(many[order].astype(np.int64), first), np.diff(np.r_[first, len(order)]))
            again = np.zeros(len(order), bool)
            again[order] = times > 1
            again, block = np.repeat(again, many), np.repeat(block, many)
            places, block = places[again].astype(np.int64), block[again]
            order = np.lexsort((places, block))
            places, block = places[order], block[order]
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (np.diff(places) > 1)]) if len(places) else np.zeros(0, np.int64)
            runs = np.stack([places[edge], places[np.r_[edge[1:], len(places)] - 1]], 1) if len(edge) else np.zeros((0, 2), np.int64)
            for b in np.unique(block[edge]).tolist():
                starts[b] = [runs[block[edge] == b]]
        seen: dict = {}
        for block, x, text, shape, many, places in zip(*(t[c].to_pylist() for c in ("block", "hash", "text", "shape", "many", "places"))):
            shape, places = np.frombuffer(shape, np.uint16).reshape(-1, 3).tolist(), np.frombuffer(places, np.uint32)
            at = to = 0
            for hx, (size, up, down), m in zip(np.frombuffer(x, np.uint64).tolist(), shape, np.frombuffer(many, np.uint32).tolist()):
                seen.setdefault((hx, text[at : at + size], up, down), []).append((block, places[to : to + m]))
                at, to = at + size, to + m
        # a fragment alone under its anchor has nothing to be compared with
        peers: dict = {}
        for k in seen:
            peers[k[0]] = peers.get(k[0], 0) + 1
        keys = [k for k, at in seen.items() if peers[k[0]] > 1 or len(at) > 1 or len(at[0][1]) > 1]
        up = np.array([k[2] for k in keys], np.int64)
        back = np.array([k[3] for k in keys], np.int64)
        both = [i for i, k in enumerate(keys) if peers[k[0]] > 1]
        alone = np.array([i for i, k in enumerate(keys) if peers[k[0]] == 1], np.int64)
        many = np.array([len(seen[k]) > 1 or len(seen[k][0][1]) > 1 for k in keys], bool)
        row, offset = repeated_starts([keys[i][1] for i in both], up[both], up[both], back[both], many[both], length) if both else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        row = np.array(both, np.int64)[row]
        at = up[row] - offset  # from the fragment's first byte
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        edge = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(at) > 1)]) if len(row) else np.zeros(0, np.int64)
        last = np.r_[edge[1:], len(row)] - 1 if len(edge) else edge
        runs = np.stack([np.r_[row[edge], alone], np.r_[at[edge], np.zeros(len(alone), np.int64)], np.r_[at[last], up[alone] - back[alone]]], 1)
        for i, a, b in runs.tolist():
            for block, places in seen[keys[i]]:
                starts.setdefault(block, []).append(np.stack([places.astype(np.int64) + a, places.astype(np.int64) + b], 1))
        return pa.table({"block": pa.array(list(starts), pa.int32()), "runs": pa.array([np.concatenate(x).astype(np.uint32).tobytes() for x in starts.values()], pa.binary())})

    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, text, ends = laid(t)
        step = np.zeros(len(text) + 1, np.int32)
        for x in told["runs"].to_pylist():
            runs = np.frombuffer(x, np.uint32).reshape(-1, 2).astype(np.int64)
            np.add.at(step, runs[:, 0], 1)
            np.add.at(step, runs[:, 1] + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        out: dict = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
        begin = 0
        for raw, end in zip(texts, ends.tolist()):
            mask = gone[begin:end]
            edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])).reshape(-1, 2)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(len(edge))
            out["kept"].append(text[begin:end][~mask].tobytes() if len(edge) else raw)
            out["spans"].append([{"start": a, "end": b} for a, b in edge.tolist()])
            begin = end
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    by_block = docs.groupBy("block")
    sent = by_block.applyInArrow(count, "bucket long, block int, once binary, n binary")
    told = sent.groupBy("bucket").applyInArrow(survive, "block int, hot boolean, hashes binary")
    found = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_out, "bucket long, block int, hash binary, text binary, shape binary, many binary, places binary")
    runs = found.groupBy("bucket").applyInArrow(compare, "block int, runs binary")
    return docs.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def oracle(length: int = LENGTH) -> str:
    """The same in DuckDB SQL over texts written in hexadecimal, two digits a byte; strings are told apart by their md5."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, {2 * length})) AS string FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - {length - 2})) AS i FROM d)),
    a AS (SELECT string FROM g GROUP BY string HAVING count(*) > 1),
    r AS (SELECT g.doc_id, g.i FROM g JOIN a ON a.string = g.string),
    n AS (SELECT *, i > lag(i, 1, -{2 * length}) OVER (PARTITION BY doc_id ORDER BY i) + {length} AS new FROM r),
    m AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
    s AS (SELECT doc_id, min(i) AS x, max(i) + {length - 1} AS y FROM m GROUP BY doc_id, span),
    e AS (SELECT doc_id, x, y, lag(y, 1, 0) OVER (PARTITION BY doc_id ORDER BY x) + 1 AS since FROM s),
    k AS (SELECT e.doc_id, count(*) AS n_spans, sum(y - x + 1) AS n_removed, string_agg(substr(h, 2 * since - 1, 2 * (x - since)), '' ORDER BY x) || substr(any_value(h), 2 * max(y) + 1) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
    SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
