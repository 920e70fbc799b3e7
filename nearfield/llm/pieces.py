"""SentencePiece encoding and decoding (operator 2): best and N-best segmentations over a model's piece lattice.

A text with a space before it is a lattice of pieces over code points; a code point in no piece is spelled by byte
pieces.  Forward Viterbi gives every place the score of the best way to it.  A-star runs backward from the end and takes
that score as its heuristic; the heuristic is exact, so segmentations leave the heap best first.

No piece holds a space after another character or a line break, so the lattice falls apart there: parts are solved
once, many at a time, and remembered as arrays.  A text's N best differ from the best in the N - 1 parts that lose least by their second best way (found by keeping two scores a place); A-star runs over those parts, and its own results are merged best first.

The model file gives pieces and ranks (its scores are minus the rank).  A path's score is the sum of log probabilities of a Zipf law
over ranks, so that fewer pieces are better; nothing is trained.  The file is read by the driver, and executors get the 32,000 pieces.

Ties.  Of equally good ways the best one takes, from the end back, the longest last piece at each place; the other of the N best
follow in the order in which A-star opens them, which depends on the text and the model only.

Decoding joins pieces and bytes and drops the first space: every text returns exactly.  Null text: no pieces.  Empty
text: no pieces.  Very long texts, unspaced ones too: memory grows with the text, not with its lattice (about 250 bytes a
code point where one part is the whole text).  Rows with one doc_id: a row each.  Empty table: empty result.  Extra columns are ignored, or
carried by ``encode``, whose own columns take the place of those of their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
#: parts that a worker remembers: more of them save time, and a pipeline has memory for fewer
REMEMBER, FEWER = 1_500_000, 300_000
#: longest part that is remembered
SHORT_PART = 64
#: parts solved together, code points of the texts worked on together
TOGETHER, ROOM = 8192, 4 << 20
#: longest part whose lattice is kept whole
SHORT = 4096
BASE = 0x9E3779B97F4A7C15
IDS_TYPE = T.ArrayType(T.IntegerType())
NONE = np.zeros(0, np.int32)
ADDED = {"ids": IDS_TYPE, "n_pieces": T.LongType(), "score": T.DoubleType(), "nbest": T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", IDS_TYPE)])), "decoded": T.StringType()}


def read_model(path: str = MODEL) -> tuple[dict[str, tuple[int, float]], list[int], list[bytes | None]]:
    """Pieces with a space for the mark: {text: (id, log probability)}, ids of the 256 byte pieces, bytes of each id (None: nothing)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    pieces, byte_ids, spelled = {}, [0] * 256, []
    total = sum(1 / (r + 10) for r in range(m.vocab_size()))
    for i in range(m.vocab_size()):
        text = m.id_to_piece(i).replace("▁", " ")
        if m.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            spelled.append(bytes([int(text[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or " " in text.lstrip(" "):
            spelled.append(None)
        else:
            pieces[text] = (i, -math.log((10 - m.get_score(i)) * total))
            spelled.append(text.encode())
    return pieces, byte_ids, spelled


class Column:
    """Numbers that grow at the end."""

    def __init__(self, kind: type):
        self.room, self.size = np.empty(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        size = self.size + len(x)
        if size > len(self.room):
            room = np.empty(max(size, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.all
            self.room = room
        self.room[self.size : size] = x
        self.size = size

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run behind the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Solved:
    """Solved parts by number: ids and score of the best way, and what the second best loses (infinite: there is none)."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.size, self.score, self.loss = Column(np.int32), Column(np.int32), Column(np.float64), Column(np.float64)
        #: where the ids start
        self.start = Column(np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray, score: np.ndarray, loss: np.ndarray) -> int:
        """Number of the first."""
        first = self.size.size
        self.start.add(self.ids.size + np.cumsum(size) - size)
        for column, x in ((self.ids, ids), (self.size, size), (self.score, score), (self.loss, loss)):
            column.add(x)
        return first

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, sizes, scores and losses of parts."""
        size = self.size.all[k]
        return self.ids.all[runs(self.start.all[k], size)], size, self.score.all[k], self.loss.all[k]

    def cut(self, first: int) -> None:
        """Forgets the parts from this number on, which have no name."""
        if first < self.size.size:
            self.ids.size = int(self.start.all[first])
            for column in (self.size, self.score, self.loss, self.start):
                column.size = first


class Lattice:
    """Segmentations of parts of a text."""

    def __init__(self, model: tuple, remember: int = REMEMBER):
        self.pieces, self.byte_ids, self.spelled = model
        #: every beginning of a piece: (id, log probability, (id,)), or None if it is none itself
        self.prefixes: dict = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.prefixes.update({p: (i, x, (i,)) for p, (i, x) in self.pieces.items()})
        self.worst = min(p[1] for p in self.pieces.values()) - 10
        self.most = max(map(len, self.pieces))
        #: spaces and what follows; a line break is a part of its own unless some piece holds one
        self.split = re.compile(r" *[^ ]+| +\Z" if any("\n" in p for p in self.pieces) else r" *[^ \n]+| +|\n").findall
        self.remember = remember
        #: solved parts, those of late and those before
        self.late, self.old = Solved(), Solved()
        self.more: dict = {}
        self.spelling = pa.array([x or b"" for x in self.spelled], pa.large_binary())

    def _into(self, s: str) -> list[list]:
        """For each place, the pieces that end there: (start, ids, score)."""
        get, n = self.prefixes.get, len(s)
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                p = get(s[i:j], 0)
                if p == 0:
                    break
                if p:
                    into[j].append((i, p[2], p[1]))
            if s[i] not in self.pieces:
                b = s[i].encode()
                into[i + 1].append((i, tuple(self.byte_ids[x] for x in b), self.worst * len(b)))
        return into

    def best(self, s: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best way, and what the second best loses (infinite: there is none)."""
        n, get = len(s), self.prefixes.get
        one, two = array("d", [-math.inf]) * (n + 1), array("d", [-math.inf]) * (n + 1)
        since, by = array("q", [0]) * (n + 1), [None] * (n + 1)  # start and ids of each place's last piece
        one[0] = 0.0
        for i in range(n):
            a, b = one[i], two[i]  # scores of the best and the second best way to here
            if s[i] not in self.pieces:
                raw = s[i].encode()
                x = self.worst * len(raw)
                if a + x > one[i + 1]:
                    one[i + 1], two[i + 1], since[i + 1], by[i + 1] = a + x, max(one[i + 1], b + x), i, tuple(self.byte_ids[v] for v in raw)
                else:
                    two[i + 1] = max(two[i + 1], a + x)
            for j in range(i + 1, n + 1):
                p = get(s[i:j], 0)
                if p == 0:  # no piece begins so
                    break
                if p:
                    x = p[1]
                    v = a + x
                    old = one[j]
                    if v > old:
                        one[j], since[j], by[j] = v, i, p[2]
                        w = b + x
                        two[j] = old if old > w else w
                    elif v > two[j]:
                        two[j] = v
        ids, j = [], n
        while j:
            ids.append(by[j])
            j = since[j]
        return tuple(x for e in reversed(ids) for x in e), one[n], one[n] - two[n]

    def _tables(self) -> None:
        """The pieces' beginnings as nodes of a trie: steps by (node, character) in tables of slots, each for what collides in the one before."""
        names = sorted(self.prefixes, key=lambda x: (len(x), x))
        node = {x: k for k, x in enumerate(names)}
        chars = sorted({c for x in names for c in x})
        rank = {c: k + 1 for k, c in enumerate(chars)}
        self.rank = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.rank[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.first = np.full(len(chars) + 1, -1, np.int32)  # node of each character alone
        one = [x for x in names if len(x) == 1]
        self.first[[rank[x] for x in one]] = [node[x] for x in one]
        found = [self.prefixes[x] for x in names]
        self.piece = np.array([p[0] if p else -1 for p in found], np.int32)
        self.score = np.array([p[1] if p else -np.inf for p in found])
        self.spread = np.uint64(len(chars) + 1)
        longer = [x for x in names if len(x) > 1]
        to = np.array([node[x] for x in longer], np.int32)
        keys = np.array([node[x[:-1]] for x in longer], np.uint64) * self.spread + np.array([rank[x[-1]] for x in longer], np.uint64)
        self.keys, self.slots, left = np.zeros(len(names) + 1, np.uint64), [], np.arange(len(longer))
        self.keys[to] = keys
        k = 0
        while k == 0 or len(left):
            by = np.uint64(pow(BASE, 2 * k + 3, 2**64))
            bits = 12 if k else 20  # few collide in the first
            shift = np.uint64(64 - bits)
            at = (keys[left] * by) >> shift
            _, first = np.unique(at, return_index=True)
            table = np.full(1 << bits, len(names), np.int32)
            table[at[first]] = to[left[first]]
            self.slots.append((by, shift, table))
            left = np.delete(left, first)
            k += 1

    def _steps(self, node: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The node that each character leads to, or the last number."""
        none = len(self.keys) - 1
        h = node.astype(np.uint64) * self.spread + rank.astype(np.uint64)
        by, shift, table = self.slots[0]
        out = table[(h * by) >> shift]
        again = np.flatnonzero((self.keys[out] != h) & (out < none))  # the slot is another's
        out[again] = none
        for by, shift, table in self.slots[1:]:
            at = table[(h[again] * by) >> shift]
            out[again] = np.where((self.keys[at] == h[again]) & (at < none), at, out[again])
        return out

    def learn(self, parts: set[str]) -> None:
        """Solves and remembers all of them that are short enough."""
        known, before = self.late.number, self.old.number
        parts = [s for s in parts if len(s) <= SHORT_PART and s not in known]
        again = [s for s in parts if s in before]
        if again:
            self._remember(again, *self.old.take(np.fromiter(map(before.__getitem__, again), np.int64, len(again))))
            parts = [s for s in parts if s not in before]
        for a in range(0, len(parts), TOGETHER):
            self._solve(parts[a : a + TOGETHER])

    def _remember(self, names: list[str], *solved: np.ndarray) -> None:
        first = self.late.add(*solved)
        self.late.number.update(zip(names, range(first, first + len(names))))

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` for one part after the other."""
        ids, score, loss = zip(*map(self.best, parts))
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int32), np.array(score), np.array(loss)

    def _solve(self, parts: list[str]) -> None:
        """``best`` for many parts at once: the same steps, for all parts together."""
        if not hasattr(self, "keys"):
            self._tables()
        rank = self.rank[np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le"), np.uint32)]  # a place for each character and for the end
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        base = np.cumsum(size + 1) - size - 1
        alone = self.first[rank]
        bare = (alone < 0) | (self.piece[alone] < 0)  # needs byte pieces
        bare[base + size] = False
        odd = np.logical_or.reduceat(bare, base)
        if odd.any():
            names = [parts[k] for k in np.flatnonzero(odd).tolist()]
            self._remember(names, *self._alone(names))
            parts = [parts[k] for k in np.flatnonzero(~odd).tolist()]
            return self._solve(parts) if parts else None
        which = np.arange(len(rank)) - np.repeat(base, size + 1)  # each place's number in its part
        left = np.repeat(size, size + 1) - which
        # pieces by start, length and node
        starts, lengths, nodes = [], [], []
        at = np.flatnonzero(left)
        node = alone[at]
        for k in range(1, self.most + 1):
            if k > 1:
                more = left[at] >= k
                at, node = at[more], node[more]
                node = self._steps(node, rank[at + k - 1])
                more = node < len(self.keys) - 1
                at, node = at[more], node[more]
            if not len(at):
                break
            own = np.flatnonzero(self.piece[node] >= 0)
            starts.append(at[own])
            lengths.append(np.full(len(own), k, np.int64))
            nodes.append(node[own])
        start, length, node = np.concatenate(starts), np.concatenate(lengths), np.concatenate(nodes)
        order = np.argsort(which[start].astype(np.uint8), kind="stable")
        start, length, node = start[order], length[order], node[order]
        bounds = np.cumsum(np.bincount(which[start])).tolist()
        value, end = self.score[node], start + length
        one, two = np.full(len(rank), -np.inf), np.full(len(rank), -np.inf)
        back, by = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int32)  # length and id of each place's last piece
        one[base] = 0.0
        piece = self.piece[node]
        for a, b in zip([0, *bounds], bounds):  # no two pieces of one start have one end
            i, j, x = start[a:b], end[a:b], value[a:b]
            old = one[j]
            v = one[i] + x
            better = v > old
            two[j] = np.where(better, np.maximum(old, two[i] + x), np.maximum(two[j], v))
            one[j] = np.maximum(old, v)
            j = j[better]
            back[j], by[j] = length[a:b][better], piece[a:b][better]
        last = base + size
        at, live, used, found = last, np.arange(len(parts)), np.zeros(len(parts), np.int64), []
        while len(live):
            used[live] += 1
            found.append((live, by[at]))
            at = at - back[at]
            more = at > base[live]
            at, live = at[more], live[more]
        ids, behind = np.empty(used.sum(), np.int32), np.cumsum(used) - 1
        for k, (live, own) in enumerate(found):
            ids[behind[live] - k] = own
        self._remember(parts, ids, used, one[last], one[last] - two[last])

    def _ending(self, s: str, j: int) -> list[tuple]:
        """``_into(s)[j]``, for long parts: nothing is kept for the places that no way comes by."""
        get, out = self.pieces.get, []
        for i in range(max(0, j - self.most), j):
            if p := get(s[i:j]):
                out.append((i, (p[0],), p[1]))
        if s[j - 1] not in self.pieces:
            b = s[j - 1].encode()
            out.append((j - 1, tuple(self.byte_ids[x] for x in b), self.worst * len(b)))
        return out

    def _fore(self, s: str) -> array:
        """Forward Viterbi: the score of the best way to each place."""
        n, get = len(s), self.prefixes.get
        fore = array("d", [-math.inf]) * (n + 1)
        fore[0] = 0.0
        for i in range(n):
            a = fore[i]
            if s[i] not in self.pieces:
                fore[i + 1] = max(fore[i + 1], a + self.worst * len(s[i].encode()))
            for j in range(i + 1, n + 1):
                p = get(s[i:j], 0)
                if p == 0:
                    break
                if p and a + p[1] > fore[j]:
                    fore[j] = a + p[1]
        return fore

    def n_best(self, s: str, n: int, limit: float = math.inf) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids), of those that lose ``limit`` at most: backward A-star on forward Viterbi scores.

        The heuristic is exact, so each open state stands for a way of its own with its whole score: no more states are kept open than
        ways are still wanted.  A state holds its pieces as a link to the state that it came from.
        """
        wider, known = self.more.get((s, n), (-1.0, None))
        if wider >= limit:
            return known
        size = len(s)
        if size <= SHORT:
            into, fore = self._into(s), [0.0] + [-math.inf] * size
            for j in range(1, size + 1):
                fore[j] = max((fore[i] + x for i, _, x in into[j]), default=-math.inf)
        else:
            into, fore = None, self._fore(s)
        least = fore[size] - limit - 1e-9
        # (minus the whole score, number, place, score behind it, (ids, link)), best first
        live: list = [(-fore[size], 0, size, 0.0, None)]
        out, made = [], 0
        while live and len(out) < n:
            _, _, j, behind, link = live.pop(0)
            if not j:
                ids: list = []
                while link:
                    ids.extend(link[0])
                    link = link[1]
                out.append((behind, tuple(ids)))
                continue
            room = n - len(out)
            for i, own, x in into[j] if into else self._ending(s, j):
                if (whole := fore[i] + x + behind) >= least and (len(live) < room or -whole < live[-1][0]):
                    made += 1
                    insort(live, (-whole, made, i, behind + x, (own, link)))
                    del live[room:]
        if size <= 64:
            if len(self.more) >= self.remember // 8:
                self.more.clear()
            self.more[s, n] = limit, out
        return out

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of a whole text, best first."""
        return [(score, ids.tolist()) for score, ids in next(self.many([text], n))]

    def many(self, texts: list[str | None], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """``encode`` for one text after the other, worked on together in groups of about ``ROOM`` code points."""
        group, size = [], 0
        for t in texts:
            if group and size + len(t or "") > ROOM:
                yield from self._ways(group, n)
                group, size = [], 0
            group.append(t)
            size += len(t or "")
        yield from self._ways(group, n)

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The parts' numbers among those of late; parts too long to be remembered come last there, without a name."""
        if 2 * len(self.late.number) > self.remember:  # half of what may be remembered is new: the old half goes
            self.late, self.old = Solved(), self.late
        known = self.late.number
        out = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        if len(new):
            names = [parts[k] for k in new.tolist()]
            self.learn(set(names))
            brief = {s: 0 for s in names if len(s) > SHORT_PART}
            for s in brief:
                brief[s] = self.late.add(*self._alone([s]))
            out[new] = [brief[s] if len(s) > SHORT_PART else known[s] for s in names]
        return out

    def _ways(self, texts: list[str | None], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        each = [self.split(" " + t) if t else [] for t in texts]
        count = np.fromiter(map(len, each), np.int64, len(each))
        parts = list(chain.from_iterable(each))
        del each
        numbers = self._numbers(parts)
        flat, size, score, loss = self.late.take(numbers)
        self.late.cut(len(self.late.number))
        at, bound, score = np.append(0, np.cumsum(size, dtype=np.int64)), np.append(0, np.cumsum(count)), score.tolist()
        # of each text the n - 1 parts whose second best way loses least, by loss and place
        some = np.flatnonzero(count)
        low = []
        for _ in range(n - 1 if len(some) else 0):
            least = np.minimum.reduceat(loss, bound[some])
            hit = np.flatnonzero(loss == np.repeat(least, count[some]))
            hit = hit[np.searchsorted(hit, bound[some])]
            low.append((least.tolist(), hit.tolist()))
            loss[hit] = np.inf
        k = -1
        for a, b in zip(bound.tolist(), bound[1:].tolist()):
            if a == b:
                yield []
                continue
            k += 1
            total, best = math.fsum(score[a:b]), flat[at[a] : at[b]]
            ways: list[tuple[float, tuple]] = [(0.0, ())]  # (loss, ((part, ids), ...))
            limit = low[-1][0][k] if low else math.inf  # n - 1 ways lose no more than this
            for least, hit in low:
                if least[k] < math.inf:
                    i = hit[k]
                    own, first = self.n_best(parts[i], n, limit), tuple(flat[at[i] : at[i + 1]].tolist())
                    if own[0][1] != first:  # as good: A-star opened another before the one that ``best`` takes
                        own = [(own[0][0], first), *(w for w in own if w[1] != first)][:n]
                    ways = heapq.nsmallest(n, ((lost + own[0][0] - x, (*w, (i, ids))) for lost, w in ways for x, ids in own), key=lambda w: w[0])
            out = [(total, best)]
            for lost, changed in ways[1:]:
                spans, since = [], at[a]
                for i, own in sorted(changed):
                    spans += flat[since : at[i]], np.array(own, np.int32)
                    since = at[i + 1]
                out.append((total - lost, np.concatenate([*spans, flat[since : at[b]]])))
            yield out

    def spelt(self, ids: list[int] | np.ndarray) -> bytes:
        """The text's bytes, without its first space."""
        if not len(ids):
            return b""
        _, ends, data = self.spelling.take(pa.array(np.asarray(ids, np.int32))).buffers()
        return memoryview(data or b"")[1 : np.frombuffer(ends, np.int64)[len(ids)]].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.spelt(ids).decode()


_LATTICES: dict = {}


def lattice_of(model: tuple, remember: int) -> Lattice:
    """One lattice a worker and model, so that parts stay known from task to task."""
    key = (len(model[0]), hash(frozenset(model[0].items())), remember)
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(model, remember)
    return _LATTICES[key]


def offsets(rows: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(offsets(rows), pa.array(np.concatenate([NONE, *rows])))


def encode(docs: DataFrame, model: str = MODEL, n: int = BEST, remember: int = FEWER) -> DataFrame:
    """All columns of ``docs`` and ids, n_pieces, score, nbest (array of score and ids), decoded (in place of columns of these names)."""
    spark = C.ready(docs.sparkSession)
    docs = docs.drop(*ADDED)
    held = spark.sparkContext.broadcast(read_model(model))  # as large as the model file
    place = docs.columns.index("text")

    def run(batches):
        lattice = lattice_of(held.value, remember)
        for b in batches:
            for a in range(0, b.num_rows, 200):
                p = b.slice(a, 200)
                ways = list(lattice.many(p.column(place).to_pylist(), n))
                best, every = [w[0] if w else (0.0, NONE) for w in ways], list(chain.from_iterable(ways))
                ids = [x for _, x in best]
                nbest = pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.float64()), lists([x for _, x in every])], ["score", "ids"])
                more = [lists(ids), pa.array(map(len, ids), pa.int64()), pa.array([s for s, _ in best], pa.float64()), pa.ListArray.from_arrays(offsets(ways), nbest), pa.array(map(lattice.decode, ids), pa.string())]
                yield pa.record_batch([*p.columns, *more], [*p.schema.names, "ids", "n_pieces", "score", "nbest", "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, kind) for c, kind in ADDED.items())]))


def digests(docs: DataFrame, model: str = MODEL, n: int = BEST, remember: int = REMEMBER) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), score, nbest_scores, nbest_pieces, decoded_sha256, round_trip."""
    spark = C.ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(read_model(model))

    def run(batches):
        lattice = lattice_of(held.value, remember)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                p = b.slice(a, 1000)
                out: dict = {k: [] for k in ("n_pieces", "ids_sha256", "score", "nbest_scores", "nbest_pieces", "decoded_sha256", "round_trip")}
                texts = p.column(1).to_pylist()
                for t, ways in zip(texts, lattice.many(texts, n)):
                    score, ids = ways[0] if ways else (0.0, NONE)
                    back = lattice.spelt(ids)
                    for k, v in zip(out, (len(ids), hashlib.sha256(ids).hexdigest(), score, [w[0] for w in ways], [len(w[1]) for w in ways], hashlib.sha256(back).hexdigest(), back == (t or "").encode())):
                        out[k].append(v)
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.string(), pa.bool_())
                yield pa.record_batch([p.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_sha256 string, score double, nbest_scores array<double>, nbest_pieces array<int>, decoded_sha256 string, round_trip boolean")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
