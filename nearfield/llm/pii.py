"""PII (operator 8): base patterns plus information-theoretic sanitisation of terms that reveal them.

The protected entities are the base values (e-mail, ip, card, phone) and the parts that several values share: an e-mail's
domain, an ip's first two numbers, a card's first six digits, a phone's first four.  Over the whole corpus, N rows, an entity e is in c(e) rows, a
term t in c(t), both in c(e, t).  A term's disclosure of e is PMI(e; t) / IC(e) with PMI = log2(N c(e,t) / (c(e) c(t))) and
IC(e) = -log2(c(e) / N): 1 when seeing the term tells the entity.  A term is telling if it was seen with the entity in

* ``support`` different texts at least, at a disclosure of ``disclosure`` or more, and in ``likely`` of the term's rows at least (for a rare entity a
  disclosure of 0.8 alone may mean one row in five: too little to touch the other four); and, where the entity is a part, which many unrelated rows
  share, so often together that chance (Poisson with mean c(e) c(t) / N, by its Chernoff bound) has a probability of at most ``chance``; or
* two different texts at least, and never without it (disclosure 1): such a term stands only in rows that hold the entity.

Telling terms are spans of kind ``term`` wherever they stand, beside the entity or not; base spans are never touched.

Counts run over all rows: term counts are combined in each batch and shuffled as 64-bit hashes, co-occurrence only for
rows that hold an entity of two texts or more.  Telling terms are looked up in all rows: a bitmap of fixed size of their hashes goes to every
task, what passes it is joined with the terms themselves (in SALTS parts, as a term may stand in a third of all rows),
and spans come back by row.

Null text: empty.  Rows with one doc_id get a row each.  Null doc_id is kept.  Empty table: empty result.  Very long texts are scanned whole, one at a
time; rows of many entities and terms leave in several batches.  Extra columns are ignored, or carried by ``sanitise``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, DISCLOSURE, LIKELY, CHANCE = 3, 0.8, 0.66, 1e-6
#: bits of the bitmap that thins terms before their exchange, and parts of a term in it
BITS, SALTS = 1 << 26, 32
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is taken whole, so a match can only begin where a run begins
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NOT_DIGIT = re.compile(r"[^0-9]")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[0::2]) + sum(DOUBLED[x] for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind indexes KINDS."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # every match holds one @ after its longest local part
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(int(x[-4:]) <= 255 and (len(x) < 4 or not x[:-3].strip("0")) for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode()) - 2**63


def _terms(text: str, spans: list) -> list[tuple[str, int, int]]:
    """(term, start, end) outside of base spans."""
    out, i = [], 0
    ends: list = []  # base spans, overlapping ones as one
    for a, _, b in spans:
        if ends and a < ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], b)
        else:
            ends.append([a, b])
    for m in TERM.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if i == len(ends) or ends[i][0] >= m.end():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def entities(value: str, kind: int) -> tuple[int, int]:
    """Hashes of the value (even) and of the part of it that other values may share (odd)."""
    if kind == 0:
        part = value.rpartition("@")[2].lower()
    elif kind == 1:
        part = ".".join(value.split(".")[:2])
    else:
        part = NOT_DIGIT.sub("", value)[: 6 if kind == 2 else 4]
    return _hash(f"{KINDS[kind]}:{value}") & ~1, _hash(f"{KINDS[kind]}|{part}") | 1


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _read(s: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]


def _masked(text: str, spans: list) -> str:
    """Spans replaced by their kind; overlapping ones together by the first's."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _quoted(name: str):
    return F.col("`{}`".format(name.replace("`", "``")))


def find(docs: DataFrame, keep: tuple[str, ...] = (), support: int = SUPPORT, disclosure: float = DISCLOSURE, likely: float = LIKELY, chance: float = CHANCE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts by base kind, n_term, base and spans (written); with ``keep``, the sanitised text and those columns in the struct ``rest``."""
    spark = C.ready(docs.sparkSession)
    whole = bool(keep)
    docs = docs.select("doc_id", "text", F.struct(*map(_quoted, keep), F.lit(0).alias("__")).alias("rest"))
    rest = docs.schema["rest"].dataType
    kind_of_id = docs.schema["doc_id"].dataType

    def base(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                texts = [t or "" for t in p.column(1).to_pylist()]
                spans = [base_spans(t) for t in texts]
                n = [Counter(k for _, k, _ in s) for s in spans]
                values = [sorted({e for a, k, b in s for e in entities(t[a:b], k)}) for t, s in zip(texts, spans)]
                yield pa.record_batch(
                    [p.column(0), *(pa.array([c[k] for c in n], pa.int64()) for k in range(4)), pa.array(map(_written, spans), pa.string()), pa.array(values, pa.list_(pa.int64())), pa.array([_hash(t) if s else None for t, s in zip(texts, spans)], pa.int64()), p.column(1), p.column(2)],
                    ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "values", "same", "text", "rest"],
                )

    fields = [("doc_id", kind_of_id), *((f"n_{k}", T.LongType()) for k in KINDS[:4]), ("base", T.StringType())]
    schema = T.StructType([T.StructField(c, k) for c, k in [*fields, ("values", T.ArrayType(T.LongType())), ("same", T.LongType()), ("text", T.StringType()), ("rest", rest)]])
    found = C.cut(docs.mapInArrow(base, schema).withColumn("row", F.monotonically_increasing_id()))
    held = found.where("base != ''").select("row", "same", F.explode("values").alias("value"))
    counts = held.groupBy("value").agg(F.count(F.lit(1)).alias("c_e"), F.count_distinct("same").alias("texts")).where(F.col("texts") >= 2).select("value", "c_e")
    # a text is looked at once, with the number of its rows
    once = found.where("base != ''").groupBy("same").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("times")).select("row", "times")
    strong = held.join(counts, "value").groupBy("row").agg(F.collect_list("value").alias("strong")).join(once, "row")
    rows = found.where("base != ''").select("row", "text", "base").join(strong, "row")
    pair = ("times", "value", "term")

    def beside(batches):
        for b in batches:
            out: dict = {k: [] for k in pair}
            for times, t, s, vs in zip(*(x.to_pylist() for x in b.columns)):
                terms = sorted({_hash(w) for w, _, _ in _terms(t, _read(s))})
                for v in vs:
                    out["term"] += terms
                    for c, x in (("times", times), ("value", v)):
                        out[c] += [x] * len(terms)
                    if len(out["term"]) > 100_000:  # a text of many values and terms fills several batches
                        yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in out.items()})
                        out = {k: [] for k in pair}
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in out.items()})

    together = rows.select("times", "text", "base", "strong").mapInArrow(beside, "times long, value long, term long")
    pairs = together.groupBy("value", "term").agg(F.sum("times").alias("c_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= 2)

    def count_terms(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update({w.lower() for w in TERM.findall(t)})
                if len(c) > 400_000:
                    yield pa.record_batch([pa.array(map(_hash, c), pa.int64()), pa.array(c.values(), pa.int32())], ["term", "n"])
                    c = Counter()
        yield pa.record_batch([pa.array(map(_hash, c), pa.int64()), pa.array(c.values(), pa.int32())], ["term", "n"])

    df = docs.select("text").mapInArrow(count_terms, "term long, n int").groupBy("term").agg(F.sum("n").alias("c_t"))
    total = F.lit(found.count())
    pmi = F.log2(total * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    mean = F.col("c_e") * F.col("c_t") / total
    tail = F.col("c_et") * (1 + F.log(mean / F.col("c_et"))) - mean  # log of the bound on P(X >= c_et), for c_et above the mean
    whole_value = F.col("value").bitwiseAND(F.lit(1)) == 0
    rare = (F.col("texts") >= support) & (F.col("c_et") >= likely * F.col("c_t")) & (pmi >= disclosure * F.log2(total / F.col("c_e"))) & (whole_value | ((F.col("c_et") > mean) & (tail <= math.log(chance))))
    telling = pairs.join(df, "term").join(counts, "value").where(F.col("c_e") < total).where(rare | (F.col("c_et") == F.col("c_t")))
    telling = C.cut(telling.select("term").distinct())
    bit = F.pmod("term", F.lit(BITS))
    maps = telling.groupBy((bit / 32768).cast("int").alias("part")).agg(F.expr(f"bitmap_construct_agg(pmod(term, {BITS}) % 32768)").alias("bits")).collect()
    bitmap = bytearray(BITS // 8)
    for m in maps:
        bitmap[4096 * m["part"] : 4096 * (m["part"] + 1)] = m["bits"]
    sent = spark.sparkContext.broadcast(bytes(bitmap))

    def passing(batches):
        """(row, term, its starts and ends) of terms in the bitmap."""
        bits = sent.value
        for b in batches:
            out: dict = {"row": [], "term": [], "at": []}
            for row, t, s in zip(*(x.to_pylist() for x in b.columns)):
                at: dict = {}
                for w, x, y in _terms(t, _read(s)) if t else ():
                    at.setdefault(w, []).extend((x, y))
                for w, places in at.items():
                    h = _hash(w)
                    if bits[(i := h % BITS) >> 3] >> (i & 7) & 1:
                        for k, v in (("row", row), ("term", h), ("at", places)):
                            out[k].append(v)
            yield pa.record_batch([pa.array(out["row"], pa.int64()), pa.array(out["term"], pa.int64()), pa.array(out["at"], pa.list_(pa.int32()))], list(out))

    salted = telling.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    if maps:
        seen = found.select("row", "text", "base").mapInArrow(passing, "row long, term long, at array<int>").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        flags = seen.join(salted.hint("merge"), ["term", "salt"], "left_semi").groupBy("row").agg(F.flatten(F.collect_list("at")).alias("flags"))
    else:
        flags = found.limit(0).select("row", F.array().cast("array<int>").alias("flags"))

    def mark(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                spans_of, n_term, texts = [], [], []
                for s, t, flags in zip(p.column("base").to_pylist(), p.column("text").to_pylist(), p.column("flags").to_pylist()):
                    spans = _read(s)
                    if flags:
                        spans = sorted([*spans, *((x, 4, y) for x, y in zip(flags[::2], flags[1::2]))])
                    spans_of.append(_written(spans))
                    n_term.append(sum(k == 4 for _, k, _ in spans))
                    texts.append(_masked(t, spans) if whole and spans else t)
                names = [*(c for c in p.schema.names if c not in ("flags", "text")), "spans", "n_term", "text"]
                yield pa.record_batch([*(p.column(c) for c in names[:-3]), pa.array(spans_of, pa.string()), pa.array(n_term, pa.int64()), pa.array(texts if whole else [None] * len(texts), pa.string())], names)

    told = found.select("row", *(c for c, _ in fields), (F.col("text") if whole else F.lit(None).cast("string")).alias("text"), "rest").join(flags, "row", "left").drop("row")
    schema = T.StructType([T.StructField(c, k) for c, k in [*fields, ("rest", rest), ("spans", T.StringType()), ("n_term", T.LongType()), ("text", T.StringType())]])
    out = told.mapInArrow(mark, schema)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), "n_term", "base", "spans", *(["text", "rest"] if whole else []))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and telling terms in text replaced by their kind; n_chars, if there, counts again."""
    found = find(docs, keep=tuple(c for c in docs.columns if c != "text"))

    def column(c: str):
        if c == "text":
            return F.col("text")
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("rest").getField(c).alias(c)

    return found.select(*map(column, docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")
