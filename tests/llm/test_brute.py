"""Operators and pipeline against plain versions; clashing names, null and repeated ids, empty tables, long texts."""

import collections
import random
import subprocess
import sys
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import common, fingerprints, licenses, mixing, near_dedup, pieces, pii, quality, substring_dedup, suffix_dedup

from . import brute

SF = "/root/testdata/sf0.001"
#: names that the operators use themselves
CLASHING = ("ids", "score", "base", "spans", "n_email", "rest", "row", "values", "same", "flags", "given", "taken", "slots", "block", "key", "size", "__score", "component_id", "kept")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): copies, near copies, personal data, null and repeated ids, blank texts."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeéßn") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    out = [(0, None, "a"), (1, "", "b"), (2, " \n", None), (None, text(30), "a"), (None, None, None)]
    for i in range(3, 60):
        out.append((i, text(rnd.randint(1, 60)), rnd.choice(["a", "b", "c", None])))
    base = text(80).split()
    for i in range(60, 75):
        w = list(base)
        w[rnd.randrange(80)] = rnd.choice(words)
        out.append((i, " ".join(w), "b"))
    for i in range(75, 83):
        out.append((i, f"{text(6)} write zorro{i % 2}x to q{i % 2}@mail.example.com or +1 (212) 555-010{i} {text(4)}", "c"))
    out += [(90, "host 10.1.2.3 and 10.1.2.300, card 4111 1111 1111 1111", "a"), (7, text(25), "a"), (7, text(25), "a"), (8, out[20][1], "b"), (None, out[20][1], "b"), (None, out[20][1], "c")]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), *(f"{c} {n}" for c in CLASHING)) for n, (i, t, s) in enumerate(rows)], schema).repartition(3).persist()


def test_order_minhash(spark, rows):
    texts = sorted({t for _, t, _ in rows if t}) + ["x y x y x y x y", "one", ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fingerprints.fingerprints(d).orderBy(F.desc("doc_id")).collect()
    want = [brute.fingerprint(t) for t in reversed(texts)]
    assert [r["fingerprint"] for r in got] == want
    for r, a, b in zip(got, want, want[1:] + want[:1]):
        c = brute.fingerprint(r["edited"])
        same = lambda x, y: sum(x[j : j + 8] == y[j : j + 8] for j in range(0, 512, 8)) / 64
        assert (r["edited_fingerprint"], r["near_edited"], r["near_next"]) == (c, same(a, c), same(a, b))


def test_schedule(docs, rows, spark):
    d = spark.createDataFrame([(n, i, t, s) for n, (i, t, s) in enumerate(rows)], "n long, doc_id long, text string, source string").repartition(4)
    got = {r["given"]["n"]: (r["taken"], [] if r["slots"] is None else list(r["slots"])) for r in mixing.mix(d, block=16, keep=True).collect()}
    want = brute.mix([(n, i, s, t) for n, (i, t, s) in enumerate(rows)], 16)
    # rows equal in id and text stand in either order
    key = lambda x: sorted((str(rows[n]), v[0], v[1] if any(y is not None for y in v[1]) else []) for n, v in x.items())
    assert key(got) == key(want)
    other = brute.mix([(n, i, s, t) for n, (i, t, s) in enumerate(rows)], 16, golden=0.0)
    assert key(other) != key(want)
    # laid out by slot
    out = [r["n"] for r in mixing.mixed(d, block=16).collect()]
    times = {n: int(v[0] / len((rows[n][1] or "").split()) + 0.5) for n, v in want.items() if v[0]}
    assert collections.Counter(str(rows[n]) for n in out) == sum((collections.Counter({str(rows[n]): k}) for n, k in times.items()), collections.Counter())
    at = [want[n][1] for n in out]
    firsts = [min(x for x in s if x is not None) for s in at]
    assert firsts[0] == 0 and firsts[:10] == sorted(firsts[:10])


def test_pii_by_literal_patterns_and_counts(spark, rows):
    rnd = random.Random(5)
    odd = ["".join(rnd.choice("a1@.+ -9()x0255") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert [[(a, k, b) for a, k, b, _ in brute.base_spans(t)] for t in odd] == [pii.base_spans(t) for t in odd]
    real = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [[(a, k, b) for a, k, b, _ in brute.base_spans(t)] for t in real] == [pii.base_spans(t) for t in real]
    texts = [t for _, t, _ in rows]
    told = ["the far depot of zanzibar lists 10.20.%d.%d today" % (i, i) for i in range(12)] + ["plain words of no use %d" % i for i in range(150)]
    for every in (texts, texts + told):
        d = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["spans"] for r in pii.find(d).collect()}
        assert [got[i] for i in range(len(every))] == brute.spans(every)
    assert any("term" in x for x in brute.spans(texts)) and "term" in brute.spans(texts + told)[len(texts)]


def test_terms_between_many_spans():
    spans = [(i * 2, 0, i * 2 + 1) for i in range(6)] + [(0, 1, 40)]
    assert pii._terms("abcdefghij klm nopqrstuvwxyz abcdefghij klmnop qrs", sorted(spans)) == [("klmnop", 40, 46), ("qrs", 47, 50)]


def test_machine_pair_by_pair(spark, rows):
    texts = [t for _, t, _ in rows][:40]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    model = quality.train(d, labels)
    for r in quality.score(d, model).collect():
        assert r["score"] == pytest.approx(brute.machine(*quality.features(r["text"]), model), abs=1e-5)
    # bounds hold where one doc_id has many rows
    many = d.withColumn("doc_id", F.lit(1).cast("long"))
    for small in (dict(sample=5), dict(slots=200)):
        assert quality.train(many, labels, **small)[2].shape == model[2].shape


def test_just_under_the_threshold(spark, monkeypatch):
    """2,000 texts that share 79 % and are linked with nothing: regions are large, and no sets are compared in the second round."""
    base = " ".join(f"b{i}" for i in range(227))
    d = spark.createDataFrame([(i, f"{base} " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(2000)], "doc_id long, text string")
    left, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: left.append((df.columns, (out := cut(df)).count())) or out)
    got = near_dedup.near_duplicates(d, 2)
    assert got.where("component_id = doc_id AND kept").count() == 2000
    alive = [n for c, n in left if c == ["zone", "rep", "component"]]
    sized = [n for c, n in left if c == ["zone", "rep", "component", "n", "most"]]
    assert alive == [0] and sized == [2000]


def test_long_unspaced_text():
    code = "import random, resource\nfrom nearfield.llm import pieces\nm = pieces.Lattice(pieces.read_model())\nr = random.Random(1)\nt = ''.join(r.choice('abcdefghijklmnopqrstuvwxyzé日') for _ in range(1000000))\nw = m.encode(t, 4)\nassert len(w) == 4 and all(m.decode(x) == t for _, x in w) and len({tuple(x) for _, x in w}) == 4\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 500


def test_n_best_of_a_long_part_is_that_of_short_ones(monkeypatch):
    m = pieces.Lattice(pieces.read_model())
    s = " " + "internationalisation" * 3 + "日x"
    want = m.n_best(s, 5)
    m.more.clear()
    monkeypatch.setattr(pieces, "SHORT", 0)
    got = m.n_best(s, 5)
    assert [x for x, _ in got] == pytest.approx([x for x, _ in want]) and len({i for _, i in got}) == 5
    assert got[0][0] == pytest.approx(brute.best_score(m.pieces, m.byte_ids, m.worst, s[1:]))


def test_operators_with_clashing_names_and_odd_ids(docs, rows):
    n = len(rows)
    assert fingerprints.fingerprints(docs).count() == n
    assert pieces.encode(docs, n=2).where("decoded = coalesce(text, '')").count() == n
    assert pieces.digests(docs).where("round_trip").count() == n
    assert mixing.mix(docs).count() == n
    assert substring_dedup.remove_repeats(docs).agg(F.sum("n_words")).first()[0] == sum(len((t or "").split()) for _, t, _ in rows)
    assert near_dedup.near_duplicates(docs).count() == n
    assert licenses.scan(docs).count() == n
    assert sorted(r["spans"] for r in pii.find(docs).collect()) == sorted(brute.spans([t for _, t, _ in rows]))
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.where("base LIKE 'base %' AND spans LIKE 'spans %'").count() == n
    scored = quality.score(docs, quality.train(docs, docs.limit(0).select("doc_id", F.lit(1).alias("quality"))))
    assert scored.count() == n and scored.schema["score"].dataType.simpleString() == "double"
    assert suffix_dedup.remove_repeats(docs).agg(F.sum("n_bytes")).first()[0] == sum(len((t or "").encode()) for _, t, _ in rows)


def test_empty_tables(docs):
    none = docs.limit(0)
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(none, labels)
    for out in (pieces.encode(none), pieces.digests(none), quality.score(none, model), mixing.mixed(none), pii.sanitise(none), near_dedup.near_duplicates(none)):
        assert out.isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(docs.sparkSession, none, SF)
        assert after.isEmpty() and set(docs.columns) <= set(after.columns), name


def test_pipeline_stage_by_stage(docs, rows, spark, monkeypatch):
    """Every decision of every stage against its plain version, on rows with null and repeated ids and clashing columns."""
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    monkeypatch.setattr(common, "table", lambda spark, sf_dir, name: labels if name == "labels" else docs)
    stages = dict(corpus_pipeline.STAGES)
    whole = docs.drop("__score").withColumnRenamed("ids", "ids2").withColumn("ids", F.lit("mine"))

    model = quality.train(whole, labels)
    passed = common.cut(stages["quality classifier"](spark, whole, SF))
    assert passed.columns == whole.columns
    good = [r["key"] for r in whole.collect() if brute.machine(*quality.features(r["text"]), model) >= quality.THRESHOLD]
    assert sorted(r["key"] for r in passed.collect()) == sorted(good) and good

    given = passed.collect()
    order = sorted(range(len(given)), key=lambda j: (given[j]["doc_id"] is None, given[j]["doc_id"] or 0, brute.spark_hash(given[j]["text"]) if given[j]["text"] is not None else 42))
    texts = {rank: given[j]["text"] for rank, j in enumerate(order)}
    groups = brute.components(texts, 5)
    sizes = collections.Counter(groups.values())
    alone = common.cut(stages["near dedup"](spark, passed, SF))
    kept = alone.collect()
    assert alone.columns == passed.columns and len(kept) == len(sizes) < len(given)
    by_key = {given[j]["key"]: groups[rank] for rank, j in enumerate(order)}
    assert len({by_key[r["key"]] for r in kept}) == len(sizes)
    least = {g: min((given[j]["doc_id"] for rank, j in enumerate(order) if groups[rank] == g and given[j]["doc_id"] is not None), default=None) for g in sizes}
    assert all(r["doc_id"] == least[by_key[r["key"]]] for r in kept)

    clean = common.cut(stages["pii"](spark, alone, SF))
    got = {r["key"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    want = [brute.masked(r["text"], s) for r, s in zip(kept, brute.spans([r["text"] for r in kept]))]
    assert clean.columns == alone.columns and [got[r["key"]] for r in kept] == [(t, None if t is None else len(t)) for t in want]

    taken = common.cut(stages["source mixing"](spark, clean, SF))
    rest = clean.collect()
    plan = brute.mix([(r["key"], r["doc_id"], r["source"], r["text"]) for r in rest], mixing.BLOCK_WORDS)
    times = {r["key"]: int(plan[r["key"]][0] / max(1, len((r["text"] or "").encode().split())) + 0.5) for r in rest}
    assert taken.columns == clean.columns and collections.Counter(r["key"] for r in taken.collect()) == collections.Counter({k: n for k, n in times.items() if n})

    out = stages["pieces"](spark, taken, SF)
    lattice = pieces.Lattice(pieces.read_model())
    for r in out.collect():
        assert r["round_trip"] and lattice.decode(r["ids"]) == (r["text"] or "") if r["text"] else not r["ids"]
        assert r["score"] == pytest.approx(brute.best_score(lattice.pieces, lattice.byte_ids, lattice.worst, r["text"] or "") if r["text"] else 0.0)
    assert out.count() == taken.count()


def test_pieces_of_many_texts_are_those_of_each(rows):
    """Scores and ids of a group, with parts forgotten and found again, against backward A-star over each whole text."""
    model, rnd = pieces.read_model(), random.Random(6)
    odd = [None, "", " ", "  ", "\n", "é" * 64, "日" * 70, "a" * 63 + " c", "\0a \0"]
    texts = [t and t[:150] for _, t, _ in rows] + odd + ["".join(rnd.choice("ab ce\n\té日x  \U0001f600▁\0") for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    plain, small = pieces.Lattice(model), pieces.Lattice(model, 40)
    for n in (1, 4):
        groups = [w for a in range(0, len(texts), 20) for w in small.many(texts[a : a + 20], n)]
        for t, ways in zip(texts, groups, strict=True):
            want = plain.n_best(" " + t, n) if t else []
            assert [x for x, _ in ways] == pytest.approx([x for x, _ in want]) and all(small.decode(i) == t for _, i in ways)
            assert len({tuple(i.tolist()) for _, i in ways}) == len(ways)  # where ways are equally good, too
            assert [x.tolist() for _, x in ways] == [x for _, x in small.encode(t, n)]
            if ways:
                assert ways[0][0] == pytest.approx(brute.best_score(plain.pieces, plain.byte_ids, plain.worst, t))


def test_learning_many_parts_takes_little():
    """Memory and time of a remembered part: what op 2 spends most on where words are ever new."""
    rnd = random.Random(4)
    syllables = ["an", "ble", "wh", "st", "ti", "th", "re", "in", "er", "on", "ed", "or", "ent", "ly", "ß", "é"]
    words = sorted({" " + "".join(rnd.choice(syllables) for _ in range(rnd.randint(3, 6))) for _ in range(30000)})
    model, ratio = pieces.read_model(), []
    for _ in range(3):
        m = pieces.Lattice(model)
        m.learn({"a"})
        begin = time.process_time()
        m.learn(set(words))
        middle = time.process_time()
        for w in words:
            m.best(w)
        ratio.append((time.process_time() - middle) / (middle - begin))
    assert max(ratio) > 4
    m = pieces.Lattice(model)
    m.learn({"a"})
    tracemalloc.start()
    m.learn(set(words))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 170 * len(words)
