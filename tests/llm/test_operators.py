"""The corpus operators against brute force, on small documents with nulls, empty and repeated rows, and clashing columns."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

from nearfield.llm import fingerprints, licenses, mixing, multi_index, near_dedup, pieces, pii, quality, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket long, words string, n long, key string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120).split()
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "aa " * 300), (6, "x" * 900)]
    for i in range(7, 60):
        t = text(rnd.randint(1, 90))
        out.append((i, f"{t} {passage} {text(5)}\n{t[:20]}" if i % 4 == 0 else t))
    for i in range(60, 90):  # near copies
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((i, " ".join(w)))
    out += [(90, out[20][1]), (91, out[20][1]), (95, out[20][1])]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or ""), 1, 2, "w", 3, "k") for i, t in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, rows, empty):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j : j + 13]), i)
    for r in substring_dedup.remove_repeats(docs, block_bytes=2000).collect():
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r["doc_id"]:
                gone[j : j + 13] = [True] * 13
        assert (r["n_words"], r["n_removed"], r["kept"].encode()) == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4, 0])
def test_suffix(docs, rows, empty, hot):
    raw = {i: (t or "").encode() for i, t in rows}
    n = collections.Counter(b[j : j + 200] for b in raw.values() for j in range(len(b) - 199))
    for r in suffix_dedup.remove_repeats(docs, block_bytes=2000, hot=hot).collect():
        b = raw[r["doc_id"]]
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if n[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))
        assert r["n_spans"] == len(re.findall(b"\1+", gone))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_order():
    rnd = random.Random(2)
    for letters in (b"ab", b"a", bytes(range(256))):
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.choice([0, 3, 64, 65, 150]))) for _ in range(300)] + [b"q" * 100 + bytes([rnd.choice(letters)]) * rnd.randint(0, 4) for _ in range(80)]
        texts = list(dict.fromkeys(texts))
        order, lcp = suffix_dedup.deep_shallow_sort(texts)
        got = [texts[i] for i in order]
        key = lambda t: t[:64].ljust(64, b"\0") + t[64:]
        assert sorted(order.tolist()) == list(range(len(texts))) and [key(t) for t in got] == sorted(key(t) for t in texts)
        for a, b, n in zip(got, got[1:], lcp[1:]):
            m = 0
            while m < min(len(a), len(b)) and a[m] == b[m]:
                m += 1
            assert m == n


def test_near(docs, rows, empty):
    for k in (2, 5):
        sets = {}
        for i, t in rows:
            w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        up = {i: i for i in sets}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, k).collect()}
        assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_crowded_region(spark):
    """Near copies, more of them in a block than it sends on, and a far member of their region."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:230] + [f"y{i}" for i in range(70)])] + [f"alone {i} z{i} q{i}" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sets = [set(zip(w, w[1:])) for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert [r["component_id"] for r in near_dedup.near_duplicates(docs, 2).orderBy("doc_id").collect()] == up
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_mixing(docs, rows, empty):
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n), block=16).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str) for n in (1, 6))
    assert a == b and len(a) == len(rows)
    total, per = sum(r[2] for r in a), collections.defaultdict(list)
    for r in a:
        per[r[1]].append(r)
        assert r[2] == len((dict(rows)[r[0]] or "").split()) and r[5] <= 3 * r[2]
    names = sorted(x for x in per if x is not None) + [None]
    size, weight = {s: sum(r[2] for r in per[s]) for s in names}, {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        free -= over
    for s in names:
        assert per[s][0][4] == pytest.approx(target[s]) and abs(sum(r[5] for r in per[s]) - target[s]) <= 1
    assert mixing.mix(empty).count() == 0


def test_fingerprints(docs, rows, spark, empty):
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    by_text = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), edited) and 0 <= r["near_edited"] <= 1
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and by_text.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        if t == u:
            assert r["near_next"] == 1
    assert fingerprints.fingerprints(empty).count() == 0
    blank = spark.createDataFrame([(None, "x y z"), (None, "x y w"), (3, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["edited"]) for r in fingerprints.fingerprints(blank).collect())[2:] == [(1, ""), (3, "a ")]
    w = "a b c d e f g h i j k l m n o p q r s t".split()
    shuffled = w[10:] + w[:10]
    two = spark.createDataFrame([(2, " ".join(w)), (1, " ".join(shuffled))], "doc_id long, text string")
    assert fingerprints.fingerprints(two).where("doc_id = 2").first()["near_next"] < 0.9  # the same k-mers in another order differ


def test_pii(spark, empty):
    extra = "call +1 (212) 555-0100 or mail a.b+c@mail.example.com; host 10.0.0.256 and 10.0.0.255, card 4111 1111 1111 1111 or 4111111111111112 @x.y a@b"
    texts = [None, "", extra, *(f"the zorblatt {n} said write to q@ex.org now" for n in ("alpha", "beta", "gamma", "delta")), *["the plain text said write to now"] * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    r = got[2]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and got[0]["base"] == got[1]["spans"] == ""
    assert got[3]["spans"] == "term:4:12,email:34:42" or got[3]["spans"].startswith("term:4:12,email:") and got[3]["n_term"] == 1
    assert all(not got[i]["spans"] for i in range(7, 47))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "the <TERM> alpha said write to <EMAIL> now" and clean[10] == texts[10] and clean[0] is None
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).columns == empty.columns


def test_pii_term_without_its_value(spark):
    told = [f"the zorblatt {n} said write to q@ex.org now" for n in ("alpha", "beta", "gamma", "delta")]
    alone = ["here Zorblatt stands alone, zorblatt again", "mail r@ex.org for the zorblatt"]
    docs = spark.createDataFrame(list(enumerate([*told, *alone, None, *["the plain text said write to now"] * 60])), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert (got[4]["spans"], got[4]["n_term"]) == ("term:5:13,term:28:36", 2)
    assert got[5]["spans"] == "email:5:13,term:22:30" and got[0]["n_term"] == 1 and not any(got[i]["spans"] for i in range(6, 67))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[4] == "here <TERM> stands alone, <TERM> again" and clean[5] == "mail <EMAIL> for the <TERM>" and clean[6] is None


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    blank = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(blank, quality.train(blank, none)).collect()] != []
    rng = np.random.default_rng(0)
    at, x, v = np.arange(6), rng.normal(size=6), rng.normal(size=(quality.DIM, quality.RANK))
    z, _ = quality._margins(at, x, np.array([0]), 0.5, np.zeros(quality.DIM), v)
    assert z[0] == pytest.approx(0.5 + sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i)))  # the sum-of-squares identity


def test_pieces(docs, rows):
    lattice = pieces.Lattice(pieces.read_model())

    def every(s, i=0):
        if i == len(s):
            return [(0.0, ())]
        ways = [(i + n, (p[0],), p[1]) for n in range(1, len(s) - i + 1) if (p := lattice.pieces.get(s[i : i + n]))]
        if s[i] not in lattice.pieces:
            b = s[i].encode()
            ways.append((i + 1, tuple(lattice.byte_ids[x] for x in b), lattice.worst * len(b)))
        return [(x + y, a + b) for j, a, x in ways for y, b in every(s, j)]

    for t in ("the cat", "a  b", "hellò\nwörld", " x", "日\U0001f600 k", "a▁b"):
        lattice.learn(set(lattice.split(" " + t)))
        got = lattice.encode(t, 4)
        assert [x for x, _ in got] == pytest.approx(sorted((x for x, _ in every(" " + t)), reverse=True)[:4]) and all(lattice.decode(i) == t for _, i in got)
    big = docs.unionAll(docs).unionAll(docs).unionAll(docs).coalesce(1)  # more rows than one slice
    out = pieces.encode(big, n=1).select("doc_id", "text", "decoded", "n_pieces").collect()
    assert len(out) == 4 * len(rows) and all(r["decoded"] == (r["text"] or "") for r in out)
    assert pieces.digests(big).where("round_trip").count() == 4 * len(rows)


def test_multi_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [1.0, 2.0]), (550, [None] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in multi_index.search(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 50)) and [i for i, _ in got[50]] == [51, 52, 53, 54, 55]
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q, hits in got.items():
        s = np.round(y @ y[q], 12)
        s[q] = -9
        hit += len({i for i, _ in hits} & set(np.lexsort((np.arange(400), -s))[:5].tolist()))
        assert all(abs(s[i] - w) < 1e-9 for i, w in hits)
    assert hit >= 0.9 * 5 * len(got)
    blocks = multi_index.search(v, v.where("vec_id % 50 = 0"), block=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in blocks] == [(q, i, pytest.approx(w)) for q in sorted(got) for i, w in got[q]]
    order = multi_index.walk(np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1]), np.ones(6, int), 6)
    assert order == [3, 2, 5, 4, 1, 0]
    assert multi_index.search(v.limit(0), v.limit(0)).count() == 0 and multi_index.search(v.where("vec_id < 3"), v.where("vec_id = 0")).count() == 2


def test_licenses(docs, spark, empty):
    t = licenses.TEMPLATES["GPL-3.0"]
    d = spark.createDataFrame([(1, f"{' '.join(f'w{i}' for i in range(30))}\n{t.upper()}\nmore"), (2, t), (3, None), (4, "word " * 50), (2, "")], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(d).collect()), key=str)
    assert got == sorted([(1, 4, 1, "GPL-3.0", 1.0, 2), (2, 1, 1, "GPL-3.0", 1.0, 0), (3, 1, 0, None, None, None), (4, 1, 0, None, None, None), (2, 1, 1, "GPL-3.0", 1.0, 0)], key=str)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_whole_licences_and_wrapped_notices(spark):
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 78))
    noise = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(60))
    t, w = licenses.TEMPLATES, licenses.WHOLE
    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(wrap(x) for x in w["MIT-text"].split("\n\n")[1:]),
        noise + "\n" + wrap(t["Apache-2.0-notice"], "# ") + "\n" + noise,
        noise + "\n\n" + wrap(w["BSD-3-Clause-text"], " * ") + "\n" + noise,
        w["GPL-3-text"], noise + "\nLicensed under the MIT License.\n" + noise, noise,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_matched"], r["license"], r["unit"]) for r in licenses.scan(d).collect()}
    # the grant or the clauses alone have a Dice of 1, as a run; the whole licence is a second unit
    assert got[0] == (2, "MIT-grant", 5) and got[1] == (1, "Apache-2.0-notice", 61) and got[2] == (2, "BSD-3-Clause-text", 62)
    assert got[3][1:] == ("GPL-3-text", 0) and got[4] == (1, "MIT-licensed", 61) and got[5] == (0, None, None)
