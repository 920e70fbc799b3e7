"""Plain versions of the corpus operators: slow, one text or one word at a time."""

import collections
import itertools
import math
import re

import xxhash

MASK = 2**64 - 1


def spark_hash(*values, seed=42):
    """xxhash64 as the engine chains it over its arguments; (value, bytes) for numbers of that width."""
    h = seed
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else (v[0] & (2 ** (8 * v[1]) - 1)).to_bytes(v[1], "little")
            h = xxhash.xxh64_intdigest(raw, h & MASK)
    return h


def fingerprint(text, k=3, picks=2, components=64):
    """Order MinHash: for each start point the next k-mers of the ring, in text order, hashed together."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, ring = collections.Counter(), []
    for i in range(max(1, len(words) - k + 1)):
        gram = spark_hash(*words[i : i + k]) >> 28
        ring.append((spark_hash((gram, 8), (seen[gram], 4)) >> 28, i))
        seen[gram] += 1
    ring.sort()
    out = []
    for j in range(components):
        start = j << 30  # a point of 36 bits
        at = sum(h < start for h, _ in ring)
        chosen = sorted((place, h) for h, place in (ring[(at + t) % len(ring)] for t in range(picks)))
        out.append("%016x" % spark_hash(*((h, 8) for _, h in chosen)))
    return "".join(x[:8] for x in out)


def components(texts, k, per_cent=80):
    """Smallest reachable key of each text of {key: text}."""
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    out = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]) and out[a] != out[b]:
            x, y = sorted((out[a], out[b]))
            out = {i: x if c == y else c for i, c in out.items()}
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    """(start, place of the kind, end, kind), by the literal patterns."""
    found = [(m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if _holds(kind, m[0])]
    return sorted(found)


def _parts(kind, value):
    digits = "".join(c for c in value if c in "0123456789")
    part = {"email": value.split("@")[-1].lower(), "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return [(kind, "value", value), (kind, "part", part)]


def spans(texts, support=3, disclosure=0.8, likely=0.66, chance=1e-6):
    """All spans of each text, written; terms by PMI over the whole list."""
    base = [base_spans(t) for t in texts]
    terms = []
    for t, s in zip(texts, base):
        covered = [(a, b) for a, _, b, _ in s]
        terms.append([(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if not any(a < m.end() and m.start() < b for a, b in covered)])
    n = len(texts)
    entity_rows, pair_rows, term_rows = (collections.defaultdict(set) for _ in range(3))
    for i, (t, s) in enumerate(zip(texts, base)):
        for w in {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t or "")}:
            term_rows[w].add(i)
        for e in {e for a, _, b, kind in s for e in _parts(kind, t[a:b])}:
            entity_rows[e].add(i)
            for w in {w for w, _, _ in terms[i]}:
                pair_rows[e, w].add(i)
    telling = set()
    for (e, w), rows in pair_rows.items():
        distinct, c_e, c_t, c = len({texts[i] for i in rows}), len(entity_rows[e]), len(term_rows[w]), len(rows)
        if distinct < 2 or c_e >= n:
            continue
        mean = c_e * c_t / n
        told = distinct >= support and c >= likely * c_t and math.log2(n * c / (c_e * c_t)) >= disclosure * math.log2(n / c_e)
        if e[1] == "part":
            told = told and c > mean and c * (1 + math.log(mean / c)) - mean <= math.log(chance)
        if told or c == c_t:
            telling.add(w)
    out = []
    for s, own in zip(base, terms):
        every = sorted([(a, k, b, kind) for a, k, b, kind in s] + [(a, 4, b, "term") for w, a, b in own if w in telling])
        out.append(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in every))
    return out


def masked(text, written):
    if text is None:
        return None
    out, at = "", 0
    for kind, a, b in (x.split(":") for x in written.split(",") if x):
        a, b = int(a), int(b)
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def mix(rows, block, golden=0.6180339887498949, epochs=3, chunk=1 << 16):
    """{row: (taken, first slot of each pass)} of [(row, doc_id, source, text)]: slots drawn one by one, words one by one."""
    size = {r: len((t or "").encode().split()) for r, _, _, t in rows}
    names = sorted({s for _, _, s, _ in rows if s is not None}) + [None] * any(s is None for _, _, s, _ in rows)
    words = {s: sum(size[r] for r, _, x, _ in rows if x == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = sum(words.values())
    target, free, left = {}, set(names), float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * words[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(epochs * words[s])
            left -= target[s]
        free -= over
    need = {s: math.floor(target[s] + 0.5) for s in names}
    stream = {}
    for s in names:
        own = [(spark_hash(None if i is None else (i, 8), t) >> 1, -1 if i is None else i, size[r], r) for r, i, x, t in rows if x == s]
        stream[s] = [r for *_, r in sorted(own) for _ in range(size[r])]
    bounds = list(itertools.accumulate(target[s] for s in names))
    drawn, order = collections.Counter(), []
    n_slots = -(-total // block)
    for t in range(n_slots):
        x = (t // chunk * (chunk * golden % 1.0) % 1.0 + t % chunk * golden % 1.0 + 0.5) % 1.0
        s = next(s for s, b in zip(names, bounds) if x < b / bounds[-1])
        order.append((t, s, drawn[s]))
        drawn[s] += 1
    for s in names:
        order += [(n_slots + r, s, r) for r in range(drawn[s], -(-need[s] // block))]
    taken, first = collections.Counter(), {}
    for t, s, rank in order:
        for at in range(rank * block, min((rank + 1) * block, need[s])):
            r = stream[s][at % words[s]]
            taken[r] += 1
            first.setdefault((r, at // words[s]), t)
    return {r: (taken[r], [first.get((r, e)) for e in range(epochs)]) for r in size}


def machine(at, x, model):
    """A factorisation machine's probability, pair by pair."""
    w0, w, v = model
    z = w0 + sum(float(w[i]) * float(a) for i, a in zip(at, x))
    for p in range(len(at)):
        for q in range(p):
            z += sum(float(a) * float(b) for a, b in zip(v[at[p]], v[at[q]])) * float(x[p]) * float(x[q])
    return 1 / (1 + math.exp(-z))


def best_score(pieces, byte_ids, worst, text):
    """Score of the best segmentation, place by place over the whole text."""
    s = " " + text
    score = [0.0] + [-math.inf] * len(s)
    longest = max(map(len, pieces))
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            if s[i:j] in pieces:
                score[j] = max(score[j], score[i] + pieces[s[i:j]][1])
        if s[j - 1] not in pieces:
            score[j] = max(score[j], score[j - 1] + worst * len(s[j - 1].encode()))
    return score[-1]
