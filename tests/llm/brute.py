"""Plain Python versions of the operators: (doc_id, text) lists in, rows out."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, width=13):
    ws = {d: WORD.findall(t or "") for d, t in docs}
    least = {}
    for d, w in ws.items():
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, d), d)
    out = {}
    for d, w in ws.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and d != max(held[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def contamination(docs, bench, window=10):
    pats = defaultdict(set)
    for i, t in bench:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            pats[tuple(w[s : s + m])].add(str(i))
    sizes = {len(p) for p in pats}
    out = {}
    for d, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (own := pats.get(tuple(w[s : s + m]))) is not None:
                    hit.update(range(s, s + m))
                    items |= own
        out[d] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    return out


def hits(text, bench, window=10):
    """The number of words, the hit ones and the items of one text."""
    w = BENCH_WORD.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for i, t in bench:
        own = BENCH_WORD.findall(t.translate(LOWER))
        for s in range(len(own) - window + 1):
            for p in range(len(w) - window + 1):
                if w[p : p + window] == own[s : s + window]:
                    hit.update(range(p, p + window))
                    items.add(i)
    return len(w), tuple(sorted(hit)), tuple(sorted(items))


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(docs, k=3, percent=90):
    """doc_id: (number of shingles, smallest doc_id of the component); near-linear only because of the index."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    index = defaultdict(list)
    for d in sorted(sets):
        share = Counter()
        for g in sets[d]:
            share.update(index[g])
            index[g].append(d)
        for e, n in share.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_scores(docs):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in docs}
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter()
    for d, w in tokens.items():
        if not out_of[d]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {d: (out_of[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in tokens.items()}


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_secrets(text):
    t = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    spans.sort(key=lambda s: (s[1], order.index(s[0])))
    return spans


MASK = (1 << 64) - 1


def finalise(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def syncmer_anchors(data, k, s, codes, radix):
    """(position, hash) of every k-mer whose least s-mer by hash is its first or last one, k-mer by k-mer."""
    power = [pow(radix, i, 1 << 64) for i in range(k)]
    hashed = lambda at, n: finalise(sum(codes[data[at + i]] * power[i] for i in range(n)) & MASK)
    inner = [hashed(i, s) for i in range(len(data) - s + 1)]
    out = []
    for i in range(len(data) - k + 1):
        least = min(inner[i : i + k - s + 1])
        if least in (inner[i], inner[i + k - s]):
            out.append((i, hashed(i, k)))
    return out


def fingerprint(data, codes, radix, k=16, s=6, size=64):
    """{32-bit hash: first position} of the `size` anchors of least hash."""
    anchors = []
    if len(data) >= 4 * k:
        anchors += syncmer_anchors(data, k, s, codes, radix)
    if len(data) < 8 * k:
        anchors += syncmer_anchors(data, 6, 2, codes, radix)
    first = {}
    for at, h in anchors:
        first.setdefault(h >> 32, at)
    if not first and data:
        first = {int.from_bytes(hashlib.sha256(data).digest()[:4], "little"): 0}
    return dict(sorted(first.items())[:size])


def fingerprint_likeness(a, b, size=64, slack=8):
    """Share of common anchors among the least of the union, of those whose offset agrees with a neighbour's."""
    if not a or not b:
        return float(len(a) == len(b))
    union = sorted(set(a) | set(b))[:size]
    common = sorted((a[h], b[h] - a[h]) for h in union if h in a and h in b)
    kept = sum(len(common) == 1 or (i > 0 and abs(common[i][1] - common[i - 1][1]) <= slack) or (i + 1 < len(common) and abs(common[i][1] - common[i + 1][1]) <= slack) for i in range(len(common)))
    return kept / len(union)
