"""Phrase mining against plain counting, and the suffix arrays by their definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import phrases
from tests.llm.brute import LOWER

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, rank int, a int"


def brute(docs, least, longest, top, inside):
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, longest + 1):
                for s in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[s : s + size])] += 1
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(o == lang and len(q) > len(p) and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), c in found.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "Ä", "ä", "d e", "x-y", "\U0001f600", "it's"]
    gap = lambda: rng.choice([" "] * 9 + ["  ", "\t", ", ", ". ", "\n", " ; ", ":", "\r\n", "\x0b"])
    return [("".join(rng.choice(words) + gap() for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" \t", "fr"), ("a a a a a " * 300, "en"), ("..!", "es")]


def table(spark, docs):
    return spark.createDataFrame([(1, t, lang, "p", 1, 1, 1) for t, lang in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize(("least", "longest", "top", "inside", "shard", "bits"), [(10, 3, 2000, 50, 1 << 21, 1 << 27), (4, 3, 7, 50, 50, 1 << 27), (3, 4, 30, 80, 1000, 1 << 27), (5, 5, 1000, 20, 100, 1 << 10)])
def test_phrases(spark, monkeypatch, least, longest, top, inside, shard, bits):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "MAX_BITS", bits)
    docs = texts(least, 160)
    want = brute(docs, least, longest, top, inside)
    assert len(want) > 10
    got = phrases.mine_phrases(table(spark, docs), least, longest, top, inside)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want


def test_no_phrases(spark):
    assert phrases.mine_phrases(table(spark, [])).count() == 0
    assert phrases.mine_phrases(table(spark, [(None, None), ("a b", "en")])).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of which the products need over 64 bits are exact."""
    big = 3_000_000_019
    rows = [("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 2), ("en", "", 2 * big + 3)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: spark.createDataFrame(rows, phrases.COUNTS))
    assert phrases.mine_phrases(table(spark, [])).first()["score"] == 10**6 * big * big // ((big + 1) * (big + 2))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_suffix_array_by_definition(seed, longest):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, rng.integers(2, 6), rng.integers(0, 60))
    order, lcp = phrases.suffix_array(ids, longest)

    def prefix(i):
        own = ids[i : i + longest].tolist()
        return tuple(own[: own.index(0)] if 0 in own else own)

    assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()
    for i in range(1, len(order)):
        a, b = prefix(order[i - 1]), prefix(order[i])
        assert lcp[i] == next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b)))
    for size in range(1, longest + 1):
        want = Counter(p for i in order.tolist() if len(p := prefix(i)[:size]) == size)
        first, n = phrases.intervals(ids, order, lcp, size)
        assert {prefix(i)[:size]: c for i, c in zip(first.tolist(), n.tolist(), strict=True)} == want and len(first) == len(want)
    start = rng.random(len(ids)) < 0.5
    part, least = phrases.chosen(order, lcp, start)
    first, n = phrases.intervals(ids, part, least, longest)
    assert dict(zip((prefix(i) for i in first.tolist()), n.tolist(), strict=True)) == Counter(p for i in order.tolist() if start[i] and len(p := prefix(i)) == longest)
