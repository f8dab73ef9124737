"""The quality classifier: its network by definition, its passages, and held-out accuracy."""

import random

import numpy as np
import pytest

from seqloom.llm import quality

RNG = np.random.default_rng(2)


def small(n_docs=4, width=5):
    size = RNG.integers(1, 5, n_docs)
    first = np.append(0, np.cumsum(size))
    return quality.Model.fresh(width, 4, 3), RNG.normal(size=(first[-1], width)), first, RNG.integers(0, 2, n_docs).astype(float)


def test_attention_by_definition():
    m, x, first, _ = small()
    found = quality.Model.forward(m, x, first)
    for d in range(len(first) - 1):
        h = np.tanh(x[first[d] : first[d + 1]] @ m["E"] + m["e"])
        s = np.array([sum(m["w"][j] * np.tanh(r @ m["V"][:, j]) / (1 + np.exp(-(r @ m["U"][:, j]))) for j in range(3)) for r in h])
        a = np.exp(s) / np.exp(s).sum()
        assert np.isclose(found["p"][d], 1 / (1 + np.exp(-((a @ h) @ m["c"] + m["c0"][0]))))
        assert np.isclose(found["a"][first[d] : first[d + 1]].sum(), 1)


def test_gradient_agrees_with_differences():
    m, x, first, y = small()
    m["e"], m["c0"] = RNG.normal(size=4), RNG.normal(size=1)
    _, grad = quality.Model.gradient(m, x, first, y)
    for k in m:
        for at in np.ndindex(m[k].shape):
            old, values = m[k][at], []
            for step in (1e-6, -1e-6):
                m[k][at] = old + step
                values.append(quality.Model.gradient(m, x, first, y)[0])
            m[k][at] = old
            assert abs((values[0] - values[1]) / 2e-6 - grad[k][at]) < 1e-6


def test_passages_hold_whole_texts():
    texts = ["", "one", " lead and trail ", "w " * 1000, "x " * 20_000 + "END!", "a b c " * 40, "ü" * 300]
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    x, first = quality.passages(np.frombuffer(b"".join(raw), np.uint8), off)
    sizes = np.diff(first).tolist()
    assert sizes == [1, 1, 1, -(-1000 // 48), -(-20_001 // -(-20_001 // 128)), 3, 1] and max(sizes) <= quality.PASSAGES
    assert np.isfinite(x).all() and not x[0].any()
    alone = [quality.passages(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(x, np.concatenate(alone))
    last = x[first[5] - 1]
    assert last[2 * quality.CLASSES + 2] > 0  # capitals follow capitals at the very end of the longest text
    assert x[first[5] : first[6], -quality.MEASURES].tolist()[1:] == [1.0, 1.0]  # all words have occurred before


def corpus(n):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        bad = rng.random() < 0.3
        if bad:  # one damaged stretch somewhere
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + 60] = [x.upper() + "!!" if kind == 0 else x + "***" if kind == 1 else "| " + x for x in w[at : at + 60]]
        docs.append((d, " ".join(w)))
        labels.append((d, int(not bad)))
    return docs, labels


def test_quality(spark):
    docs, labels = corpus(600)
    extra = [(None, "null id"), (1001, None), (1002, ""), (1003, "w " * 100_000), (5, docs[5][1]), (1004, "\x00\x01")]
    frame = spark.createDataFrame([(d, t, "x", 0.5) for d, t in docs + extra], "doc_id long, text string, label string, score double").repartition(3)
    marks = spark.createDataFrame([(d, q, 9) for d, q in labels] + [(None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(frame, marks).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and __import__("zlib").crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) >= 0.93 * len(held)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    flipped = marks.withColumn("quality", marks["quality"] * 0 + 1 - marks["quality"]).where("crc32(cast(doc_id as string)) % 5 = 0").unionByName(marks.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    again = quality.score_quality(frame, flipped).collect()
    assert sorted((r["doc_id"] or -1, r["score"]) for r in again) == sorted((r["doc_id"] or -1, r["score"]) for r in rows)


@pytest.mark.parametrize("values", [[], [1, 1, 1], [None]])
def test_without_labels_of_both_kinds(spark, values):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(9)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q) for i, q in enumerate(values)], "doc_id long, quality int")
    assert len({r["score"] for r in quality.score_quality(docs, marks).collect()}) == 1
    assert quality.score_quality(docs.limit(0), marks).count() == 0
