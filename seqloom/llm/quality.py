"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, of which only the document has a label.  Every
passage is encoded; a gated attention learnt from the document labels weighs the
passages, and the weighted sum of their codes is scored:

    h = tanh(x E + e)    a = softmax over the document of (tanh(h V) * sigmoid(h U)) w    p = sigmoid((sum a h) c + c0)

A passage's x holds frequencies of neighbouring character classes (case, digits, marks,
line ends), hashed words, and how much of the passage has occurred before in its
document.  Training sees a bounded sample of labelled documents, in one task; every
document is scored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches, stash
from .toxicity import held_out
from .wordkit import LOWER, NOT_SPACE, U64, by_byte, chunks, hash_spans, mix, spans

#: Labelled documents that the model is fitted on, at most; the least by hash of doc_id.
SAMPLE = 4096
#: Words of a passage; a document of more than PASSAGES such passages has longer ones, so that there are at most so many.
PASSAGE_WORDS, PASSAGES = 48, 128
HASHED = 64

# Classes of characters: 0 other marks, 1 small, 2 capital, 3 digit, 4 beyond ASCII, 5 space, 6 line end, 7 full stop and comma, 8 other sentence marks
CLASSES = 9
CLASS = np.zeros(256, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("0") : ord("9") + 1] = 3
CLASS[0x80:] = 4
CLASS[[0x20, 0x09]] = 5
CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 6
CLASS[[ord("."), ord(",")]] = 7
CLASS[[ord(c) for c in ";:!?'\"()-"]] = 8

MEASURES = 7
WIDTH = CLASSES * CLASSES + HASHED + MEASURES


def repeats(owner: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether each mark has occurred before under the same owner; owners ascend."""
    if not len(mark):
        return np.zeros(0, bool)
    key = mix(mark ^ mix(owner.astype(np.uint64) + U64(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, first): a row of x per passage, and each document's first row (and the end).
    Every document has a passage, an empty one an empty passage."""
    n_docs = len(off) - 1
    starts, ends = spans(by_byte(NOT_SPACE, buf), off)
    of = np.searchsorted(starts, off)
    n_words = np.diff(of)
    size = np.maximum(PASSAGE_WORDS, -(-n_words // PASSAGES))
    n_passages = np.maximum(1, -(-n_words // size))
    first = np.append(0, np.cumsum(n_passages))
    doc = np.repeat(np.arange(n_docs), n_words)
    own = first[doc] + (np.arange(len(starts)) - of[doc]) // size[doc]  # each word's passage
    total = int(first[-1])
    # a passage reaches from its first word (the first: the document's begin) to the next one's
    begin = np.repeat(off[:-1], n_passages)
    head = np.flatnonzero(np.diff(own, prepend=-1))
    begin[own[head]] = starts[head]
    begin[first[:-1]] = off[:-1]
    length = np.diff(np.append(begin, len(buf)))
    count = np.bincount(own, minlength=total)

    x = np.zeros((total, WIDTH), np.float32)
    code = by_byte(CLASS, buf).astype(np.int64)
    of_byte = np.repeat(np.arange(total), length)
    same = of_byte[1:] == of_byte[:-1]
    pairs = (of_byte[:-1] * CLASSES + code[:-1]) * CLASSES + code[1:]
    grams = np.bincount(pairs[same], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    x[:, : CLASSES * CLASSES] = np.sqrt(grams / np.maximum(1, length - 1)[:, None])

    marks = hash_spans(LOWER[buf], starts, ends)
    some = np.maximum(1, count)
    slot = (marks % U64(HASHED)).astype(np.int64)
    x[:, CLASSES * CLASSES : CLASSES * CLASSES + HASHED] = np.sqrt(np.bincount(own * HASHED + slot, minlength=total * HASHED).reshape(total, -1) / some[:, None])

    share = lambda flag, at: np.bincount(at, weights=flag, minlength=total) / some
    three = mix(marks[:-2] * U64(3) ^ mix(marks[1:-1] * U64(5) ^ mix(marks[2:]))) if len(marks) > 2 else np.zeros(0, np.uint64)
    whole = doc[:-2] == doc[2:] if len(marks) > 2 else np.zeros(0, bool)
    letters = np.bincount(of_byte, weights=(code == 1) | (code == 2) | (code == 4), minlength=total)
    measures = [
        share(repeats(doc, marks), own),
        share(repeats(own, marks), own),
        share(repeats(doc[:-2][whole], three[whole]), own[:-2][whole]) if len(three) else np.zeros(total),
        np.bincount(own, weights=ends - starts, minlength=total) / some / 10,
        np.bincount(of_byte, weights=code == 2, minlength=total) / np.maximum(1, letters),
        np.log1p(count) / 4,
        np.repeat(np.log1p(n_words), n_passages) / 8,
    ]
    x[:, -MEASURES:] = np.stack(measures, axis=1)
    return x, first


class Model:
    """The network's weights, each an array of `shapes`."""

    @staticmethod
    def fresh(width: int, codes: int = 24, gates: int = 12, seed: int = 5) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        new = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return {"E": new(width, codes), "e": np.zeros(codes), "V": new(codes, gates), "U": new(codes, gates), "w": new(gates), "c": new(codes), "c0": np.zeros(1)}

    @staticmethod
    def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """All layers; passages first[d] to first[d + 1] are document d's, at least one each."""
        h = np.tanh(x @ m["E"] + m["e"])
        lean, gate = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
        s = (lean * gate) @ m["w"]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(s - np.maximum.reduceat(s, first[:-1])[doc])
        a = e / np.add.reduceat(e, first[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["c0"], -500, 500)))
        return {"h": h, "lean": lean, "gate": gate, "a": a, "z": z, "p": p, "doc": doc}

    @staticmethod
    def gradient(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy of the documents and its gradient."""
        f = Model.forward(m, x, first)
        h, lean, gate, a, doc = f["h"], f["lean"], f["gate"], f["a"], f["doc"]
        p = np.clip(f["p"], 1e-12, 1 - 1e-12)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        d_logit = (f["p"] - y) / len(y)
        dz = (d_logit[:, None] * m["c"])[doc]
        g = (dz * h).sum(1)
        ds = a * (g - np.add.reduceat(a * g, first[:-1])[doc])
        d_gate = ds[:, None] * m["w"]
        d_lean, d_open = d_gate * gate * (1 - lean * lean), d_gate * lean * gate * (1 - gate)
        d_pre = (a[:, None] * dz + d_lean @ m["V"].T + d_open @ m["U"].T) * (1 - h * h)
        return loss, {
            "E": x.T @ d_pre,
            "e": d_pre.sum(0),
            "V": h.T @ d_lean,
            "U": h.T @ d_open,
            "w": (lean * gate).T @ ds,
            "c": f["z"].T @ d_logit,
            "c0": np.array([d_logit.sum()]),
        }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of documents in a seeded order; inputs are brought to mean 0 and deviation 1, which the first layer takes in."""
    mean, deviation = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / deviation).astype(np.float32)
    m = Model.fresh(x.shape[1], seed=seed)
    m["c0"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    rise, square, t, rng = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0, np.random.default_rng(seed)
    for epoch in range(epochs):
        order, step = rng.permutation(len(y)), rate * (1 - epoch / epochs)
        for lo in range(0, len(y), batch):
            docs = np.sort(order[lo : lo + batch])
            size = first[docs + 1] - first[docs]
            part = np.append(0, np.cumsum(size))
            rows = np.arange(part[-1]) - np.repeat(part[:-1] - first[docs], size)
            _, grad = Model.gradient(m, x[rows], part, y[docs])
            t += 1
            for k, g in grad.items():
                g = g + decay * m[k] if k not in ("e", "c0") else g
                rise[k] = 0.9 * rise[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                m[k] -= step * (rise[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    m["e"] = m["e"] - (mean / deviation) @ m["E"]
    m["E"] = m["E"] / deviation[:, None]
    return m


def bag_rows(batches):
    """(label, rows, x as bytes) of each labelled document."""
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column(0)):
            x, first = passages(buf, off)
            data = [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(data, pa.binary())], names=["label", "x"])


def train_rows(batches):
    """One row: the weights fitted on all bags (at most SAMPLE documents of at most PASSAGES passages)."""
    labels, bags = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        bags += [np.frombuffer(b.as_py(), np.float32).reshape(-1, WIDTH) for b in batch.column(1)]
    if bags:
        weights = fit(np.concatenate(bags), np.append(0, np.cumsum([len(b) for b in bags])), np.array(labels, float))
        np.savez(file := io.BytesIO(), **weights)
        yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()])], names=["weights"])


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_rows(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                p = Model.forward(m, *passages(buf, off))["p"] if isinstance(m, dict) else np.full(hi - lo, m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)], names=SCORE.names)

    return run


class QualityModel:
    """A fitted scorer; its weights (some 30 KB) are broadcast."""

    def __init__(self, weights):
        self.weights = weights

    @classmethod
    def train(cls, documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
        """From the labelled documents outside the held-out fold.  Without labels of both kinds every text scores the base rate (0.5 without any)."""
        spark = documents.sparkSession
        modest_batches(spark)
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        marked = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
        few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        # repeated documents of one doc_id are one bag
        own = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
        bags = stash(own.select("text", "label").mapInArrow(bag_rows, "label int, x binary"), "bags")
        total = {r["label"]: r["n"] for r in bags.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        if not (total.get(0) and total.get(1)):
            return cls(spark.sparkContext.broadcast((total.get(1, 0) + 0.5) / (sum(total.values()) + 1)))
        # one small table in one task, whose linear algebra has one thread; sorted, so that the order of files doesn't matter
        data = bags.repartition(1).sortWithinPartitions("label", "x").mapInArrow(train_rows, "weights binary").first()["weights"]
        with np.load(io.BytesIO(bytes(data))) as f:
            return cls(spark.sparkContext.broadcast({k: f[k] for k in f.files}))

    def score(self, documents: DataFrame) -> DataFrame:
        """doc_id and score (0 to 1) of every document; a null text is an empty one."""
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(score_rows(self.weights), SCORE)


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, limit: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id modulo 5 is 0), score, predicted (1 from `limit` on).

    Labels of held-out rows are never learnt from; nothing but the text enters a score.
    Null and empty texts score as one empty passage.  Repeated rows give repeated rows; of
    contradicting labels of a doc_id the higher counts, null labels don't; a null doc_id is
    scored and has no label.  Other columns are ignored.  An empty table gives an empty result.
    """
    scored = QualityModel.train(documents, labels, sample).score(documents)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
