"""Toxicity: noisy-channel deobfuscation, then a linear model on the restored words.

A word that looks disguised (digits or signs among letters or at an edge, letters repeated
three times, single letters set apart) is read as the output of a noisy channel.  Each of
its characters may stand for several letters, a repeated letter or a separator for
none; Viterbi decoding finds the most probable letters under a trigram language
model of characters.  The restored word then counts like any other.

The language model interpolates trigram counts of all documents with those of the
words that weigh towards toxicity, so that a disguise of such a word is read as
that word.  The linear model (logistic regression) is fitted on at most
`sample` labelled documents outside the held-out fold; its features are words and
word beginnings whose document counts differ between the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches, stash
from .wordkit import LOWER, NOT_SPACE, U64, as_int64, chunks, hash_spans, spans

#: Labelled documents that the classifier is fitted on, at most; the least by hash of doc_id.
SAMPLE = 16_384
#: A feature must be in MIN_DOCS sampled documents and differ by MIN_Z standard errors.
MIN_DOCS, MIN_Z = 4, 4.0
PREFIXES = (4, 5, 6)

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True
SOLID = LETTER.copy()
SOLID[ord("0") : ord("9") + 1] = True
# What a sign or digit may stand for.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
}
SEPARATORS = ".-_*/~:, "
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in STANDS_FOR]] = True
#: Signs that may stand for a letter at a word's begin or end, where the others are punctuation.
LEAD, TRAIL = SIGN.copy(), SIGN.copy()
LEAD[ord("(")] = False
TRAIL[[ord("("), ord("!")]] = False
GAP = np.zeros(256, bool)
GAP[[ord(c) for c in SEPARATORS]] = True

#: Symbols of the character model: 0 a word's edge, 1 to 26 letters, 27 other letters' bytes, 28 the rest.
SYMBOLS = 29
CODE = np.full(256, 28, np.int64)
CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
CODE[0x80:] = 27


def trigram_counts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) in the words, each with an edge before and after it."""
    if not len(starts):
        return np.zeros(SYMBOLS**3, np.int64)
    size = ends - starts
    first = np.cumsum(size + 3) - (size + 3)
    line = np.zeros(int((size + 3).sum()), np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[within + np.repeat(first + 2, size)] = CODE[low[within + np.repeat(starts, size)]]
    valid = np.ones(len(line) - 2, bool)
    valid[(first - 1)[first > 0]] = False
    valid[(first - 2)[first > 1]] = False
    key = (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:]
    return np.bincount(key[valid], minlength=SYMBOLS**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.02
    return table / table.sum(axis=2, keepdims=True)


def channel(word: str) -> list[list[tuple[str, float]]]:
    """For each character what letters it may stand for, with the log weight of that."""
    out, previous = [], ""
    for c in word:
        options: list[tuple[str, float]] = []
        if c in STANDS_FOR:
            options += [(x, -1.5) for x in STANDS_FOR[c]] + [("", -6.0)]
        elif c in SEPARATORS:
            options.append(("", -0.5))
        else:
            options.append((c, -0.1))
        if c == previous:
            options.append(("", -1.0))
        out.append(options)
        previous = c
    return out


def symbol_of(letter: str) -> int:
    return int(CODE[letter.encode()[0]])


def restore(word: str, model: np.ndarray) -> str:
    """The most probable letters behind a word, by Viterbi over (last two letters)."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in channel(word):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letters, cost in options:
                if letters:
                    symbol = symbol_of(letters)
                    key, total = (b, symbol), score + cost + model[a, b, symbol]
                else:
                    key, total = (a, b), score + cost
                if key not in following or total > following[key][0]:
                    following[key] = (total, text + letters)
        states = following
    return max((score + model[a, b, 0], text) for (a, b), (score, text) in states.items())[1]


def bare(word: str) -> str:
    """A word without the punctuation around it, and without runs of three or more of one sign at
    its edges; signs that may stand for letters stay."""
    while True:
        cut = word.lstrip(".,;:?\"'()[]*#%&-_/~").rstrip(".,;:!?\"'()[]*#%&-_/~")
        for edge, at in ((cut[:1], 0), (cut[-1:], -1)):
            run = len(cut) - len(cut.lstrip(edge) if at == 0 else cut.rstrip(edge)) if edge else 0
            if run >= 3 and not edge.isalpha():
                cut = cut[run:] if at == 0 else cut[:-run]
        if cut == word:
            return word
        word = cut


def suspects(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words that look disguised."""
    if not len(starts):
        return np.zeros(0, np.int64)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(low) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[starts]

    letter = LETTER[low]
    before = np.zeros(len(low), bool)
    before[1:] = letter[:-1] | SIGN[low[:-1]]
    before[starts] = True
    after = np.zeros(len(low), bool)
    after[:-1] = letter[1:]
    same = np.zeros(len(low), bool)
    same[2:] = letter[2:] & (low[2:] < 0x80) & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    letters, signs = count(letter), count(SIGN[low] & (low != ord("!")))
    gaps = count(GAP[low])
    inside = count(SIGN[low] & before & after) > 0
    # at the edges, but not as a run of three or more of one sign, which is decoration
    first, last = low[starts], low[ends - 1]
    long = ends - starts >= 3
    third, back = low[np.minimum(starts + 2, ends - 1)], low[np.maximum(ends - 3, starts)]
    lead = long & LEAD[first] & ~((low[np.minimum(starts + 1, ends - 1)] == first) & (third == first))
    trail = long & TRAIL[last] & ~((low[np.maximum(ends - 2, starts)] == last) & (back == last))
    leet = (inside | lead | trail) & (letters >= 2) & (signs <= 2 * letters)
    tripled = count(same) > 0
    apart = (gaps >= 2) & (letters >= 2) & (letters + signs >= 3) & (gaps >= letters + signs - 2)
    return np.flatnonzero(leet | tripled | apart)


def spaced_runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[int, str]]:
    """(document, joined letters) of three or more one-letter words in a row: the whole run, and what is
    left without its first or last one, which may be words of their own."""
    short = np.flatnonzero((ends - starts) == 1)
    out = []
    if len(short) < 3:
        return out
    brk = np.flatnonzero((np.diff(short) != 1) | (np.diff(doc[short]) != 0))
    for a, b in zip(np.append(0, brk + 1).tolist(), np.append(brk + 1, len(short)).tolist(), strict=True):
        if b - a >= 3:
            letters = b"".join(raw[starts[k] : ends[k]] for k in short[a:b].tolist()).decode("ascii", "ignore")
            for part in dict.fromkeys((letters, letters[1:], letters[:-1], letters[1:-1])):
                if len(part) >= 3 and len(set(part)) >= 3 and sum(map(str.isalpha, part)) >= 2:
                    out.append((int(doc[short[a]]), part))
    return out


def trimmed(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, then of those with a letter or digit, without the signs around it, and each one's document."""
    starts, ends = spans(NOT_SPACE[low], off)
    solid = np.flatnonzero(SOLID[low])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    return starts, ends, solid[a[full]], solid[b[full] - 1] + 1, np.searchsorted(off, starts[full], side="right") - 1


def features(buf: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, as often as they occur, of the restored texts."""
    low = LOWER[buf]
    starts, ends, s, e, doc = trimmed(low, off)
    docs, marks = [], []

    def add(text: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
        docs.append(of)
        marks.append(hash_spans(text, a, b))
        for n in PREFIXES:
            long = np.flatnonzero(b - a > n)
            docs.append(of[long])
            marks.append(hash_spans(text, a[long], a[long] + n) ^ U64(n))

    add(low, s, e, doc)
    raw = low.tobytes()
    odd = suspects(low, starts, ends)
    found = [(d, raw[starts[k] : ends[k]].decode("utf-8", "ignore")) for k, d in zip(odd.tolist(), (np.searchsorted(off, starts[odd], side="right") - 1).tolist(), strict=True)]
    found += spaced_runs(raw, starts, ends, np.searchsorted(off, starts, side="right") - 1)
    if found:
        known: dict[str, bytes] = {}
        for _, word in found:
            if word not in known:
                known[word] = restore(bare(word), model).encode()
        rows = [(d, known[word]) for d, word in found if known[word]]
        if rows:
            size = np.array([len(x) for _, x in rows])
            at = np.cumsum(size) - size
            add(np.frombuffer(b"".join(x for _, x in rows), np.uint8), at, at + size, np.array([d for d, _ in rows]))
    return np.concatenate(docs), np.concatenate(marks)


def count_rows(batches):
    """Trigram counts of the task's words."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, _, buf, off in chunks(batch.column(0)):
            low = LOWER[buf]
            _, _, s, e, _ = trimmed(low, off)
            total += trigram_counts(low, s, e)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])


def document_counts(model):
    """(feature, label, number of documents) of the task's documents."""

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in chunks(batch.column(0)):
                doc, mark = features(buf, off, model.value)
                both = np.unique(np.stack([mark, doc.astype(np.uint64)]), axis=1)
                key = np.stack([both[0], label[lo:hi][both[1].astype(np.int64)].astype(np.uint64)])
                u, n = np.unique(key, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(u[0])), pa.array(u[1].astype(np.int32)), pa.array(n)], names=["feature", "label", "n"])

    return run


def chosen_rows(model, chosen):
    """Each document's chosen features, as numbers."""

    def run(batches):
        for batch in batches:
            label = batch.column(1)
            for lo, hi, buf, off in chunks(batch.column(0)):
                doc, which = chosen_features(buf, off, model.value, chosen.value)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([label.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(which, pa.int32()))], names=["label", "features"])

    return run


def chosen_features(buf, off, model, chosen) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, number of a chosen feature), by document."""
    doc, mark = features(buf, off, model)
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, mark), len(chosen) - 1)
    hit = chosen[at] == mark
    both = np.unique(doc[hit] * len(chosen) + at[hit])
    return both // len(chosen), both % len(chosen)


def fit(rows: list, n: int, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam: weights and intercept."""
    y = np.array([r["label"] for r in rows], float)
    size = np.array([len(r["features"]) for r in rows], np.int64)
    col = np.array([f for r in rows for f in r["features"]], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    w, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=w[col], minlength=len(y)) + w[n])))
        gap = p - y
        grad = np.append(np.bincount(col, weights=gap[row], minlength=n), gap.sum()) / len(y)
        grad[:n] += decay * w[:n]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:n], float(w[n])


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def logits(buf, off, n, parts) -> np.ndarray:
    model, chosen, weights, intercept = parts
    doc, which = chosen_features(buf, off, model, chosen)
    z = np.bincount(doc, weights=weights[which], minlength=n) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score_rows(parts):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(logits(buf, off, hi - lo, parts.value))], names=SCORE.names)

    return run


def keep_rows(parts, text: int, limit: float):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, buf, off in chunks(batch.column(text)):
                keep[lo:hi] = logits(buf, off, hi - lo, parts.value) < limit
            yield batch.filter(pa.array(keep))

    return run


def held_out(folds: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % folds == 0


class ToxicityModel:
    """A fitted scorer; its parts are broadcast (a character model, features, weights: under 1 MB)."""

    def __init__(self, parts):
        self.parts = parts

    @classmethod
    def train(cls, documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
        """Without labels of both kinds, or features, every text scores the base rate (0.25 without any label)."""
        spark = documents.sparkSession
        modest_batches(spark)
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        counts = np.zeros(SYMBOLS**3)
        for r in docs.select("text").mapInArrow(count_rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3 rows
            counts[r["gram"]] = r["n"]
        broadcast = spark.sparkContext.broadcast
        plain = broadcast(np.log(log_model(counts)))
        marked = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
        few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        learn = stash(docs.join(F.broadcast(few), "doc_id").select("text", "label"), "labelled")
        total = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = total.get(1, 0), total.get(0, 0)
        chosen, weights, intercept, words = np.zeros(0, np.uint64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 1.5))), counts * 0
        if n1 and n0:
            by = learn.mapInArrow(document_counts(plain), "feature long, label int, n long").groupBy("feature").agg(
                F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("b")
            )
            share = (F.col("a") + F.col("b") + 1) / F.lit(n1 + n0 + 2)
            z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
            top = by.where(F.col("a") + F.col("b") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z).select("feature").collect()  # of at most `sample` documents
            chosen = np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))
            if len(chosen):
                rows = learn.mapInArrow(chosen_rows(plain, broadcast(chosen)), "label int, features array<int>").collect()
                weights, intercept = fit(rows, len(chosen))
                toxic = broadcast(chosen[weights > 1.0])
                words = np.zeros(SYMBOLS**3)
                for r in learn.where("label = 1").select("text").mapInArrow(lexicon_rows(toxic), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
                    words[r["gram"]] = r["n"]
        mixed = 0.5 * log_model(counts) + 0.5 * log_model(words) if words.any() else log_model(counts)
        return cls(broadcast((np.log(mixed), chosen, weights, intercept)))

    def score(self, documents: DataFrame) -> DataFrame:
        """doc_id and score (0 to 1) of every document; a null text is an empty one."""
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(score_rows(self.parts), SCORE)

    def keep(self, documents: DataFrame, limit: float = 0.5) -> DataFrame:
        """The documents that score below limit, with all their columns."""
        return documents.mapInArrow(keep_rows(self.parts, documents.columns.index("text"), limit), documents.schema)


def lexicon_rows(toxic):
    """Trigram counts of the words that are features towards toxicity."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                low = LOWER[buf]
                _, _, s, e, _ = trimmed(low, off)
                hit = np.isin(hash_spans(low, s, e), toxic.value)
                total += trigram_counts(low, s[hit], e[hit])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["gram", "n"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id modulo 5 is 0), score, predicted.

    Labels of held-out rows are never learnt from; nothing but the text enters a
    score.  Null and empty texts score the model's base rate.  Repeated rows give
    repeated rows; of contradicting labels of a doc_id the higher counts; null
    labels don't.  An empty table gives an empty result.
    """
    scored = ToxicityModel.train(documents, labels, sample).score(documents)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
