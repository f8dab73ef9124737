"""Document fingerprints of closed syncmers.

A k-mer (k consecutive UTF-8 bytes) is a closed syncmer if the least of its
s-byte substrings, by hash, is its first or its last one.  The k-mer alone
decides, so equal passages have the same anchors whatever surrounds them, and
k - s + 1 consecutive k-mers hold at least one.

A fingerprint keeps the `size` anchors of least hash, an unbiased sample of the
text's set of anchors, each with its position in the text.  Two fingerprints are
alike by the share of common anchors among the least `size` of their union, and
among common ones those count whose distance from the previous common anchor
agrees within `slack` bytes (positional matching), so chance matches out of
order don't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches
from .wordkit import BYTE_CODE, U64, mix, powers

K, S, SIZE, SLACK = 16, 6, 64, 8
SHORT = (6, 2)
#: Range buckets of document ids; each is sorted in one task.
ROWS_PER_BUCKET = 1024
#: Ranges per shuffle partition, at most: what the driver holds grows with the partitions, not with the rows.
RANGES_A_PARTITION = 8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    n = len(buf) - width + 1
    code, p = BYTE_CODE[buf], powers(width)
    # Horner by doubling: hash of 2w bytes from two hashes of w bytes
    total, have = np.zeros(n, np.uint64), 0
    part, size = code, 1
    left = width
    while left:
        if left & size:
            total = total + part[have : have + n] * p[have]
            have += size
            left -= size
        if left:
            part = part[: len(part) - size] + part[size:] * p[size]
            size *= 2
    return mix(total)


def syncmers(buf: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of one or more texts laid end to end."""
    if len(buf) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = window_hashes(buf, s)
    n, last = len(buf) - k + 1, k - s
    least = sliding_min(inner, last + 1)
    at = np.flatnonzero((inner[:n] == least) | (inner[last : last + n] == least))
    return at, window_hashes(buf, k)[at]


def sketch(data: bytes, k: int = K, s: int = S, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits, distinct, ascending) and first positions of the kept anchors.  A
    text of fewer than 8 k bytes has anchors of the SHORT kind too, one of fewer than
    4 k only those; one without any k-mer is one anchor itself; an empty one has none."""
    buf = np.frombuffer(data, np.uint8)
    at, h = syncmers(buf, k, s) if len(data) >= 4 * k else syncmers(buf, *SHORT)
    if 4 * k <= len(data) < 8 * k:
        more, short = syncmers(buf, *SHORT)
        at, h = np.concatenate([at, more]), np.concatenate([h, short])
    if not len(h):
        if not data:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.frombuffer(hashlib.sha256(data).digest()[:4], "<u4"), np.zeros(1, np.int64)
    short = (h >> U64(32)).astype(np.uint32)
    if len(short) > 4 * size:  # only the least values can be kept; repeats are why more than `size` are looked at
        bound = np.uint32(min(0xFFFFFFFF, int((1 << 32) * 3 * size / len(short))))
        few = np.flatnonzero(short <= bound)
        u, first = np.unique(short[few], return_index=True)
        if len(u) >= size:
            return u[:size], at[few[first[:size]]]
    u, first = np.unique(short, return_index=True)
    return u[:size], at[first[:size]]


def render(marks: np.ndarray, at: np.ndarray) -> str:
    """hash:position pairs in hexadecimal, by hash."""
    return ",".join(f"{m:08x}:{p:x}" for m, p in zip(marks.tolist(), at.tolist(), strict=True))


def parse(text: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split(":") for x in text.split(",")] if text else []
    return np.array([int(m, 16) for m, _ in pairs], np.uint32), np.array([int(p, 16) for _, p in pairs], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SIZE, slack: int = SLACK) -> float:
    """0 to 1; equal fingerprints 1, and so are two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = common <= union[-1]
    p, q = a[1][i][inside], b[1][j][inside]
    if not len(p):
        return 0.0
    order = np.argsort(p, kind="stable")
    drift = (q - p)[order]
    near = np.abs(np.diff(drift)) <= slack
    placed = np.ones(len(drift), bool)
    if len(drift) > 1:
        placed = np.append(near, False) | np.append(False, near)
    return float(placed.sum()) / len(union)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edit(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_rows(batches):
    """Each document with the next row of its bucket; rows come by bucket and rank, and
    the last row of a bucket is a look-ahead that only serves the one before it."""
    held = None
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        columns = [batch.column(c).to_pylist() for c in range(4)]
        for bucket, ahead, doc, text in zip(*columns, strict=True):
            own = sketch(text.encode())
            if held is not None and held[0] == bucket:
                _, before, was, mark = held
                new = edit(was, text)
                changed = sketch(new.encode())
                for column, value in zip(out, (before, len(was), hashlib.sha256(new.encode()).hexdigest(), render(*mark), render(*changed), likeness(mark, changed), likeness(mark, own)), strict=True):
                    column.append(value)
            held = None if ahead else (bucket, doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=RESULT.names)


def fingerprints_with_edits(documents: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_chars, edited (SHA-256 of the edited text),
    fingerprint, edited_fingerprint, near_edited, near_next; the edited text has its
    last quarter replaced by the beginning of the next document.

    The next document is the one with the next doc_id (rows that repeat a doc_id
    follow each other by text), after the last the first; a single document follows
    itself.  A null text is empty.  Rows with a null doc_id are left out.  An empty
    table gives an empty result.

    Documents are dealt to ranges of doc_id; each range also gets the first row of
    the next one.  The range bounds are quantiles, one per rows_per_bucket rows but at most
    RANGES_A_PARTITION per shuffle partition; only these, and one row number per range, come
    to the driver.  A range is streamed, not held, so it may have any number of rows.
    """
    spark = documents.sparkSession
    modest_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    total = docs.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(-(-total // rows_per_bucket), RANGES_A_PARTITION * parts)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], min(0.1, 0.25 / n)))) if n > 1 else []
    bounds = spark.sparkContext.broadcast(np.array([int(c) for c in cuts], np.int64))

    def bucket_rows(batches):
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(bounds.value, ids.to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), ids], names=["bucket", "doc_id"])

    firsts = docs.select("doc_id").mapInArrow(bucket_rows, "bucket long, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    ahead = [(firsts[i - 1]["bucket"], firsts[i]["doc_id"]) for i in range(len(firsts))]  # the first range's first follows the last range
    wanted = spark.createDataFrame(ahead, "bucket long, doc_id long")
    # one row per range: few, and as many as the rows of one doc_id at most
    least = docs.join(F.broadcast(wanted), "doc_id").groupBy("bucket", "doc_id").agg(F.min("text").alias("text")).select("bucket", F.lit(True).alias("ahead"), "doc_id", "text")

    def dealt_rows(batches):
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(bounds.value, ids.to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.zeros(len(ids), bool)), ids, batch.column(1)], names=["bucket", "ahead", "doc_id", "text"])

    dealt = docs.mapInArrow(dealt_rows, "bucket long, ahead boolean, doc_id long, text string").unionByName(least)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text").mapInArrow(compare_rows, RESULT)
