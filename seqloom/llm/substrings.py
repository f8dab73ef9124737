"""Substring deduplication by recompression.

Recompression replaces a text by ever shorter strings of symbols: in each round
every symbol falls into a left or a right half of the alphabet (a bit of its
name), and each left symbol merges with a right symbol that follows it.  A new
symbol's name is a hash of its parts, so that names are global without any
dictionary: equal substrings get equal interior symbols in whatever task they
are parsed, up to a few symbols at the edges.  Runs need no rule of their own,
since a symbol is never in both halves and so never merges with itself.

Windows of `width` words are to be matched.  After two rounds a symbol spans at
most four words, and its bounds depend on at most three words beyond it; hence
each window of 13 words or more has symbols in its interior that any equal
window has too.  One of them (least by hash) is the window's anchor, keyed by the
symbol with its three words of context on either side.

1. reveal: anchors (key, doc_id) are sorted by key; keys with one text only are
   unique, and so are the windows anchored there;
2. verify: windows at shared anchors are sorted by their own hash, and those
   that have an occurrence in a smaller document are reported to their document;
3. cut: each document drops the words such windows cover.

Both sorts stream through Python with one carried row, whatever the size of a
group, and of a group's rows in one chunk of texts at most two go to it; what the
others are is settled in the chunk.  Texts equal as a whole (their last symbol, so to speak) are settled by
the smallest doc_id alone and take no part in the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches, release, stash
from .wordkit import NOT_SPACE, U64, as_int64, chunks, mix, owners, powers, spans, words

WIDTH = 13
CONTEXT = 3
LONGEST = 4
C1, C2 = U64(0x8CB92BA72F3D8DD7), U64(0xABC98388FB8FAC03)


def merge(names: np.ndarray, starts: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: names, starts and documents of the symbols after pairs have merged."""
    if not len(names):
        return names, starts, doc
    left = (mix(names + U64(salt)) & U64(1)).astype(bool)
    second = np.zeros(len(names), bool)
    second[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~second)
    out = names[at]
    pair = np.zeros(len(at), bool)
    nxt = at + 1
    pair[nxt < len(names)] = second[nxt[nxt < len(names)]]
    out[pair] = mix(out[pair] * C1 + names[nxt[pair]] * C2 + U64(salt))
    return out, starts[at], doc[at]


def symbols(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts and ends (in words) of the symbols after two rounds."""
    names, starts, doc = h, np.arange(len(h)), owners(r)
    for salt in (1, 2):
        names, starts, doc = merge(names, starts, doc, salt)
    ends = np.append(starts[1:], len(h))
    return names, starts, ends


def anchor_windows(h: np.ndarray, r: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the number of each window's anchor in a list of
    the anchors that are used, and these anchors' keys and first words."""
    none = np.zeros(0, np.int64)
    n = len(h)
    if n < width:
        return none, none, none.astype(np.uint64), none
    doc = owners(r)
    window = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(window):
        return none, none, none.astype(np.uint64), none
    names, starts, ends = symbols(h, r)
    rank = mix(names ^ C2)
    # the first symbol that starts at or after each word
    first_at = np.searchsorted(starts, window + CONTEXT)
    best = first_at.copy()
    lowest = np.full(len(window), np.iinfo(np.uint64).max, np.uint64)
    limit = window + width - CONTEXT
    for j in range(width - 2 * CONTEXT):
        k = first_at + j
        k[k >= len(starts)] = len(starts) - 1
        fits = (ends[k] <= limit) & (starts[k] >= window + CONTEXT)
        if not fits.any():
            break
        better = fits & (rank[k] < lowest)
        lowest[better] = rank[k[better]]
        best[better] = k[better]
    used, which = np.unique(best, return_inverse=True)
    a, length = starts[used] - CONTEXT, ends[used] - starts[used] + 2 * CONTEXT
    p = powers(LONGEST + 2 * CONTEXT, C1)
    key = length.astype(np.uint64)
    for j in range(LONGEST + 2 * CONTEXT):
        more = j < length
        key[more] += h[a[more] + j] * p[j]
    return window, which, mix(key), a


def window_hashes(h: np.ndarray, window: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows that start at the given words."""
    one, two = np.zeros(len(window), np.uint64), np.zeros(len(window), np.uint64)
    p, q = powers(width), powers(width, C2)
    for j in range(width):
        x = h[window + j]
        one += x * p[j]
        two += mix(x ^ C1) * q[j]
    return mix(one), mix(two)


ANCHOR = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("twin", T.LongType()), T.StructField("sure", T.BooleanType())])
SHARED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType())])
WINDOW = T.StructType([T.StructField("hash", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("tail", T.LongType()), T.StructField("sure", T.BooleanType())])
COVERED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("at", T.IntegerType())])


def anchor_rows(width: int):
    def run(batches):
        for batch in batches:
            ids, twins = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in chunks(batch.column(1)):
                _, _, h, r = words(buf, off)
                _, _, key, at = anchor_windows(h, r, width)
                doc = np.searchsorted(r, at, side="right") - 1
                doc, twin = ids[lo:hi][doc], twins[lo:hi][doc]
                # a key of several texts in this chunk is shared: one row of each of two texts tells the
                # others so, and the rest need not meet them
                order = np.lexsort((twin, key))
                start = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
                change = np.append(False, twin[order][1:] != twin[order][:-1])[: len(order)] & ~start
                group = np.cumsum(start) - 1
                nth = np.cumsum(change) - np.append(0, np.cumsum(change))[np.flatnonzero(start)][group] if len(order) else group
                several = np.bincount(group, weights=change) > 0
                sure = np.empty(len(order), bool)
                sure[order] = several[group] & ~start & ~(change & (nth == 1))
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(key)), pa.array(doc), pa.array(twin), pa.array(sure)], names=ANCHOR.names)

    return run


def shared_rows(batches):
    """From anchors sorted by (key, twin): those of keys that occur in different texts.

    Rows of the last group stay back until a row of another text, or of another
    key, decides about them; as documents of one text are all but one copies,
    only the first of them is held.  Rows known to be shared come first.
    """
    held, decided = None, False  # first row of the open group; whether it is known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, twin, sure = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        if sure.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[sure]), pa.array(key[sure])], names=SHARED.names)
            key, doc, twin = key[~sure], doc[~sure], twin[~sure]
            if not len(key):
                continue
        fresh = 0
        if held is not None:
            key, doc, twin = (np.concatenate([[x], y]) for x, y in zip(held, (key, doc, twin), strict=True))
            fresh = 1
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        group = np.cumsum(start) - 1
        change = np.zeros(len(key), bool)
        change[1:] = (twin[1:] != twin[:-1]) & ~start[1:]
        shared = np.bincount(group, weights=change) > 0
        if fresh and decided:
            shared[0] = True
        send = shared[group]
        last = int(np.flatnonzero(start)[-1])
        was, decided = decided, bool(shared[-1])
        if fresh and was:
            send[0] = False  # it went out with an earlier batch
        yield pa.RecordBatch.from_arrays([pa.array(doc[send]), pa.array(key[send])], names=SHARED.names)
        # of an undecided group the rows seen so far are one text: the smallest document stands for them
        at = last + int(np.argmin(doc[last:])) if not decided else last
        held = (key[at], doc[at], twin[-1])


def window_rows(width: int):
    """Hash, document and packed (second hash, first word) of the windows at shared anchors."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            for lo, hi, buf, off in chunks(batch.column(1)):
                _, _, h, r = words(buf, off)
                window, which, key, at = anchor_windows(h, r, width)
                doc = np.searchsorted(r, at, side="right") - 1
                own = lists.slice(lo, hi - lo)
                shared = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(hi - lo), np.nan_to_num(np.array(own.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64))
                live = np.isin(mix(key + doc.astype(np.uint64) * C2), mix(shared + of.astype(np.uint64) * C2))
                window = window[live[which]]
                one, two = window_hashes(h, window, width)
                doc = np.searchsorted(r, window, side="right") - 1
                tail = (two >> U64(32) << U64(32)) | (window - r[doc]).astype(np.uint64)
                # an equal window of a smaller document in this chunk settles a window: only the
                # smallest document's first one meets those of other chunks
                own, check = ids[lo:hi][doc], two >> U64(32)
                order = np.lexsort((own, check, one))
                start = np.append(True, (one[order][1:] != one[order][:-1]) | (check[order][1:] != check[order][:-1]))[: len(order)]
                least = own[order][np.flatnonzero(start)][np.cumsum(start) - 1] if len(order) else own
                sure = np.empty(len(order), bool)
                sure[order] = own[order] > least
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(one)), pa.array(own), pa.array(as_int64(tail)), pa.array(sure)], names=WINDOW.names)

    return run


def later_rows(batches):
    """From windows sorted by (hash, doc_id): those with an equal one in a smaller document; rows known to be such come first."""
    open_key, open_doc = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, doc, tail, sure = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        if sure.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[sure]), pa.array((tail[sure] & 0xFFFFFFFF).astype(np.int32))], names=COVERED.names)
            key, check, doc, tail = (x[~sure] for x in (key, check, doc, tail))
            if not len(key):
                continue
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        if open_key is not None and (key[0], check[0]) == open_key:
            start[0] = False
        group = np.cumsum(start)
        least = np.concatenate([[open_doc], doc[start]])
        later = doc > least[group]
        open_key, open_doc = (key[-1], check[-1]), int(least[group[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array((tail[later] & 0xFFFFFFFF).astype(np.int32))], names=COVERED.names)


def cutter(text: int, extra: int, width: int):
    """Cuts the covered words; the columns from `extra` on are is_copy and the windows' first words."""

    def run(batches):
        for batch in batches:
            copies, lists = batch.column(extra).to_numpy(zero_copy_only=False), batch.column(extra + 1)
            for lo, hi, buf, off in chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                starts, ends = spans(NOT_SPACE[buf], off)
                r = np.searchsorted(starts, off)
                own = lists.slice(lo, hi - lo)
                at = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(hi - lo), np.nan_to_num(np.array(own.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64))
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, r[of] + at, 1)
                np.add.at(edge, r[of] + at + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_words = np.diff(r)
                whole = np.repeat(copies[lo:hi].astype(bool) & (n_words >= width), n_words)
                gone |= whole
                total = np.zeros(len(gone) + 1, np.int64)
                np.cumsum(gone, out=total[1:])
                # the kept words with one space after each, then without each text's last space
                kept = np.flatnonzero(~gone)
                lens = ends[kept] - starts[kept]
                put = np.cumsum(lens + 1) - (lens + 1)
                out = np.full(int((lens + 1).sum()), 0x20, np.uint8)
                within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                out[within + np.repeat(put, lens)] = buf[within + np.repeat(starts[kept], lens)]
                bound = np.searchsorted(kept, r)
                put = np.append(put, len(out))
                raw = out.tobytes()
                a, b = put[bound[:-1]].tolist(), put[bound[1:]].tolist()
                texts = pa.array([raw[x : max(x, y - 1)].decode() for x, y in zip(a, b, strict=True)], pa.string())
                columns = [texts if c == text else part.column(c) for c in range(extra)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(np.diff(total[r]))], names=[*part.schema.names[:extra], "__n_words", "__n_removed"])

    return run


def dedup_substrings(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents with every word cut that is covered by a window of `width` words
    which also starts in a document with a smaller doc_id; the kept words are
    joined by single spaces.  __n_words and __n_removed are appended, in place of columns of these names.

    Windows are judged on the input.  A null or empty text has no words and
    becomes empty.  Windows of one document don't count against each other;
    rows that repeat a doc_id are one document in that respect.  Rows with a null
    doc_id take no part and keep their words.  An empty table gives an empty
    result.  width must be at least 13 (the guarantee above).
    """
    if width < 2 * CONTEXT + 2 * LONGEST - 1:
        raise ValueError(f"width {width}: a window must have a symbol in its interior")
    spark = documents.sparkSession
    plain = documents.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).drop("__n_words", "__n_removed")
    modest_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = base.where("doc_id is not null")

    # texts that are equal as a whole: all but the smallest doc_id are copies
    ids = known.select("doc_id", F.xxhash64("text").alias("twin"), F.md5("text").alias("group"))
    least = ids.groupBy("twin", "group").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = stash(ids.join(least, ["twin", "group"]).where("doc_id > least").select(F.col("doc_id").alias("__seqloom__copy")).distinct(), "text-copies")

    anchors = known.select("doc_id", "text", F.xxhash64("text").alias("twin")).mapInArrow(anchor_rows(width), ANCHOR)
    apart = lambda key: F.when(F.col("sure"), F.xxhash64("doc_id", key)).otherwise(F.col(key))
    shared = anchors.repartition(n, apart("key")).sortWithinPartitions(F.desc("sure"), "key", "twin").mapInArrow(shared_rows, SHARED)
    names = stash(shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "shared-anchors")
    release(spark)

    candidates = known.join(names, "doc_id").join(copies, F.col("doc_id") == F.col("__seqloom__copy"), "left_anti").select("doc_id", "text", "keys")
    found = candidates.mapInArrow(window_rows(width), WINDOW).withColumn("check", F.expr("shiftrightunsigned(tail, 32)")).select("hash", "check", "doc_id", "tail", "sure")
    later = found.repartition(n, apart("hash")).sortWithinPartitions(F.desc("sure"), "hash", "check", "doc_id").mapInArrow(later_rows, COVERED)
    covered = stash(later.groupBy("doc_id").agg(F.collect_list("at").alias("__seqloom__at")).withColumnRenamed("doc_id", "__seqloom__doc"), "covered-windows")
    release(spark)

    joined = (
        plain.join(covered, plain["doc_id"].cast("long") == F.col("__seqloom__doc"), "left")
        .join(copies, plain["doc_id"].cast("long") == F.col("__seqloom__copy"), "left")
        .select(*[plain[c] for c in plain.columns], F.col("__seqloom__copy").isNotNull().alias("__seqloom__is_copy"), "__seqloom__at")
    )
    kind = T.StructType([*plain.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())])
    return joined.mapInArrow(cutter(plain.columns.index("text"), len(plain.columns), width), kind)
