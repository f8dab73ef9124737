"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The symbols are whole words (as 64-bit hashes).  Patterns are all windows of
`window` consecutive words of the benchmark items; an item with fewer words is
one pattern of its own length.  For patterns of m words and blocks of two
words, a block that occurs in no pattern allows the maximal shift of m - 1
positions, so one probe of the shift table every m - 1 words rules out all
windows that contain the probed block.  At the positions that remain, the hash
of the last block (with that of the first) selects a bucket of patterns, the hashes
of all words narrow it down, and direct comparison of the text confirms the occurrence.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches, stash
from .wordkit import ALNUM, LOWER, U64, chunks, mix, owners, words

#: Benchmark text up to this many bytes is searched for in one pass, whose pattern table is then at most about 40 times as large; a larger benchmark is split into blocks of items, one pass each.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 20

FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def block_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(h[at] * U64(0xD6E8FEB86659FD93) + h[at + 1])


def plain(raw: bytes, starts: np.ndarray, ends: np.ndarray, at: int, m: int) -> bytes:
    """m words from number `at` on, joined by single spaces."""
    return b" ".join([raw[a:b] for a, b in zip(starts[at : at + m].tolist(), ends[at : at + m].tolist(), strict=True)])


def compile_patterns(items: list[tuple[str, str]], window: int) -> dict[int, dict]:
    """By pattern length: the distinct patterns, their owners, shift table and buckets."""
    texts = pa.array([t for _, t in items], pa.large_string())
    found: dict[int, dict[tuple[bytes, bytes], set[str]]] = defaultdict(lambda: defaultdict(set))
    for lo, hi, buf, off in chunks(texts):
        low = LOWER[buf]
        starts, ends, h, r = words(low, off, ALNUM)
        raw = low.tobytes()
        for i in range(hi - lo):
            m = min(window, int(r[i + 1] - r[i]))
            for s in range(r[i], r[i + 1] - m + 1 if m else r[i]):
                found[m][h[s : s + m].tobytes(), plain(raw, starts, ends, s, m)].add(items[lo + i][0])
    out = {}
    for m, by in found.items():
        seqs = np.frombuffer(b"".join(k for k, _ in by), np.uint64).reshape(len(by), m)
        names = [sorted(x) for x in by.values()]
        table = {"seqs": seqs, "names": names, "texts": [t for _, t in by]}
        if m >= 2:
            shift = np.full(1 << TABLE_BITS, m - 1, np.uint8 if m < 256 else np.int32)
            for j in range(m - 1):
                slot = block_hash(seqs.T[j : j + 2].reshape(2, -1).T.ravel(), np.arange(0, 2 * len(seqs), 2)) >> U64(64 - TABLE_BITS)
                np.minimum.at(shift, slot.astype(np.int64), m - 2 - j)
            flat = seqs.ravel()
            first = np.arange(len(seqs)) * m
            key = block_hash(flat, first + m - 2) ^ mix(block_hash(flat, first))
        else:
            shift, key = None, mix(seqs[:, 0])
        order = np.argsort(key, kind="stable")
        table |= {"shift": shift, "key": key[order], "order": order}
        out[m] = table
    return out


def search(low: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray, h: np.ndarray, r: np.ndarray, m: int, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts of occurrences and the pattern numbers found there."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(h) < m:
        return none
    if m >= 2:
        probe = np.arange(0, len(h) - 1, m - 1)
        shift = table["shift"][(block_hash(h, probe) >> U64(64 - TABLE_BITS)).astype(np.int64)]
        live, shift = probe[shift < m - 1], shift[shift < m - 1].astype(np.int64)
        # a block that is at least `shift` words before every pattern's end can't be later in a window
        back = np.arange(m - 1)[None, :]
        starts = (live[:, None] - back)[back <= m - 2 - shift[:, None]]
        starts = starts[(starts >= 0) & (starts <= len(h) - m)]
        if not len(starts):
            return none
        last = block_hash(h, starts + m - 2)
        keep = table["shift"][(last >> U64(64 - TABLE_BITS)).astype(np.int64)] == 0
        starts, last = starts[keep], last[keep]
        key = last ^ mix(block_hash(h, starts))
    else:
        starts, key = np.arange(len(h)), mix(h)
    a, b = np.searchsorted(table["key"], key, "left"), np.searchsorted(table["key"], key, "right")
    n = b - a
    starts, a, n = starts[n > 0], a[n > 0], n[n > 0]
    if not len(starts):
        return none
    at = np.repeat(starts, n)
    which = table["order"][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
    doc = np.searchsorted(r, at, side="right") - 1
    same = at + m <= r[doc + 1]
    for j in range(m):
        same[same] = h[at[same] + j] == table["seqs"][which[same], j]
    at, which = at[same], which[same]
    if len(at):
        raw = low.tobytes()
        equal = np.array([plain(raw, word_starts, word_ends, a, m) == table["texts"][p] for a, p in zip(at.tolist(), which.tolist(), strict=True)])
        at, which = at[equal], which[equal]
    return at, which


def searcher(tables):
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, buf, off in chunks(column):
                low = LOWER[buf]
                starts, ends, h, r = words(low, off, ALNUM)
                edge = np.zeros(len(h) + 1, np.int64)
                names: dict[int, set[str]] = defaultdict(set)
                for m, table in tables.value.items():
                    at, which = search(low, starts, ends, h, r, m, table)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + m, -1)
                    for d, p in zip((np.searchsorted(r, at, side="right") - 1).tolist(), which.tolist(), strict=True):
                        names[d].update(table["names"][p])
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = owners(r)[hit]
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                hits = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(hit - r[doc], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(r), pa.int64()), hits, pa.array([sorted(names.get(i, ())) for i in range(hi - lo)], pa.list_(pa.string()))],
                    names=FOUND.names,
                )

    return run


def items_in_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """The items (item_id, text) and the number of blocks that they are searched for in."""
    modest_batches(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0)).alias("b")).first()["b"]
    return items, 1 + total // block_bytes


def block_tables(items: DataFrame, blocks: int, k: int, window: int):
    """The broadcast pattern tables of block k: of at most about block_bytes of text (an uneven hash or
    one long item apart), and the only ones that are alive where there are several blocks."""
    own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
    return items.sparkSession.sparkContext.broadcast(compile_patterns([(x.item_id, x.text) for x in own.toLocalIterator()], window))


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, hits (indexes of the words inside any
    occurrence of a window) and items (ids, as strings, with an occurring window).

    Null and empty texts have no words and no hits; a null or empty item has no
    windows; an empty benchmark leaves all documents clean.  A null item_id is
    listed as "null".  Repeated documents give repeated rows, repeated items the
    same id once.  Columns other than doc_id, text, item_id are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, blocks = items_in_blocks(benchmark, block_bytes)
    if blocks == 1:
        return docs.mapInArrow(searcher(block_tables(items, 1, 0, window)), FOUND)
    # several passes meet by a row number, as a doc_id may be that of several rows; written, so that it is the same in each pass
    numbered = stash(docs.withColumn("row", F.monotonically_increasing_id()), "numbered-documents")
    kind = T.StructType([T.StructField("doc_id", T.LongType()), *FOUND.fields[1:]])
    ids = numbered.select("row", F.col("doc_id").alias("own"))
    found = []
    for k in range(blocks):  # each pass is written, so that its tables can go; all but the first keep hits only
        tables = block_tables(items, blocks, k, window)
        own = numbered.select("row", "text").mapInArrow(searcher(tables), kind)
        found.append(stash(own if k == 0 else own.where("size(hits) > 0"), "found"))
        tables.destroy()
    every = functools.reduce(DataFrame.unionByName, found).withColumnRenamed("doc_id", "row")
    merged = every.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.join(ids, "row").select(F.col("own").alias("doc_id"), *FOUND.names[1:])


def keeper(tables, column: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, buf, off in chunks(batch.column(column)):
                low = LOWER[buf]
                starts, ends, h, r = words(low, off, ALNUM)
                for m, table in tables.value.items():
                    at, _ = search(low, starts, ends, h, r, m, table)
                    keep[lo + np.searchsorted(r, at, side="right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window occurs, with all their columns; no shuffle.  A benchmark of
    several blocks is searched for block by block, in what the blocks before left.

    Null and empty texts stay, as do all documents for an empty benchmark; rows that
    repeat are judged one by one; no column but text is looked at, whatever its name.
    """
    items, blocks = items_in_blocks(benchmark, block_bytes)
    out, text = documents, documents.columns.index("text")
    for k in range(blocks):
        tables = block_tables(items, blocks, k, window)
        out = out.mapInArrow(keeper(tables, text), documents.schema)
        if blocks > 1:
            out = stash(out, "clean")
            tables.destroy()
    return out
