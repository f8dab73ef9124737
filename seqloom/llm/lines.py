"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

State (`LineIndex`) is three tables in the shared folder:

* postings: one row per (line key, document), the references;
* counts: per key the exact number of its documents and the largest of them; inserting
  documents adds theirs, deleting takes them away;
* filters: one cuckoo filter per shard of the key space, holding the keys that at
  least `min_docs` documents share.  An insertion puts just the keys that reach the
  threshold into their shards' filters, a deletion takes just those that fall below it
  out again, which a cuckoo filter (unlike a Bloom filter) allows.

Cleaning a document asks the filters first: a line whose key is not in its
shard's filter stays without touching the counts; the few that may be there are
confirmed against the exact table, so a false positive of the filter costs one
look-up and never a line.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import modest_batches, stash
from .wordkit import LOWER, NOT_SPACE, U64, as_int64, chunks, code_point_positions, mix

MIN_CHARS = 40
MIN_DOCS = 5
#: Filters together of up to this many bytes are broadcast; beyond it lines go to the filters' shards by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Keys a shard's filter is built for; the number of shards follows from the number of keys.
SHARD_KEYS = 1 << 16
SLOTS = 4
EMPTY = np.uint16(0)


class CuckooFilter:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, with insertion,
    deletion and membership; keys are uint64 hashes.

    A fingerprint that finds no place after `kicks` moves is kept in an exact
    overflow list, so that no key is ever lost.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None, overflow: list[int] | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.84)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16) if table is None else table
        self.overflow = overflow or []

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys ^ U64(0xA5A5A5A55A5A5A5A))
        mark = ((h >> U64(48)).astype(np.uint16)) | np.uint16(1)
        one = (h & U64(self.buckets - 1)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        """Partial-key cuckoo hashing: either bucket follows from the other one."""
        return bucket ^ (mix(np.asarray(mark, np.uint64)) & U64(self.buckets - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray, kicks: int = 500) -> None:
        mark, one, two = self.places(keys)
        for f, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            at = next((x for x in (a, b) if (self.table[x] == EMPTY).any()), None)
            if at is None:
                at, turn = a, 0
                for turn in range(kicks):
                    slot = turn % SLOTS
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at = int(self.other(np.array([at]), np.array([f], np.uint16))[0])
                    if (self.table[at] == EMPTY).any():
                        break
                else:
                    self.overflow.append(min(at, int(self.other(np.array([at]), np.array([f], np.uint16))[0])) << 16 | f)
                    continue
            self.table[at, int(np.argmax(self.table[at] == EMPTY))] = f

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted before."""
        mark, one, two = self.places(keys)
        for f, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            if (code := min(a, b) << 16 | f) in self.overflow:
                self.overflow.remove(code)
                continue
            for x in (a, b):
                hit = np.flatnonzero(self.table[x] == f)
                if len(hit):
                    self.table[x, hit[0]] = EMPTY
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.overflow:
            found |= np.isin(np.minimum(one, two) << 16 | mark.astype(np.int64), np.array(self.overflow))
        return found

    def dump(self) -> tuple[bytes, list[int]]:
        return self.table.tobytes(), [int(x) for x in self.overflow]

    @classmethod
    def load(cls, data: bytes, overflow: list[int]) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        out = cls(1, table, list(overflow))
        out.buckets = len(table)
        return out


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and each text's range of lines (an empty text has one)."""
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    before = np.searchsorted(breaks, off)
    return starts, ends, before + np.arange(len(off))


def line_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the lines whose key has min_chars code points, and the two halves of
    each key's 128-bit cryptographic digest, which stands for the key's text."""
    solid = np.flatnonzero(NOT_SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(b > a)
    s, e = solid[a[full]], solid[b[full] - 1] + 1
    chars = code_point_positions(buf)
    keep = chars[e] - chars[s] >= min_chars
    full, s, e = full[keep], s[keep], e[keep]
    low = LOWER[buf].tobytes()
    digests = b"".join([blake2b(low[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist(), strict=True)])
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return full, both[:, 0].copy(), both[:, 1].copy()


def pairs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """128-bit values from their halves, to be compared as one."""
    return np.ascontiguousarray(np.stack([one, two], axis=1)).view("V16").ravel()


POSTING = T.StructType([T.StructField("key", T.LongType()), T.StructField("check", T.LongType()), T.StructField("doc_id", T.LongType())])


def posting_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in chunks(batch.column(1)):
                starts, ends, r = line_spans(buf, off)
                at, key, check = line_keys(buf, starts, ends, min_chars)
                doc = np.searchsorted(r, at, side="right") - 1
                # a key counts once for a document
                order = np.lexsort((check, key, doc))
                k, c, d = key[order], check[order], doc[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
                pick = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(key[pick])), pa.array(as_int64(check[pick])), ids.slice(lo, hi - lo).take(pa.array(doc[pick]))], names=POSTING.names)

    return run


def clean_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def postings_of(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return clean_of(documents).mapInArrow(posting_rows(min_chars), POSTING)


def reference_counts(postings: DataFrame) -> DataFrame:
    """key, check, n_docs, last_doc: exact, per key; pre-aggregated before each shuffle,
    so that a key found in every document is a few rows per task."""
    distinct = postings.groupBy("key", "check", "doc_id").agg(F.lit(1).alias("one"))
    return distinct.groupBy("key", "check").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))


FILTER = "shard long, capacity long, n_keys long, data binary, overflow array<long>"


def filter_updater(capacity: int):
    """Keys that go in and out of a shard's filter; a shard without one gets one for so many keys."""

    def run(key, old, changes):
        import pandas as pd

        if len(old):
            room, n = int(old["capacity"][0]), int(old["n_keys"][0])
            own = CuckooFilter.load(bytes(old["data"][0]), [int(x) for x in old["overflow"][0]])
        else:
            room, n, own = max(capacity, len(changes)), 0, CuckooFilter(max(capacity, len(changes)))
        into, out = (changes["key"][changes["up"] == up].to_numpy(np.int64).view(np.uint64) for up in (True, False))
        own.delete(out)
        own.insert(into)
        data, overflow = own.dump()
        return pd.DataFrame({"shard": [int(key[0])], "capacity": [room], "n_keys": [n + len(into) - len(out)], "data": [data], "overflow": [overflow]})

    return run


def updated_filters(filters: DataFrame, changes: DataFrame, shards: int, capacity: int) -> DataFrame:
    """The filters after changes (key, up): only shards with changes are touched; a shard
    (key modulo the number of shards; a key is a hash) holds about SHARD_KEYS keys."""
    dealt = changes.select("key", "up", F.pmod("key", F.lit(shards)).alias("shard"))
    return filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(filter_updater(capacity), FILTER)


def prober(filters, shards: int):
    """Keeps the postings whose key may be in its shard's filter."""

    def run(batches):
        tables = {s: CuckooFilter.load(data, overflow) for s, data, overflow in filters.value}
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            shard = key % shards
            keep = np.zeros(len(key), bool)
            for s in np.unique(shard).tolist():
                if s in tables:
                    own = np.flatnonzero(shard == s)
                    keep[own] = tables[s].contains(key[own].view(np.uint64))
            yield batch.filter(pa.array(keep))

    return run


def shard_prober(batches):
    """From rows sorted by (shard, filter first): the keys that may be in their shard's filter."""
    shard, own = None, None
    for batch in batches:
        of, key, data, overflow = (batch.column(batch.schema.get_field_index(c)) for c in ("shard", "key", "data", "overflow"))
        of = of.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(of)], strict=True):
            if of[lo] != shard:
                shard, own = of[lo], None
            if data[lo].is_valid:
                own, lo = CuckooFilter.load(data[lo].as_py(), overflow[lo].as_py()), lo + 1
            if own is not None and lo < hi:
                keys = key.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([keys.filter(pa.array(own.contains(keys.to_numpy(zero_copy_only=False).view(np.uint64))))], names=["key"])


def may_be_frequent(postings: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int | None = None) -> DataFrame:
    """The postings that pass the filters.  Filters are broadcast only if together they are
    within broadcast_bytes; larger ones meet the postings' distinct keys shard by shard."""
    size = filters.agg(F.coalesce(F.sum(F.length("data") + 8 * F.size("overflow")), F.lit(0)).alias("n")).first()["n"]
    if size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows = [(r.shard, bytes(r.data), list(r.overflow)) for r in filters.collect()]
        return postings.mapInArrow(prober(postings.sparkSession.sparkContext.broadcast(rows), shards), POSTING)
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = postings.groupBy("key").agg(F.lit(0).alias("one")).select(F.pmod("key", F.lit(shards)).alias("shard"), "key")
    both = filters.select("shard", F.lit(None).cast("long").alias("key"), "data", "overflow").unionByName(keys, allowMissingColumns=True)
    found = both.repartition(max(parts, min(shards, 10 * parts)), "shard").sortWithinPartitions("shard", F.col("data").isNull()).mapInArrow(shard_prober, "key long")
    return postings.join(found, "key", "left_semi").select(*POSTING.names)


COUNT = "key long, check long, n_docs long, last_doc long"


class LineIndex:
    """The incremental state: insert and delete documents, then ask what to drop."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, state: tuple | None = None):
        modest_batches(spark)
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        none = lambda schema: spark.createDataFrame([], schema)
        self.postings, self.counts, self.filters, self.shards = state or (none(POSTING), none(COUNT), none(FILTER), 0)

    def _empty(self) -> bool:
        return not self.shards

    def _next(self, postings: DataFrame, changed: DataFrame) -> LineIndex:
        """The index with these postings and counts; `before` in the latter is the number of documents so far."""
        changed = stash(changed, "line-counts")
        counts = changed.where("n_docs > 0").drop("before")
        was, now = F.col("before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        n_keys = counts.where(now).count()
        shards, filters = self.shards, self.filters
        crossing = changed.where(was != now).select("key", now.alias("up"))
        full = not self._empty() and (n_keys > 4 * shards * SHARD_KEYS or not filters.where("n_keys > capacity").isEmpty())
        if self._empty() or full:  # filters are built anew only when the keys have outgrown them
            shards, filters, crossing = max(1, -(-n_keys // SHARD_KEYS)), self.spark.createDataFrame([], FILTER), counts.where(now).select("key", F.lit(True).alias("up"))
        capacity = max(1024, int(1.5 * -(-n_keys // shards)))
        made = stash(updated_filters(filters, crossing, shards, capacity), "line-filters")
        return LineIndex(self.spark, self.min_chars, self.min_docs, (postings, counts, made, shards))

    def insert(self, documents: DataFrame) -> LineIndex:
        """A new index that also counts the lines of documents; what a doc_id refers to
        already counts once.  Rows without a doc_id are passed over."""
        new = postings_of(documents.where("doc_id is not null"), self.min_chars)
        if not self._empty():
            new = new.join(self.postings, POSTING.names, "left_anti")
        new = stash(new, "line-postings")
        added = reference_counts(new)
        if self._empty():
            return self._next(new, added.withColumn("before", F.lit(0).cast("long")))
        both = self.counts.withColumn("before", F.col("n_docs")).unionByName(added.withColumn("before", F.lit(0).cast("long")))
        summed = both.groupBy("key", "check").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.sum("before").alias("before"))
        return self._next(self.postings.unionByName(new), summed)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """A new index without the documents whose doc_id is listed: their references
        are gone, and the keys that become rarer leave the filters."""
        if self._empty():
            return self
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        kept = stash(self.postings.join(gone, "doc_id", "left_anti").select(*POSTING.names), "line-postings")
        lost = stash(reference_counts(self.postings.join(gone, "doc_id", "left_semi")), "lost-references").select("key", "check", F.col("n_docs").alias("lost"))
        last = kept.join(lost, ["key", "check"], "left_semi").groupBy("key", "check").agg(F.max("doc_id").alias("left_doc"))
        joined = self.counts.join(lost, ["key", "check"], "left").join(last, ["key", "check"], "left")
        left = (F.col("n_docs") - F.coalesce("lost", F.lit(0))).alias("n_docs")
        return self._next(kept, joined.select("key", "check", left, F.when(F.col("lost").isNull(), F.col("last_doc")).otherwise(F.col("left_doc")).alias("last_doc"), F.col("n_docs").alias("before")))

    def frequent(self) -> DataFrame:
        """key, check, last_doc of the keys in at least min_docs documents."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "check", "last_doc")

    def dropped(self) -> DataFrame:
        """doc_id and the keys whose lines it loses."""
        hits = may_be_frequent(self.postings, self.filters, max(1, self.shards)).join(self.frequent(), ["key", "check"]).where(F.col("doc_id") != F.col("last_doc"))
        return hits.groupBy("doc_id").agg(F.collect_set(F.struct("key", "check")).alias("keys"))

    def clean(self, documents: DataFrame) -> DataFrame:
        """documents (all columns) with the repeated lines cut from text, and the
        columns __n_lines and __n_dropped; the documents must be in the index."""
        plain = documents.withColumn("text", F.col("text").cast("string")).drop("__n_lines", "__n_dropped")
        doc, keys = f"__doc_{uuid.uuid4().hex[:8]}", f"__keys_{uuid.uuid4().hex[:8]}"
        gone = self.dropped().select(F.col("doc_id").alias(doc), F.col("keys").alias(keys))
        joined = plain.join(gone, plain["doc_id"].cast("long") == F.col(doc), "left").drop(doc)
        kind = T.StructType([*plain.schema.fields, T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())])
        return joined.mapInArrow(cutter(plain.columns.index("text"), len(plain.columns), self.min_chars), kind)


def cutter(text: int, keys: int, min_chars: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                starts, ends, r = line_spans(buf, off)
                dropped = np.zeros(hi - lo, np.int64)
                texts = part.column(text)
                lists = part.column(keys)
                marked = [i for i in range(hi - lo) if lists[i].is_valid]
                if marked:
                    at, key, check = line_keys(buf, starts, ends, min_chars)
                    doc = np.searchsorted(r, at, side="right") - 1
                    digest, raw, out = pairs(key, check), buf.tobytes(), texts.to_pylist()
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    for i in marked:
                        own = slice(cut[i], cut[i + 1])
                        drop = lists[i].values.flatten()
                        gone = set(at[own][np.isin(digest[own], pairs(*(x.to_numpy(zero_copy_only=False).view(np.uint64) for x in drop)))].tolist())
                        dropped[i] = len(gone)
                        out[i] = b"\n".join(raw[starts[k] : ends[k]] for k in range(r[i], r[i + 1]) if k not in gone).decode()
                    texts = pa.array(out, texts.type)
                columns = [texts if c == text else part.column(c) for c in range(keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(r)), pa.array(dropped)], names=[*part.schema.names[:keys], "__n_lines", "__n_dropped"])

    return run


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """documents with every line cut whose key (stripped of `[\\x20\\x09-\\x0D]`, A-Z
    lower-cased) has at least min_chars code points and is found in at least
    min_docs documents, except in the largest doc_id that holds it.

    A null text counts as one empty line and stays null.  Lines are judged on the
    input.  A key counts once per doc_id, so repeated rows of a document count
    once.  Rows with a null doc_id count as no document and keep their lines.  An
    empty table gives an empty result.  All columns stay, then __n_lines and
    __n_dropped follow, in place of columns of these names.
    """
    return LineIndex(documents.sparkSession, min_chars, min_docs).insert(documents).clean(documents)
