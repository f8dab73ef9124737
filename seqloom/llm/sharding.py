"""Sharding of documents by longest-processing-time scheduling.

Documents with equal texts form a group that must stay together.  LPT takes
groups from the largest to the smallest and gives each to the least-loaded
shard, kept in a heap.  Groups of one size are interchangeable, so the schedule
needs only the histogram of group sizes: D distinct sizes of groups need at
least D * (D + 1) / 2 bytes of text, so 100 TB have at most 14 million of them.
Which group takes which place follows from its rank among those of its size.
"""

from __future__ import annotations

import functools
import heapq
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stash import stash

#: Ranks and slots are counted in PARTS * PARTS hash buckets, so that no window holds a whole size class or shard.
PARTS = 64
#: Group sizes that the driver schedules at a time.
BLOCK_SIZES = 1 << 18


def lpt_counts(sizes: list[tuple[int, int]], shards: int, loads: list[int] | None = None) -> list[tuple[int, list[int]]]:
    """(size, groups given to each shard) for a histogram (size, number of groups).

    As the heap would do it group by group: while many groups of a size are left,
    whole rounds are done at once (all shards within one size of each other take
    one each per round).
    """
    heap = [(load, s) for s, load in enumerate(loads or [0] * shards)]
    heapq.heapify(heap)
    out = []
    for size, count in sorted(sizes, reverse=True):
        given = [0] * shards
        left = count
        while left:
            lowest, highest = heap[0][0], max(heap)[0]
            if left >= shards and size and highest - lowest < size:
                # every shard takes one before any takes a second: full rounds keep this so
                rounds = left // shards
                heap = [(load + rounds * size, s) for load, s in heap]
                given = [g + rounds for g in given]
                left -= rounds * shards
                continue
            load, s = heap[0]
            # so many until the next shard is the least loaded
            second = min(heap[1:3]) if shards > 1 else (load + size * left, s)
            n = 1 if not size else max(1, min(left, -(-(second[0] - load) // size)))
            heapq.heapreplace(heap, (load + n * size, s))
            given[s] += n
            left -= n
        out.append((size, given))
    return out


def schedule_table(histogram: DataFrame, shards: int, block: int = BLOCK_SIZES) -> DataFrame:
    """(bytes, ends) of a histogram (bytes, n): groups of a size with a rank below ends[k] go to shards 0 .. k.

    The sizes come to the driver in descending order and in blocks, of which it holds one
    beside the shards' loads; each block's part of the schedule is written before the next."""
    spark = histogram.sparkSession
    kind = "bytes long, ends array<long>"
    loads, parts, rows = [0] * shards, [], histogram.orderBy(F.desc("bytes")).toLocalIterator()
    while own := [(r["bytes"], r["n"]) for r in itertools.islice(rows, block)]:
        given = lpt_counts(own, shards, loads)
        for size, counts in given:
            loads = [load + size * n for load, n in zip(loads, counts, strict=True)]
        parts.append(stash(spark.createDataFrame([(size, list(itertools.accumulate(counts))) for size, counts in given], kind), "schedule"))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the zero-based rank `name` within keys, by (hash bucket of order, order).

    Rows are counted per key and bucket; the counts are summed up over PARTS groups of
    PARTS buckets, first within each group, then over the groups.  So only a bucket is
    sorted in one place, and no window sees more than PARTS counts.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(PARTS * PARTS)))
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__part", F.floor(F.col("__bucket") / PARTS))
    earlier = lambda n, by, at: F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within_part = counts.select(*keys, "__bucket", "__part", earlier("__n", [*keys, "__part"], "__bucket").alias("__here"))
    parts = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__n"))
    before_part = parts.select(*keys, "__part", earlier("__n", keys, "__part").alias("__before"))
    first = within_part.join(before_part, [*keys, "__part"]).select(*keys, "__bucket", (F.col("__here") + F.col("__before")).alias("__first"))
    within = F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(*order)) - 1
    return df.withColumn("__within", within).join(first, [*keys, "__bucket"]).withColumn(name, (F.col("__first") + F.col("__within")).cast("long")).drop("__bucket", "__first", "__within")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def shard_by_size(documents: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law
    ("bytes"), shard, slot (gapless from 0 within the shard), grown_shard (null).

    A null text counts as empty, and is grouped with empty texts.  Repeated rows
    are rows of their own, in one shard.  An empty table gives an empty result.  Columns
    other than doc_id and text are ignored, whatever their names.
    A group larger than a shard's fair share fills its shard alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("group"),
        F.xxhash64(text).alias("twin"),
    )
    # texts are read and hashed once
    docs = stash(docs, "sized-documents")
    groups = stash(docs.groupBy("group", "twin").agg(F.sum("size").alias("bytes")), "text-groups")
    histogram = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"))
    plan = schedule_table(histogram, shards)
    placed = ranked(groups, ["bytes"], ["group", "twin"], "rank").join(plan, "bytes").select("group", "twin", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    out = docs.join(placed, ["group", "twin"])
    return ranked(out, ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
