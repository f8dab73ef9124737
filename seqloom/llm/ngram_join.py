"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles ("tokens", as 64-bit hashes
under a pseudo-random global order).  Equal sets are one class from the start.

1. Single tokens.  If two sets are similar, a set of n tokens misses at most
   r = n - ceil(t * n) of the other's, so that prefixes of r + k tokens share k.
   Prefixes extended to k = r + 2 are posted by token.  A token posted by one set
   only is rare; a set with fewer than k other tokens in its prefix is ruled out
   by its rare ones and has no partner.  (Lists of two to a few sets make poor
   candidates: a chance shingle in common links unrelated texts.)
2. Token combinations.  The other sets extend the prefix to the whole set and
   index combinations of frequent tokens: tokens are dealt to bins by hash, and a
   bin's tokens together are one key.  Similar sets differ in at most H tokens, so
   of more than H bins one is the same in both.  Keys of about 1 / (1 - t) tokens
   are selective where single tokens are not.
3. Verification.  Candidates become clusters (connected components, not yet
   verified); each set is sent to its cluster once, and the exact overlaps of the
   pairs in it are counted there.  Large clusters are cut into blocks, by size and
   hash, and done by pairs of blocks of similar sizes.  A block reports a spanning forest of its links, so results
   grow with the sets and never with their pairs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .stash import modest_batches, release, stash
from .wordkit import LOWER, U64, as_int64, chunks, mix, owners, powers, words

#: Tokens in one block of a cluster (8 MB); a task holds two blocks, at the peak about 40 bytes a token.
BLOCK_TOKENS = 1 << 20
#: Documents of clusters up to this many (16 bytes each) are found by a broadcast of their ids; beyond that by a shuffle join.
BROADCAST_IDS = 1 << 20
#: Classes a task remembers so as not to index copies again.
SEEN = 1 << 18


def token_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, ascending within each text, and each text's range of them."""
    _, _, h, r = words(LOWER[buf], off)
    n = np.diff(r)
    p = powers(k, U64(0xABC98388FB8FAC03))
    size = max(len(h) - k + 1, 0)
    g = np.zeros(size, np.uint64)
    for j in range(k):
        g += h[j : size + j] * p[j]
    doc = owners(r)
    inside = doc[:size] == doc[k - 1 :] if size else np.zeros(0, bool)
    token, of = mix(g[inside]), doc[:size][inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([mix(np.array([np.sum(h[r[i] : r[i + 1]] * p[: n[i]]) + U64(n[i])], np.uint64))[0] for i in short], np.uint64)
        token, of = np.concatenate([token, whole]), np.concatenate([of, short])
    order = np.lexsort((token, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[new], of[new]
    return token, np.searchsorted(of, np.arange(len(off)))


def class_ids(token: np.ndarray, r: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set."""
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ U64(0x1B873593CC9E2D51)), out=total[1:])
    return mix(total[r[1:]] - total[r[:-1]] + np.diff(r).astype(np.uint64))


INFO = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.LongType())])
POSTING = T.StructType([T.StructField("token", T.LongType()), T.StructField("class", T.LongType())])
CANDIDATE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def info_rows(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in chunks(batch.column(1)):
                token, r = token_sets(buf, off, k)
                n = np.diff(r)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(as_int64(class_ids(token, r)), mask=n == 0)], names=INFO.names)

    return run


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n tokens with a similar one."""
    return -(-n * percent // 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, 2 * (n - needed(n, percent)) + 2)


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix tokens a set of n tokens shares with any similar set, at least: what
    the smallest similar set's prefix is long beyond the tokens it may miss."""
    m = needed(n, percent)
    return prefix_length(m, percent) - (m - needed(m, percent))


def prefix_rows(k: int, percent: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(1)):
                token, r = token_sets(buf, off, k)
                n, own = np.diff(r), class_ids(token, r)
                fresh = np.zeros(len(n), bool)
                for i, c in enumerate(own.tolist()):
                    if n[i] and c not in seen:
                        fresh[i] = True
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(c)
                take = np.where(fresh, prefix_length(n, percent), 0)
                rank = np.arange(len(token)) - np.repeat(r[:-1], n)
                pick = rank < np.repeat(take, n)
                of = np.repeat(np.arange(len(n)), take)
                yield pa.RecordBatch.from_arrays([pa.array(as_int64(token[pick])), pa.array(as_int64(own[of]))], names=POSTING.names)

    return run


def lists(batches):
    """Batches of postings sorted by (token, class), without repeated ones: classes, the
    list's number, its start, and how many first rows were there before.  The last
    list's first two rows are carried into the next batch."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
        old = 0
        if carry is not None:
            key, own = (np.concatenate([x, y]) for x, y in zip(carry, (key, own), strict=True))
            old = len(carry[0])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        new[:old] = True
        key, own = key[new], own[new]
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        yield own, np.cumsum(start) - 1, np.flatnonzero(start), old
        last = int(np.flatnonzero(start)[-1])
        at = [last] if last == len(key) - 1 else [last, len(key) - 1]
        carry = (key[at], own[at])


SHARED = T.StructType([T.StructField("class", T.LongType()), T.StructField("shared", T.LongType())])


def shared_rows(batches):
    """For each class how many of its postings are in lists with other classes."""
    for own, group, at, old in lists(batches):
        size = np.diff(np.append(at, len(own)))
        shared = size[group] > 1
        if old == 2:
            shared[:2] = False  # counted before
        elif old == 1:
            pass  # a list of one so far: its row counts now, if others follow
        if shared.any():
            u, count = np.unique(own[shared], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(count)], names=SHARED.names)


def star_rows(batches):
    """Candidate edges from each list's other classes to its first."""
    for own, group, at, _ in lists(batches):
        other = np.ones(len(own), bool)
        other[at] = False
        if other.any():
            both = np.unique(np.stack([own[other], own[at[group[other]]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=CANDIDATE.names)


def size_bounds(percent: int, most: int) -> np.ndarray:
    """Lower bounds of size classes such that sets of similar sizes are in the same or neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out)


SPARE = 2


def combination_rows(k: int, percent: int):
    """One posting for each bin of each set, under its own size class and the next one."""

    def run(batches):
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(1)):
                token, r = token_sets(buf, off, k)
                n, own = np.diff(r), class_ids(token, r)
                if not len(token):
                    continue
                bounds = size_bounds(percent, int(n.max()))
                level = np.searchsorted(bounds, np.maximum(n, 1), side="right") - 1
                for up in (0, 1):
                    most = bounds[level + up + 1] - 1
                    bins = (100 - percent) * 2 * most // (100 + percent) + 1 + SPARE
                    first = np.cumsum(bins) - bins
                    of = np.repeat(np.arange(len(n)), n)
                    slot = first[of] + (mix(token ^ U64(0x52DCE729)) % bins[of].astype(np.uint64)).astype(np.int64)
                    total, count = np.zeros(int(bins.sum()), np.uint64), np.bincount(slot, minlength=int(bins.sum()))
                    np.add.at(total, slot, mix(token ^ U64(0x38495AB5)))
                    doc = np.repeat(np.arange(len(n)), bins)
                    # a set with more empty bins than there are to spare indexes them too
                    empty = np.bincount(doc[count == 0], minlength=len(n))
                    use = (count > 0) | (empty[doc] > SPARE)
                    use &= n[doc] > 0
                    number = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
                    key = mix(mix(total + count.astype(np.uint64)) + mix(number + (level[doc] + up).astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
                    yield pa.RecordBatch.from_arrays([pa.array(as_int64(key[use])), pa.array(as_int64(own[doc[use]]))], names=POSTING.names)

    return run


SETS = T.StructType(
    [T.StructField("cluster", T.LongType()), T.StructField("block", T.LongType()), T.StructField("partners", T.ArrayType(T.LongType())), T.StructField("class", T.LongType()), T.StructField("tokens", T.BinaryType())]
)


def set_rows(k: int):
    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in (2, 3, 4)]
            for lo, hi, buf, off in chunks(batch.column(1)):
                token, r = token_sets(buf, off, k)
                raw = token.tobytes()
                data = [raw[8 * r[i] : 8 * r[i + 1]] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in rest), pa.array(as_int64(class_ids(token, r))), pa.array(data, pa.binary())], names=SETS.names)

    return run


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Component labels of the sets under their links; with two sides, links across only.

    Overlaps are counted through postings: for each set those of its tokens among
    the sets before it.
    """
    g = len(sets)
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    n, side = n[order], side[order]
    by = np.argsort(flat, kind="stable").astype(np.uint32)
    flat = flat[by]
    docs = np.repeat(np.arange(g, dtype=np.uint32), n)[by]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])).astype(np.uint32)
    del flat
    list_start = np.repeat(start, np.diff(np.append(start, len(by))))
    # for each token of a set, in the set's order: where its list begins and how many sets precede
    begin, before = np.empty(len(by), np.uint32), np.empty(len(by), np.uint32)
    begin[by] = list_start
    before[by] = np.arange(len(by), dtype=np.uint32) - list_start
    del by, list_start
    edge = np.cumsum(n) - n
    label = np.arange(g)
    two = side.any() and not side.all()
    for i in range(g):
        own = slice(edge[i], edge[i] + n[i])
        length = before[own].astype(np.int64)
        total = int(length.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(begin[own] - (np.cumsum(length) - length), length)
        common = np.bincount(docs[at], minlength=i)[:i]
        ok = 100 * common >= percent * (n[i] + n[:i] - common)
        if two:
            ok &= side[:i] != side[i]
        roots = np.unique(label[:i][ok])
        if len(roots):
            merged = np.append(roots, label[i])
            label[np.isin(label, merged)] = merged.min()
    out = np.empty(g, np.int64)
    out[order] = order[label]
    return out


def link_rows(percent: int):
    """From sets sorted by (cluster, i, j): spanning edges of the links in each group."""

    def forest(rows):
        own = np.array([x[0] for x in rows])
        if len(rows) < 2:
            return None
        label = linked([np.frombuffer(x[1], np.uint64) for x in rows], np.array([x[2] for x in rows]), percent)
        root = own[label]
        real = root != own
        return pa.RecordBatch.from_arrays([pa.array(own[real]), pa.array(root[real])], names=CANDIDATE.names) if real.any() else None

    def run(batches):
        group, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            own, data = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            side = batch.column(5).to_pylist()
            for key, c, d, s in zip(keys, own, data, side, strict=True):
                if key != group:
                    if (out := forest(rows)) is not None:
                        yield out
                    group, rows = key, []
                rows.append((c, d, s))
        if (out := forest(rows)) is not None:
            yield out

    return run


def restricted(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """docs joined with ids on doc_id; ids are broadcast only if counted as few."""
    return docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id")


def partner_blocks(members: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """doc_id, cluster, its block and the blocks that hold sets it may be similar to.

    A cluster of up to block_tokens tokens is one block.  A larger one is cut by size
    class, and those by hash; a set meets the blocks of its own and the two
    neighbouring classes only, as others differ too much in size.
    """
    most = members.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    bounds = F.array(*[F.lit(int(b)) for b in size_bounds(percent, most)])
    total = members.groupBy("root").agg(F.sum("n").alias("total"))
    level = F.when(F.col("total") <= block_tokens, 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("n")))).cast("long")
    sized = members.join(total, "root").withColumn("level", level)
    counts = sized.groupBy("root", "level").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).cast("long").alias("blocks"))
    for step in (-1, 0, 1):
        near = counts.select("root", (F.col("level") - step).alias("level"), F.col("blocks").alias(f"blocks{step}"))
        sized = sized.join(near, ["root", "level"], "left")

    def blocks(step: int):
        n = F.col(f"blocks{step}")
        numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.transform(numbers, lambda b: F.shiftleft(F.col("level") + step, 32) + b)

    own = F.shiftleft(F.col("level"), 32) + F.pmod(F.xxhash64("class"), F.col("blocks0"))
    return sized.select("doc_id", F.col("root").alias("cluster"), own.alias("block"), F.concat(blocks(-1), blocks(0), blocks(1)).alias("partners"))


def linked_classes(documents: DataFrame, shingle: int, percent: int, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, n, class), and for each class its root and component_id."""
    spark = documents.sparkSession
    modest_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    info = stash(docs.mapInArrow(info_rows(shingle), INFO), "sets")
    classes = info.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))

    def sorted_by(postings: DataFrame, key: str) -> DataFrame:
        return postings.repartition(n_parts, key).sortWithinPartitions(key, "class")

    singles = docs.mapInArrow(prefix_rows(shingle, percent), POSTING)
    shared = sorted_by(singles, "token").mapInArrow(shared_rows, SHARED).groupBy("class").agg(F.sum("shared").alias("shared"))
    m = F.expr(f"(n * {percent} + 99) div 100")
    spare = F.expr(f"m - (m * {percent} + 99) div 100")
    enough = shared.join(classes, "class").withColumn("m", m).withColumn("spare", spare).where("shared >= least(m, 2 * spare + 2) - spare")
    extended = stash(enough.select("doc_id"), "extended")
    release(spark)
    combos = restricted(docs, extended, extended.count()).select("doc_id", "text").mapInArrow(combination_rows(shingle, percent), POSTING)
    clusters = connected_components(sorted_by(combos, "token").mapInArrow(star_rows, CANDIDATE).distinct())
    release(spark)

    ids = stash(partner_blocks(clusters.withColumnRenamed("node", "class").join(classes, "class"), percent, block_tokens), "clusters")
    sets = restricted(docs, ids, ids.count()).select("doc_id", "text", "cluster", "block", "partners").mapInArrow(set_rows(shingle), SETS)
    pairs = sets.withColumn("other", F.explode("partners")).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "tokens", (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    links = pairs.repartition(n_parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(link_rows(percent), CANDIDATE)
    roots = connected_components(links)
    release(spark)

    owned = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return info, owned.join(least, "root").select("class", "root", "component_id")


def near_duplicate_components(documents: DataFrame, shingle: int = 5, percent: int = 80, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id
    that can be reached over links; documents link if 100 * |intersection| >=
    percent * |union| of their sets of `shingle`-word shingles (A-Z lower-cased).

    A text with fewer words has one shingle, its whole sequence.  Null, empty and
    blank texts have none and are their own components.  Equal texts are linked.
    Repeated rows of a doc_id give repeated rows.  Rows with a null doc_id are left
    out.  An empty table gives an empty result.
    """
    info, named = linked_classes(documents, shingle, percent, block_tokens)
    return info.join(named.drop("root"), "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all its columns; of
    several such rows (repeated, or near copies under one doc_id) any one stays.

    Of null, empty and blank texts, which link with nothing, one row for a doc_id
    stays.  Rows without a doc_id all stay: nothing tells them apart.  An empty
    table gives an empty result; further columns, whatever their names, are kept.
    """
    info, named = linked_classes(documents, shingle, percent)
    named = stash(named, "classes")
    own = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    counted = info.join(named, "class", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(own).alias("own"))
    kept = stash(counted.where("own").drop("own"), "one-of-each")
    row, key, rows = (f"__{x}_{uuid.uuid4().hex[:8]}" for x in ("row", "key", "rows"))
    known = documents.join(kept.select(F.col("doc_id").alias(key), F.col("rows").alias(rows)), F.col("doc_id").cast("long") == F.col(key))
    out = known.where(F.col(rows) == 1).select(*documents.columns).unionByName(documents.where(F.col("doc_id").cast("long").isNull()))
    if kept.where("rows > 1").isEmpty():
        return out
    # several rows of a doc_id: each gets a number in a written table, and its class anew; the least number of each component stays
    repeated = stash(known.where(F.col(rows) > 1).withColumn(row, F.monotonically_increasing_id()), "repeated-rows")
    numbered = repeated.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(info_rows(shingle), INFO).withColumnRenamed("doc_id", "row")
    owners_ = numbered.join(repeated.select(F.col(row).alias("row"), F.col(key).alias("key")), "row").join(named, "class", "left")
    least = owners_.where("component_id is null or component_id = key").groupBy("key", "root").agg(F.min("row").alias("first"))
    one = repeated.join(least.select("first"), F.col(row) == F.col("first"), "left_semi").select(*documents.columns)
    return out.unionByName(one)
