"""Language-model scoring with a probabilistic suffix tree over words.

The tree's root is the add-one unigram distribution of the training tokens.  A node is
a context, a sequence of preceding tokens of varying length.  Contexts grow level by level:
a candidate of d tokens occurs LEAST_CONTEXT times, its last d - 1 tokens are a kept
context, and its first d - 1 tokens were a candidate; it is kept if its next-token
distribution diverges from that of its suffix (a likelihood-ratio test).  Growth ends
where the data put it: at the level without a candidate, or after the one whose contexts
all together gain less than LEVEL_GAIN nats a training token (beyond it only runs of one
word go on, whose every length is a context, and each level reads the texts once), at
DEPTH tokens at the latest.  Distributions are
smoothed by interpolation with the suffix's:
P(w | s) = (c(s, w) + STRENGTH * P(w | suffix of s)) / (c(s) + STRENGTH),
with what transitions counted less than LEAST times leave added to the weight.  A token
is scored in the longest kept suffix of the text before it.

A token's logarithm is then a sum of values over the n-grams that end there, each the
bonus of a transition or the mass that a context leaves to its suffix, so that a
document's score needs the values of its n-grams only.

All counts cover the whole training corpus, and every context and transition that
passes the constant floors and the test is kept, in written tables that grow with the
corpus.  What is shipped to every task is bounded all the same: the values of the
SHIPPED words and n-grams seen most, and bit sets of up to BITS
bits, which only tell what can't be in a table.  Everything else is looked up exactly
by a shuffle.  Counts and look-ups travel as arrays, one for each task and shard, not as rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stash import drop_stash, modest_batches, release, stash
from .wordkit import LOWER, U64, as_int64, by_byte, chunks, mix, words

#: Words and n-grams in the broadcast table, at most (24 bytes each); bits of a set that is broadcast.
SHIPPED, BITS = 1 << 21, 1 << 27
STRENGTH = 20.0
#: Transitions counted at least so often are evidence; the divergence test's threshold on the gain in nats.
LEAST, LEAST_CONTEXT, GAIN = 3, 8, 12.0
#: Tokens of the longest contexts at most; what a level must gain, in nats a training token, for the next one to be grown.
DEPTH, LEVEL_GAIN = 16, 0.002
#: N-grams that a task gathers before it counts and sends them on, and look-ups that it gathers.
GATHERED, ASKED = 2_000_000, 500_000
END = mix(np.array([0x454E44], np.uint64))[0]
C1, C2 = U64(0x8CB92BA72F3D8DD7), U64(0xABC98388FB8FAC03)


def in_training(folds: int = 7, out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % folds != out, F.lit(True))


def token_stream(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), and each text's range of them."""
    _, _, h, r = words(by_byte(LOWER, buf), off)
    n = np.diff(r)
    ranges = r + np.arange(len(r))
    out = np.full(len(h) + len(n), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, ranges


def gram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the keys of all its tokens but the last, and of all but the first (a token's is its hash)."""
    return mix(mix(a ^ C1) + b * C2)


def unigram_rows(batches):
    """Counts of the task's tokens, emitted whenever many have gathered."""
    held: list[np.ndarray] = []
    size = 0

    def out():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(as_int64(u)), pa.array(n)], names=["token", "n"])

    for batch in batches:
        for _, _, buf, off in chunks(batch.column(0)):
            tokens, _ = token_stream(buf, off)
            held.append(tokens)
            size += len(tokens)
            if size > 4_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class Index:
    """A sorted table of hashes whose buckets, by the highest bits, say where to look: a key
    costs two or three steps however large the table is."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(1, len(table).bit_length() - 1)
        self.shift = U64(64 - bits)
        self.first = np.zeros(1 << bits, np.uint32)
        np.cumsum(np.bincount((table >> self.shift).view(np.int64), minlength=1 << bits)[:-1], out=self.first[1:], dtype=np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the table, and whether the keys are there."""
        if not len(self.table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        last = len(self.table) - 1
        at = np.minimum(self.first[(keys >> self.shift).view(np.int64)], last).astype(np.int64)
        there = self.table[at]
        hit = there == keys
        behind = np.flatnonzero(there < keys)
        while len(behind):
            behind = behind[at[behind] < last]
            at[behind] += 1
            there, wanted = self.table[at[behind]], keys[behind]
            hit[behind] = there == wanted
            behind = behind[there < wanted]
        return at, hit


def within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are not in the set; a key has three bits in one of its words."""
    word = bits[((keys >> U64(20)) & U64(len(bits) - 1)).view(np.int64)]
    return (word >> (keys & U64(63))) & (word >> ((keys >> U64(6)) & U64(63))) & (word >> ((keys >> U64(12)) & U64(63))) & U64(1) == 1


def bit_set(df: DataFrame, key: str) -> np.ndarray:
    """A set of the keys: 16 bits for each, up to BITS (a power of two, at most 2 ** 50) in all."""
    size = min(BITS, 1 << max(6, (16 * df.count()).bit_length())) >> 6
    place = F.shiftrightunsigned(key, 20).bitwiseAND(F.lit(size - 1)).alias("at")
    own = " | ".join(f"shiftleft(1L, cast(shiftright(k, {shift}) & 63 as int))" for shift in (0, 6, 12))
    table = df.select(place, F.col(key).alias("k")).groupBy("at").agg(F.expr(f"bit_or({own})").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def grams(tokens: np.ndarray, r: np.ndarray, filters: list[tuple[np.ndarray, np.ndarray]]):
    """Level by level the n-grams of two tokens and more whose beginning may be a candidate
    and whose end may be a counted transition: positions of the last token, and the two keys."""
    place = np.arange(len(tokens)) - np.repeat(r[:-1], np.diff(r))
    key, live = tokens, np.ones(len(tokens), bool)
    for d, (first, second) in enumerate(filters, 1):
        at = np.flatnonzero(live[1:] & live[:-1] & (place[1:] >= d)) + 1 if len(tokens) > 1 else np.zeros(0, np.int64)
        a, b = key[at - 1], key[at]
        hit = within(first, a) & within(second, b)
        at, a, b = at[hit], a[hit], b[hit]
        yield at, a, b
        key, live = np.zeros(len(tokens), np.uint64), np.zeros(len(tokens), bool)
        key[at], live[at] = gram_key(a, b), True


def shards_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> U64(20)) % U64(shards)).astype(np.int64)


SHARDED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.BinaryType())])


def counted_rows(filters, shards: int):
    """The n-grams of the last level of the filters, counted in the task and dealt to shards:
    runs of equal beginnings, whose number comes first."""

    def out(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        key = gram_key(a, b)
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        a, b, shard = a[at], b[at], shards_of(key[at], shards)
        order = np.lexsort((a, shard))
        a, b, n, shard = a[order], b[order], n[order].astype(np.uint32), shard[order]
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        data = []
        for lo, hi in zip(cut, np.append(cut[1:], len(a)), strict=True):
            run = np.flatnonzero(np.append(True, a[lo + 1 : hi] != a[lo : hi - 1]))
            size = np.diff(np.append(run, hi - lo)).astype(np.uint32)
            data.append(b"".join([np.uint32(len(run)).tobytes(), a[lo:hi][run].tobytes(), size.tobytes(), b[lo:hi].tobytes(), n[lo:hi].tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(data, pa.binary())], names=SHARDED.names)

    def run(batches):
        tables = [(first.value, second.value) for first, second in filters]
        held, size = [], 0
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                *_, (_, a, b) = grams(*token_stream(buf, off), tables)
                held.append((a, b))
                size += len(a)
                if size > GATHERED:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "a", "b", "n")])


def by_shard(batches, columns: int):
    """(shard, rows) of batches sorted by shard, as lists of Python values."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(columns)), strict=True))
    return groupby(rows, key=lambda row: row[0])


def summed_rows(least: int):
    """The n-grams counted at least so often, from their shards."""

    def unpack(data):
        runs = int(np.frombuffer(data, np.uint32, 1)[0])
        a = np.frombuffer(data, np.uint64, runs, 4)
        size = np.frombuffer(data, np.uint32, runs, 4 + 8 * runs)
        total, at = int(size.sum()), 4 + 12 * runs
        return np.repeat(a, size), np.frombuffer(data, np.uint64, total, at), np.frombuffer(data, np.uint32, total, at + 8 * total)

    def run(batches):
        for _, rows in by_shard(batches, 2):
            a, b, n = (np.concatenate(x) for x in zip(*(unpack(data) for _, data in rows), strict=True))
            key, at, of = np.unique(gram_key(a, b), return_index=True, return_inverse=True)
            total = np.bincount(of, weights=n).astype(np.int64)
            often = total >= least
            yield pa.RecordBatch.from_arrays([*(pa.array(as_int64(x[often])) for x in (key, a[at], b[at])), pa.array(total[often])], names=COUNTED.names)

    return run


def counted(texts: DataFrame, filters, shards: int, parts: int) -> DataFrame:
    """key, a, b, n of the n-grams of a level that are counted LEAST times; a shard is a
    bounded share of all n-grams, whatever single ones are frequent."""
    dealt = texts.mapInArrow(counted_rows(filters, shards), SHARDED)
    return dealt.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(summed_rows(LEAST), COUNTED)


def grow(moves: DataFrame, sizes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """From the transitions (a, key, n, below: the probability by the suffix) of the
    candidates (a, size) those that diverge from their suffix (a, size, left, scale), and
    their transitions (key, n, bonus, p).

    The gain is the log-likelihood ratio of the counted transitions, all others lumped
    together, so that sums per context, taken before any shuffle, are all it needs.
    """
    term = F.col("n") * F.log(F.col("n") / F.col("below"))
    sums = moves.groupBy("a").agg(F.sum("n").alias("kept"), F.sum(term).alias("terms"), F.sum("below").alias("mass"))
    rest = F.col("size") - F.col("kept")
    lumped = F.when(rest > 0, rest * F.log(rest / F.col("size") / F.greatest(F.lit(1e-12), 1 - F.col("mass")))).otherwise(0.0)
    gain = F.col("terms") - F.col("kept") * F.log(F.col("size")) + lumped
    diverging = sums.join(sizes, "a").where(gain >= GAIN)
    nodes = stash(diverging.select("a", "size", (STRENGTH + rest).alias("left"), (F.col("size") + STRENGTH).alias("scale"), gain.alias("gain")), f"{label}-contexts")
    p = (F.col("n") + F.col("left") * F.col("below")) / F.col("scale")
    bonus = F.log10((F.col("n") / F.col("below") + F.col("left")) / F.col("left"))
    return nodes, stash(moves.join(nodes.drop("size", "gain"), "a").select("key", "n", bonus.alias("bonus"), p.alias("p")), f"{label}-moves")


class Fitted:
    """The tree: total and distinct training tokens, the table of all their counts (token,
    n), the table of all values (key, n, value; n is null but for words) with the counts
    that decide what is broadcast, and the filters of each level."""

    def __init__(self, counts: DataFrame, total: int, distinct: int):
        self.counts, self.total, self.distinct = counts, total, distinct
        self.values: DataFrame | None = None
        self.filters: list = []
        self.nodes: list[DataFrame] = []  #: by level; read while the tables are there
        self.moves: list[DataFrame] = []


def fit(documents: DataFrame) -> Fitted:
    """The tree of the documents' texts."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * parts
    texts = documents.select(F.col("text").cast("string").alias("text"))
    counts = stash(texts.mapInArrow(unigram_rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "unigrams")
    release(spark)
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tree = Fitted(counts, row["n"], row["v"])
    end = int(as_int64(np.array([END], np.uint64))[0])
    # the end never precedes a token
    candidates = counts.where((F.col("n") >= LEAST_CONTEXT) & (F.col("token") != end)).select(F.col("token").alias("a"), F.col("n").alias("size"))
    root = (F.col("n") + 1) / F.lit(float(tree.total + tree.distinct + 1))
    known = counts.where(F.col("n") >= LEAST).select(F.col("token").alias("key"), root.alias("p"))
    level = 0
    while level < DEPTH and not candidates.isEmpty():
        level += 1
        tree.filters.append(tuple(spark.sparkContext.broadcast(bit_set(*x)) for x in ((candidates, "a"), (known, "key"))))
        found = stash(counted(texts, tree.filters, shards, parts), f"level-{level}")
        release(spark)
        # the filters let some others through: the joins settle what is a candidate and a transition of its suffix
        moves = found.join(known.select(F.col("key").alias("b"), F.col("p").alias("below")), "b").join(candidates.select("a"), "a", "left_semi")
        moves = stash(moves.select("a", "key", "n", "below"), f"level-{level}-moves")
        nodes, kept = grow(moves, candidates, f"level-{level}")
        gained = nodes.agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain")).first()["gain"]
        tree.nodes.append(nodes)
        tree.moves.append(kept)
        if gained < LEVEL_GAIN * tree.total:
            drop_stash(found)
            drop_stash(moves)
            break
        grown = found.where(F.col("n") >= LEAST_CONTEXT).join(candidates.select("a"), "a", "left_semi").join(nodes.select(F.col("a").alias("b")), "b", "left_semi")
        following = stash(grown.select(F.col("key").alias("a"), F.col("n").alias("size")), f"candidates-{level + 1}")
        for used in (found, moves, *([candidates] if level > 1 else [])):
            drop_stash(used)
        candidates, known = following, kept.select("key", "p")
        release(spark)

    remains = F.log10(F.col("left") / F.col("scale"))
    nothing = F.lit(None).cast("long")
    tokens = counts.select(F.col("token").alias("key"), "n", F.col("n").alias("seen"), F.lit(0.0).alias("value"))
    grams_ = [kept.select("key", nothing, "n", "bonus") for kept in tree.moves] + [nodes.select("a", nothing, "size", remains) for nodes in tree.nodes]
    for part in grams_:
        tokens = tokens.union(part)
    tree.values = stash(tokens.groupBy("key").agg(F.max("n").alias("n"), F.max("seen").alias("seen"), F.sum("value").alias("value")), "values")
    release(spark)
    return tree


def often(tree: Fitted) -> Column:
    """What is in the broadcast table: the words and n-grams seen most, by classes of their counts, as many as it holds."""
    count_class = F.floor(16 * F.log2("seen"))
    held, least = 0, None
    for row in tree.values.groupBy(count_class.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect():
        held += row["n"]
        if held > SHIPPED:
            break
        least = row["c"]
    return F.lit(False) if least is None else count_class >= least


def arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, counts and values of a bounded table."""
    got = table.select("key", F.coalesce("n", F.lit(0)).alias("n"), "value").toArrow()
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    return key[order], got.column("n").to_numpy()[order].astype(float), got.column("value").to_numpy()[order]


#: What goes to the shards, as arrays: kind 0 is a part of the table of values, 1 the documents of a batch, 2 look-ups for the batch.
SENT = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("data", T.BinaryType())])
#: The documents of a batch, and what look-ups add to the one of that number.
DOCUMENT = np.dtype([("known_id", "?"), ("doc_id", "<i8"), ("n_tokens", "<i8"), ("known", "<i8"), ("logs", "<f8"), ("gain", "<f8")])
ADDED = np.dtype([("at", "<u4"), ("known", "<u4"), ("logs", "<f8"), ("gain", "<f8")])


def sent(shard, kind: int, batch: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array(data, pa.binary())], names=SENT.names)


def dealt_arrays(key: np.ndarray, shards: int, *others: np.ndarray):
    """(shards, their parts of the arrays as bytes), the key's first."""
    shard = shards_of(key, shards)
    order = np.argsort(shard, kind="stable")
    shard, columns = shard[order], [x[order] for x in (key, *others)]
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    ends = np.append(cut[1:], len(shard))
    return shard[cut], [b"".join(x[lo:hi].tobytes() for x in columns) for lo, hi in zip(cut, ends, strict=True)]


def value_rows(shards: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                key = batch.column(0).to_numpy().view(np.uint64)
                n = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
                shard, data = dealt_arrays(key, shards, n, batch.column(2).to_numpy())
                yield sent(shard, 0, -1, data)

    return run


def scored_rows(tree, filters, shards: int):
    """Per document what the broadcast tables give, and the words and n-grams they lack."""

    def run(batches):
        from pyspark import TaskContext

        head_key, head_n, head_value, more = tree.value
        head = Index(head_key)
        tables = [(first.value, second.value) for first, second in filters]
        number = TaskContext.get().partitionId() << 33
        documents, held, size, count = [], [], 0, 0

        def out():
            yield sent([number % shards], 1, number, [np.concatenate(documents).tobytes()])
            if held:
                key, at = (np.concatenate(x) for x in zip(*held, strict=True))
                shard, data = dealt_arrays(key, shards, at.astype(np.uint32))
                yield sent(shard, 2, number, data)

        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column(1)):
                n = hi - lo
                tokens, r = token_stream(buf, off)
                doc = np.repeat(np.arange(n), np.diff(r))
                total = lambda of, x: np.bincount(of, weights=x, minlength=n)  # noqa: B023, E731
                at, hit = head.find(tokens)
                seen = np.where(hit, head_n[at] if len(head_key) else 0, 0)
                own = np.zeros(n, DOCUMENT)
                ids = batch.column(0).slice(lo, n)
                own["known_id"], own["doc_id"] = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                own["n_tokens"], own["known"], own["logs"] = np.diff(r), total(doc, hit), total(doc, np.log10(seen + 1))
                own["gain"] = total(doc, np.where(hit, head_value[at] if len(head_key) else 0, 0))
                missed = [(tokens[~hit], doc[~hit])]
                for last, a, b in grams(tokens, r, tables):
                    key, of = gram_key(a, b), doc[last]
                    at, found = head.find(key)
                    own["gain"] += total(of[found], head_value[at[found]])
                    lack = np.flatnonzero(~found)
                    lack = lack[within(more, key[lack])]
                    missed.append((key[lack], of[lack]))
                documents.append(own)
                for key, of in missed:
                    if len(key):
                        held.append((key, of + count))
                        size += len(key)
                count += n
                if size > ASKED or count > ASKED:
                    yield from out()
                    documents, held, size, count = [], [], 0, 0
                    number += 1
        if documents:
            yield from out()

    return run


LOOKED = T.StructType(SENT.fields[1:])


def looked_up_rows(batches):
    """The documents as they came, and what the look-ups of each shard add to them; the shard's table of values comes first."""

    def out(kind, batch, data):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([batch], pa.int64()), pa.array([data], pa.binary())], names=LOOKED.names)

    for _, rows in by_shard(batches, len(SENT)):
        tables, key, n, value, index = [], None, None, None, None
        for _, kind, batch, data in rows:
            if kind == 0:
                size = len(data) // 24
                tables.append((np.frombuffer(data, np.uint64, size), np.frombuffer(data, np.int64, size, 8 * size), np.frombuffer(data, np.float64, size, 16 * size)))
            elif kind == 1:
                yield out(kind, batch, data)
            elif tables:
                if key is None:
                    key, n, value = (np.concatenate(x) for x in zip(*tables, strict=True))
                    order = np.argsort(key, kind="stable")
                    key, n, value = key[order], n[order], value[order]
                    index = Index(key)
                size = len(data) // 12
                wanted, of = np.frombuffer(data, np.uint64, size), np.frombuffer(data, np.uint32, size, 8 * size)
                at, hit = index.find(wanted)
                at, of = at[hit], of[hit]
                if len(at):
                    where, of = np.unique(of, return_inverse=True)
                    word = n[at] >= 0
                    added = np.zeros(len(where), ADDED)
                    added["at"], added["known"] = where, np.bincount(of, weights=word, minlength=len(where))
                    added["logs"] = np.bincount(of, weights=np.where(word, np.log10(np.maximum(n[at], 0) + 1), 0), minlength=len(where))
                    added["gain"] = np.bincount(of, weights=value[at], minlength=len(where))
                    yield out(kind, batch, added.tobytes())


SUMMED = T.StructType([T.StructField(c, T.DoubleType() if c in ("logs", "gain") else T.LongType()) for c in DOCUMENT.names[1:]])


def summed_documents(batches):
    """The documents of each batch with all that was added, from rows sorted by (batch, kind)."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (1, 2)), strict=True))
    for _, own in groupby(rows, key=lambda row: row[0]):
        out = np.frombuffer(next(own)[1], DOCUMENT).copy()
        for _, data in own:
            added = np.frombuffer(data, ADDED)
            for c in ("known", "logs", "gain"):
                out[c][added["at"]] += added[c]
        yield pa.RecordBatch.from_arrays([pa.array(out[c], mask=~out["known_id"] if c == "doc_id" else None) for c in SUMMED.names], names=SUMMED.names)


def score_documents(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams) and score (the tree), both log10 probabilities.

    The tree is trained on the documents whose crc32(doc_id as text) modulo 7 is not
    2; a null doc_id is in the training part.  A null or empty text is one end
    token.  Repeated rows are trained on and scored as often as they occur.  With
    no training document every token has the probability 1.  Columns other than
    doc_id and text are ignored.  An empty table gives an empty result.
    """
    spark = documents.sparkSession
    modest_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tree = fit(docs.where(in_training()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shipping = often(tree)
    rare = tree.values.where(~shipping)
    more = bit_set(rare.where("n is null"), "key")
    shipped = spark.sparkContext.broadcast((*arrays(tree.values.where(shipping)), more))
    sends = docs.mapInArrow(scored_rows(shipped, tree.filters, parts), SENT).unionByName(rare.select("key", "n", "value").mapInArrow(value_rows(parts), SENT))
    looked = sends.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(looked_up_rows, LOOKED)
    summed = looked.repartition(parts, "batch").sortWithinPartitions("batch", "kind").mapInArrow(summed_documents, SUMMED)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tree.total + tree.distinct + 1)))
    return summed.select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score")
    )
