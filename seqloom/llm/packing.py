"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document of T tokens gives T // capacity full sequences and a remainder.  The
histogram of remainder lengths (at most capacity - 1 numbers) is the demand of a
cutting-stock problem: a linear program over patterns (how many remainders of
each length share a sequence) whose columns are priced by a knapsack dynamic
program.  Patterns rounded down are filled by the remainders in rank order; what
is left over by rounding, a few pieces per pattern, is laid end to end and cut
where a sequence is full, the last sequences being powers of two.
"""

from __future__ import annotations

import json
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sharding import ranked
from .stash import modest_batches, release, stash

CAPACITY = 1024
END = 0

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)
RESULT = [*PIECE.names, "sequence_id", "offset"]


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoder(path: str):
    """text -> uint32 ids, as the byte-level BPE tokenizer file at path defines them (without special tokens)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_symbols()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    # the word splitter of byte-level BPE, a fixed value
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.asarray(encoding.encode_ordinary(text), dtype="<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_rows(path: str, capacity: int):
    """Full pieces and the remainder of each document."""

    def run(batches):
        encode = load_encoder(path)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                data, total = ids.tobytes(), len(ids)
                for start in range(0, total, capacity):
                    n = min(capacity, total - start)
                    for column, value in zip(rows, (doc, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=PIECE.names)

    return run


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the most worth that ascending lengths fill it with,
    and the last length's number (-1: the room is not filled up)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        tried = best[room - lengths[: upto[room]]] + worth[: upto[room]]
        k = int(tried.argmax())
        if tried[k] > best[room - 1] + 1e-12:
            best[room], pick[room] = tried[k], k
        else:
            best[room] = best[room - 1]
    return best, pick


def pattern_with(k: int, lengths: np.ndarray, pick: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable pattern that holds length number k."""
    counts, room = np.zeros(len(lengths)), capacity - int(lengths[k])
    counts[k] = 1
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= int(lengths[pick[room]])
    return counts


def greedy_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """As many patterns as lengths, each filled from the longest lengths that still have
    demand and used until one of them is exhausted.  In the order of exhaustion the
    patterns form a triangular matrix, so they are a feasible basis."""
    left, open_, out = demand.astype(float).copy(), list(range(len(lengths))), []
    while open_:
        room, counts = capacity, np.zeros(len(lengths), np.int64)
        sizes = lengths[open_]
        hi = len(open_)
        while hi:
            hi = int(np.searchsorted(sizes[:hi], room, side="right"))
            if not hi:
                break
            k = open_[hi - 1]
            n = int(min(room // lengths[k], max(1, left[k] // max(1, left[open_[-1]] or 1)))) if k != open_[-1] else max(1, min(room // lengths[k], int(left[k])))
            counts[k] += n
            room -= n * int(lengths[k])
            hi -= 1
        used = np.flatnonzero(counts)
        amount = left[used] / counts[used]
        gone = int(used[np.argmin(amount)])
        left[used] = np.maximum(left[used] - counts[used] * amount.min(), 0)
        left[gone] = 0
        open_.remove(gone)
        out.append(counts)
    return np.array(out)


class Master:
    """The linear program over the columns so far: a basis of patterns and surpluses (minus
    one of a length, free of charge), its inverse, and the amounts, by the revised simplex method."""

    def __init__(self, patterns: np.ndarray, demand: np.ndarray):
        self.basis, self.cost, self.demand = patterns.T.astype(float), np.ones(len(demand)), demand
        self.steps = 0
        self.refactor()
        self.good = self.basis.copy(), self.cost.copy()

    def refactor(self) -> None:
        self.inverse = np.linalg.inv(self.basis)
        self.amounts = np.maximum(np.linalg.solve(self.basis, self.demand), 0)
        self.since = 0

    def residual(self) -> float:
        return float(np.abs(self.basis @ self.amounts - self.demand).max()) / max(1.0, float(self.demand.max()))

    def settle(self) -> bool:
        """Refactorise if rounding errors show, or from time to time; False: back at the last good basis."""
        if self.since < 50 and self.residual() <= 1e-9:
            return True
        try:
            self.refactor()
            sound = self.residual() <= 1e-7
        except np.linalg.LinAlgError:
            sound = False
        if sound:
            self.good = self.basis.copy(), self.cost.copy()
        else:
            self.basis, self.cost = (x.copy() for x in self.good)
            self.refactor()
        return sound

    def enter(self, column: np.ndarray, cost: float) -> bool:
        """Exchange a column of negative reduced cost for the one that bounds it; of ties the largest pivot."""
        step = self.inverse @ column
        ratio = np.full(len(step), np.inf)
        np.divide(self.amounts, step, out=ratio, where=step > 1e-7)
        least = ratio.min()
        if not np.isfinite(least):
            return False
        ties = np.flatnonzero(ratio <= least * (1 + 1e-9) + 1e-9)
        leave = int(ties[step[ties].argmax()])
        if step[leave] < 1e-5:
            return False
        row = self.inverse[leave] / step[leave]
        self.inverse -= np.outer(step, row)
        self.inverse[leave] = row
        amount = ratio[leave]
        self.amounts = np.maximum(self.amounts - step * amount, 0)
        self.amounts[leave] = amount
        self.basis[:, leave], self.cost[leave] = column, cost
        self.steps, self.since = self.steps + 1, self.since + 1
        return True

    def prices(self) -> np.ndarray:
        """What one more of each length costs; surpluses enter until none is negative."""
        for _ in range(4 * len(self.demand)):
            dual = self.cost @ self.inverse
            k = int(dual.argmin())
            if dual[k] >= -1e-9:
                break
            surplus = np.zeros(len(dual))
            surplus[k] = -1
            if not self.enter(surplus, 0.0) or not self.settle():
                break
        return np.maximum(self.cost @ self.inverse, 0)

    def solution(self) -> tuple[np.ndarray, np.ndarray]:
        """Patterns and amounts that meet the demand exactly: a length's surplus is taken
        out of patterns that hold it, which split for that."""
        real = self.cost > 0
        patterns, amounts = list(self.basis[:, real].T.round().astype(np.int64)), list(self.amounts[real])
        surplus = np.zeros(len(self.demand))
        for j in np.flatnonzero(~real):
            surplus[int(self.basis[:, j].argmin())] += self.amounts[j]
        for k in np.flatnonzero(surplus > 0):
            at = 0
            while surplus[k] > 1e-9 and at < len(patterns):
                held = int(patterns[at][k])
                if held and amounts[at] > 0:
                    use = min(amounts[at], surplus[k] / held)
                    less = patterns[at].copy()
                    less[k] = 0
                    surplus[k] -= use * held
                    amounts[at] -= use
                    patterns.append(less)
                    amounts.append(use)
                at += 1
        return np.array(patterns), np.array(amounts)


class Solution(NamedTuple):
    patterns: np.ndarray
    amounts: np.ndarray
    bound: float  #: no solution of the linear program uses fewer sequences
    priced: int  #: knapsacks solved
    steps: int  #: columns that entered


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, smoothing: float = 0.7, batch: int = 20, rounds: int = 20_000) -> Solution:
    """The cutting-stock linear program: patterns.T @ amounts = demand with the least
    sum(amounts), up to a share `gap` above the bound.

    From a greedy basis on, a knapsack over the prices gives for each length the most
    valuable pattern that holds it; up to `batch` of those that are worth more than a
    sequence enter.  Prices are smoothed towards those of the best bound so far (any
    prices over the worth of their best pattern bound the optimum from below), which
    keeps them from swinging.  However good the greedy start is, columns are priced and
    enter until none is left under the plain prices (the optimum), or at least once and
    until the bound is met; `rounds` pivots are a bound that no input met so far.
    """
    greedy = greedy_basis(lengths, demand, capacity)
    master, pool = Master(greedy, demand.astype(float)), np.zeros((0, len(lengths)))
    if master.residual() > 1e-9 or np.abs(master.inverse).max() > 1e6:
        # such a triangle is too badly conditioned to start from: begin with one length to a pattern and let the greedy patterns enter
        master, pool = Master(np.diag(capacity // lengths), demand.astype(float)), greedy.astype(float)
    center = lengths / capacity
    bound, priced, fails, rounds_done = float(center @ demand), 0, 0, 0
    while True:
        dual, share = master.prices(), smoothing if not fails else 0.0
        while True:
            price = share * center + (1 - share) * dual
            best, pick = knapsack(lengths, price, capacity)
            priced += 1
            proof = float(price @ demand) / max(float(best[capacity]), 1e-12)
            if proof > bound:
                bound, center = proof, price / best[capacity]
            near = rounds_done > 0 and master.cost @ master.amounts <= bound * (1 + gap)
            columns, covered = [], np.zeros(len(lengths), bool)
            for k in np.argsort(-(price + best[capacity - lengths]), kind="stable"):
                if len(columns) == batch or near:
                    break
                if not covered[k]:
                    column = pattern_with(int(k), lengths, pick, capacity)
                    covered |= column > 0
                    if dual @ column > 1 + 1e-7:
                        columns.append(column)
            if columns or near or not share or len(pool):
                break
            share = share / 2 if share > 0.3 else 0.0
        if near or not (columns or len(pool)) or master.steps >= rounds:
            break
        before, table, pool = master.steps, np.concatenate([pool, np.array(columns).reshape(-1, len(lengths))]), pool[:0]
        live = np.ones(len(table), bool)
        while live.any():
            reduced = np.where(live, table @ (master.cost @ master.inverse) - 1, -1)
            j = int(reduced.argmax())
            if reduced[j] <= 1e-8:
                break
            live[j] = False
            if not (master.enter(table[j], 1.0) and master.settle()):
                continue
        sound, rounds_done = master.settle(), rounds_done + 1
        fails = 0 if sound and master.steps > before else fails + 1
        if fails > 2:
            break
    if master.residual() > 1e-9:
        master.refactor()
    return Solution(*master.solution(), bound, priced, master.steps)


def rounded(patterns: np.ndarray, amounts: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Whole amounts that no length's demand falls short of."""
    whole = np.floor(amounts + 1e-6).astype(np.int64)
    for k in np.flatnonzero(patterns.T @ whole > demand):
        for p in np.flatnonzero((patterns[:, k] > 0) & (whole > 0)):
            over = int(patterns[:, k] @ whole - demand[k])
            if over <= 0:
                break
            whole[p] -= min(whole[p], -(-over // patterns[p, k]))
    return whole


def plan_patterns(histogram: dict[int, int], capacity: int, waste: float = 0.005) -> tuple[list[tuple], int, int]:
    """What each length's ranks are for, the number of sequences of full patterns, and
    the number of tokens in the stream.

    For each length: first ranks, items per use, first uses, offsets, tokens per use
    (0: a sequence of its own; else a place in the stream) and the number of ranks
    used.  Patterns that leave more than `waste` of a sequence empty go to the
    stream, where uses follow each other without gaps and are cut at the capacity.
    """
    if not histogram:
        return [], 0, 0
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths])
    solved = column_generation(lengths, demand.astype(float), capacity)
    patterns = solved.patterns
    whole = rounded(patterns, solved.amounts, demand)
    plan: dict[int, list[list[int]]] = {int(n): [[], [], [], [], []] for n in lengths}
    used, sequence, stream = dict.fromkeys(plan, 0), 0, 0
    for p in np.flatnonzero(whole):
        offset, fill = 0, int(lengths @ patterns[p])
        own = fill >= capacity * (1 - waste)
        for k in np.flatnonzero(patterns[p]):
            n, per = int(lengths[k]), int(patterns[p, k])
            for column, value in zip(plan[n], (used[n], per, sequence if own else stream, offset, 0 if own else fill), strict=True):
                column.append(value)
            used[n] += per * int(whole[p])
            offset += per * n
        if own:
            sequence += int(whole[p])
        else:
            stream += fill * int(whole[p])
    return [(n, *columns, used[n]) for n, columns in plan.items()], sequence, stream


PLAN = T.StructType(
    [
        T.StructField("length", T.LongType()),
        *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("firsts", "per", "uses", "offsets", "fills")),
        *(T.StructField(c, T.LongType()) for c in ("used", "sequences", "stream")),
    ]
)


def plan_rows(capacity: int):
    """The plan of a histogram (length, n): a row per length, with the numbers that hold for all."""

    def run(batches):
        histogram: dict[int, int] = {}
        for batch in batches:
            histogram.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        plan, sequences, stream = plan_patterns(histogram, capacity)
        if plan:
            rows = [(*p, sequences, stream) for p in plan]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=PLAN.names)

    return run


def planned(rest: DataFrame, capacity: int) -> DataFrame:
    """plan_patterns of the pieces' lengths, solved in a task of one small table (at most
    capacity - 1 rows).  Not on the driver: there LAPACK's threads can hang once Spark has
    started its JVM from the same process; a worker has one thread."""
    spark = rest.sparkSession
    histogram = rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = spark.createDataFrame([tuple(r) for r in histogram], "length long, n long").coalesce(1)
    return stash(rows.mapInArrow(plan_rows(capacity), PLAN), "plan")


def tail_bounds(total: int, capacity: int) -> np.ndarray:
    """Ends of the sequences that hold `total` tokens laid end to end: full ones, then powers of two."""
    ends = list(range(capacity, total + 1, capacity))
    left = total % capacity
    for bit in range(capacity.bit_length(), -1, -1):
        if left >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    return np.array(ends, np.int64)


def cut_stream(total: int, first: int, capacity: int):
    """Cuts pieces at the ends of the stream's sequences: (start, end, sequence, offset) lists per piece."""
    bounds = tail_bounds(total % capacity, capacity) + total // capacity * capacity

    def place(position: int) -> tuple[int, int, int]:
        """Number, begin and end of the sequence that holds a position of the stream."""
        number = position // capacity
        if number < total // capacity:
            return number, number * capacity, (number + 1) * capacity
        k = int(np.searchsorted(bounds, position, side="right"))
        return number + k, int(bounds[k - 1]) if k else total // capacity * capacity, int(bounds[k])

    def run(batches):
        for batch in batches:
            parts: list[list[list[int]]] = [[], [], [], []]
            for start, length, position in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "length", "position")), strict=True):
                own: list[list[int]] = [[], [], [], []]
                at, end = position, position + length
                while at < end:
                    number, begin, stop = place(at)
                    stop = min(stop, end)
                    for column, value in zip(own, (start + at - position, start + stop - position, first + number, at - begin), strict=True):
                        column.append(value)
                    at = stop
                for column, value in zip(parts, own, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in PIECE.names), *(pa.array(p, pa.list_(pa.int64())) for p in parts)], names=CUT.names)

    return run


CUT = T.StructType([*PIECE.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("starts", "ends", "sequences", "offsets"))])


def recut(path: str):
    """The pieces of remainders that lie in several sequences, with their own checksums."""

    def run(batches):
        encode = load_encoder(path)
        for batch in batches:
            rows: list[list[int]] = [[], [], [], [], [], [], []]
            for doc, text, starts, ends, sequences, offsets, tokens, crc in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                data = ids.tobytes()
                if len(ids) != tokens or zlib.crc32(data[4 * starts[0] : 4 * ends[-1]]) != crc:
                    continue  # another text under the same doc_id
                for a, b, s, o in zip(starts, ends, sequences, offsets, strict=True):
                    for column, value in zip(rows, (doc, a, b - a, zlib.crc32(data[4 * a : 4 * b]), tokens, s, o), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=RESULT)

    return run


#: Remainders to be cut again find their texts by a broadcast of so many rows at most, beyond that by a shuffle join.
BROADCAST_ROWS = 1 << 19


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids (its tokens, then id 0) lie in exactly one piece each; a
    sequence has at most `capacity` ids.  Sequences that are not full lack at most
    0.5 %, or are one of the last ones, whose sizes are powers of two.  A null or
    empty text is the id 0 alone.  Rows that repeat a doc_id are packed as
    documents of their own.  An empty table gives an empty result.  The
    tokenizer's file must be readable on the executors.
    """
    spark = documents.sparkSession
    modest_batches(spark)
    path = tokenizer or default_tokenizer()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(docs.mapInArrow(piece_rows(path, capacity), PIECE), "pieces")
    release(spark)
    rest = pieces.where(F.col("length") < capacity)
    plan = planned(rest, capacity)
    # one row per length: at most capacity - 1
    table, (n_patterns, n_stream) = plan.drop("sequences", "stream"), plan.agg(F.coalesce(F.max("sequences"), F.lit(0)), F.coalesce(F.max("stream"), F.lit(0))).first()
    n_full = pieces.where(F.col("length") == capacity).count()

    full = ranked(pieces.where(F.col("length") == capacity), [], ["doc_id", "start", "ids_crc32"], "rank").select(*PIECE.names, (F.col("rank") + n_patterns).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = stash(ranked(rest, ["length"], ["doc_id", "start", "ids_crc32"], "rank").join(F.broadcast(table), "length"), "placed")
    at = F.size(F.filter("firsts", lambda x: x <= F.col("rank")))
    use = F.floor((F.col("rank") - F.element_at("firsts", at)) / F.element_at("per", at)).cast("long")
    inside = F.element_at("offsets", at) + F.pmod(F.col("rank") - F.element_at("firsts", at), F.element_at("per", at)) * F.col("length")
    used = placed.where("rank < used").select(*PIECE.names, use.alias("use"), inside.alias("inside"), F.element_at("uses", at).alias("base"), F.element_at("fills", at).alias("fill"))
    fitted = used.where("fill = 0").select(*PIECE.names, (F.col("base") + F.col("use")).alias("sequence_id"), F.col("inside").alias("offset"))
    streamed = used.where("fill > 0").select(*PIECE.names, (F.col("base") + F.col("use") * F.col("fill") + F.col("inside")).alias("position"))

    # what rounding left over: at most the items of one use of each pattern, fewer than capacity * capacity
    left = placed.where("rank >= used").select(*PIECE.names).orderBy("length", "doc_id", "start").collect()
    rows, total = [], n_stream
    for r in left:
        rows.append((*r, total))
        total += r["length"]
    tail = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in [*PIECE.names, "position"]))
    cut = stash(streamed.unionByName(tail).mapInArrow(cut_stream(total, n_patterns + n_full, capacity), CUT), "cut")
    whole = cut.where("size(starts) = 1").select(*PIECE.names, F.col("sequences")[0].alias("sequence_id"), F.col("offsets")[0].alias("offset"))
    again = cut.where("size(starts) > 1").select("doc_id", "starts", "ends", "sequences", "offsets", F.col("doc_tokens").alias("tokens"), F.col("ids_crc32").alias("crc"))
    n_again = again.count()
    out = full.unionByName(fitted).unionByName(whole)
    if n_again:
        hint = F.broadcast if n_again <= BROADCAST_ROWS else lambda x: x
        ids = hint(again.select(F.col("doc_id").alias("again_id")).distinct())
        few = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi").dropDuplicates(["doc_id", "text"])
        joined = few.join(hint(again.withColumnRenamed("doc_id", "again_id")), F.col("doc_id").eqNullSafe(F.col("again_id"))).select("doc_id", "text", "starts", "ends", "sequences", "offsets", "tokens", "crc")
        out = out.unionByName(joined.mapInArrow(recut(path), T.StructType([T.StructField(c, T.LongType()) for c in RESULT])))
    return out
