"""Phrase collocations from suffix arrays of word ids.

Each task numbers the words of its texts shard by shard (a bounded number of words),
sorts all suffixes of the shard by prefix doubling and reads the n-gram counts off the
LCP intervals; Spark adds the shards' counts by (lang, phrase).  Words come first.  A
longer phrase occurs no more often than those inside it, so its suffixes are taken
only where both of the phrases that are one word shorter are frequent; a bit set
of those, of bounded size, is broadcast, and where they don't fit, nothing is left out
before the shuffle.  The bit set saves shuffling and changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import modest_batches, release, stash
from .wordkit import LOWER, U64, buffer_of, by_byte, chunks, hash_spans, mix, spans

#: Words of one suffix array, and rows of a batch of results.
SHARD_WORDS, BATCH_ROWS = 1 << 19, 1 << 16
#: The bit set has BITS_A_KEY bits a frequent phrase, and at most MAX_BITS (16 MB); beyond that it is left out.
BITS_A_KEY, MAX_BITS = 16, 1 << 27

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

COUNTS = "lang string, phrase string, n long"


def suffix_array(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of ids (0: a break) that don't start at a break, sorted by
    their first `longest` ids or more; lcp[i] is what order[i - 1] and order[i] have in common,
    at most `longest`, and no break is part of it.

    Prefix doubling: a round gives every position the rank of its first 2 * width ids from
    the ranks of the first width.  What follows a break only splits ties after it.
    """
    starts = np.flatnonzero(ids)
    rank, width = np.concatenate([ids.astype(np.int64), np.zeros(longest, np.int64)]), 1
    while width < longest:
        pair = rank[starts] * (int(rank.max(initial=0)) + 1)
        pair += rank[starts + width]
        rank[starts] = np.unique(pair, return_inverse=True)[1] + 1
        width *= 2
    order = starts[np.argsort(rank[starts], kind="stable")]
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    for d in range(longest):
        a = padded[order[:-1] + d]
        same &= (a == padded[order[1:] + d]) & (a != 0)
        lcp[1:] += same
    return order, lcp


def intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A start and the count of each n-gram of `size` ids: the maximal runs of suffixes of which neighbours have so many in common."""
    padded = np.concatenate([ids, np.zeros(size, ids.dtype)])
    long = np.ones(len(order), bool)
    for d in range(1, size):
        long &= padded[order + d] != 0
    head = np.flatnonzero(long & (lcp < size))
    if not len(head):
        return head, head
    total = np.append(0, np.cumsum(long))
    return order[head], np.diff(total[np.append(head, len(order))])


class Shard:
    """Words of whole texts, to be counted together."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.breaks: list[np.ndarray] = []  #: whether a word can't follow the one before it
        self.langs: list[np.ndarray] = []
        self.names: list[str] = []
        self.n = 0

    def add(self, buf: np.ndarray, off: np.ndarray, langs: list[str]) -> None:
        low = LOWER[buf]
        inside = by_byte(WORD, low)
        starts, ends = spans(inside, off)
        if not len(starts):
            return
        lens = ends - starts
        at = np.zeros(len(lens) + 1, np.int32)
        np.cumsum(lens, out=at[1:])
        self.words.append(pa.StringArray.from_buffers(len(lens), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))))
        total = np.append(0, np.cumsum(by_byte(BREAK, low)))
        cut = np.ones(len(starts), bool)
        cut[1:] = total[starts[1:]] > total[ends[:-1]]
        doc = np.searchsorted(off, starts, side="right") - 1
        cut[1:] |= doc[1:] != doc[:-1]
        self.breaks.append(cut)
        index = {name: i for i, name in enumerate(self.names)}
        for name in langs:
            if name not in index:
                index[name] = len(self.names)
                self.names.append(name)
        self.langs.append(np.array([index[x] for x in langs], np.int64)[doc])
        self.n += len(starts)

    def parts(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(ids with breaks, each id's word and lang number, words) of parts with a bounded number of
        words.  Neighbouring parts share longest - 1 words, at which no suffix of the first starts."""
        if not self.n:
            return
        table = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        if isinstance(table, pa.ChunkedArray):
            table = table.combine_chunks()
        word, cut, lang = table.indices.to_numpy().astype(np.int64), np.concatenate(self.breaks), np.concatenate(self.langs)
        for lo in range(0, self.n, SHARD_WORDS):
            hi = min(self.n, lo + SHARD_WORDS)
            yield word[lo : hi + longest - 1], cut[lo : hi + longest - 1], lang[lo : hi + longest - 1], hi - lo, table.dictionary


def phrase_texts(words: pa.Array, word: np.ndarray, starts: np.ndarray, size: int) -> pa.Array:
    """The words from each start on, joined by one space."""
    parts = [words.take(pa.array(word[starts + d])) for d in range(size)]
    return pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]


def phrase_hashes(marks: np.ndarray, word: np.ndarray, starts: np.ndarray, size: int, lang: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each phrase of words with the hashes `marks`, and of its lang."""
    out = langs[lang[starts]]
    for d in range(size):
        out = mix(out ^ marks[word[starts + d]])
    return out


def text_hashes(texts: pa.Array) -> np.ndarray:
    buf, off = buffer_of(texts)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(np.diff(off))
    out[full] = hash_spans(buf, off[full], off[full + 1])
    return out


def in_bits(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether both of a key's bits are set."""
    size = U64(len(bits) * 64 - 1)
    out = np.ones(len(key), bool)
    for place in (key & size, (key >> U64(32)) & size):
        out &= (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1
    return out


def count_phrases(sizes: range, frequent):
    """(lang, phrase, count in the shard) of all n-grams of the sizes, and for size 1 the number
    of words under the empty phrase.  frequent: a broadcast bit set that holds the n-grams of
    which there must be one at a start and at the word after it, or None."""
    longest = sizes[-1]

    def counted(shard: Shard) -> Iterator[pa.RecordBatch]:
        names = pa.array(shard.names, pa.string())
        lang_marks = text_hashes(names) if len(names) else None
        marks = None
        for word, cut, lang, own, words in shard.parts(longest):
            place = np.arange(len(word)) + np.cumsum(cut)  # a break before each cut
            ids = np.zeros(int(place[-1]) + 1, np.int64)
            ids[place] = word * len(names) + lang + 1
            back = np.zeros(len(ids), np.int32)
            back[place] = np.arange(len(word))
            if frequent is not None:
                if marks is None:
                    marks = text_hashes(words)
                whole = np.ones(len(word), bool)  # whether so many words follow without a break
                for d in range(1, longest):
                    whole[: len(word) - d] &= ~cut[d:]
                    whole[len(word) - d :] = False
                at = np.flatnonzero(whole[:own])
                key = phrase_hashes(marks, word, np.concatenate([at, at + 1]), longest - 1, lang, lang_marks)
                good = in_bits(frequent.value, key)
                keep = at[good[: len(at)] & good[len(at) :]]
                used = np.zeros(len(ids), bool)
                used[place[keep]] = True
                for d in range(1, longest):  # suffixes elsewhere are of no use: all words but these become breaks
                    used[place[keep] + d] = True
                start = np.zeros(len(ids), bool)
                start[place[keep]] = True
                ids = np.where(used, ids, 0)
            else:
                start = np.zeros(len(ids), bool)
                start[place[:own]] = True
            order, lcp = suffix_array(ids, longest)
            # drop the suffixes that start where none is to be counted; what their neighbours have in common is the least in between
            order, lcp = chosen(order, lcp, start)
            for size in sizes:
                first, n = intervals(ids, order, lcp, size)
                first = back[first]
                for lo in range(0, len(first), BATCH_ROWS):
                    some = first[lo : lo + BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[some])), phrase_texts(words, word, some, size), pa.array(n[lo : lo + BATCH_ROWS])], names=["lang", "phrase", "n"])
            if sizes[0] == 1:
                total = np.bincount(lang[:own], minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(names)), pa.array(total)], names=["lang", "phrase", "n"])

    def run(batches):
        shard = Shard()
        for batch in batches:
            langs = batch.column(1).fill_null("und").to_pylist()
            for lo, hi, buf, off in chunks(batch.column(0)):
                shard.add(buf, off, langs[lo:hi])
                if shard.n >= SHARD_WORDS:
                    yield from counted(shard)
                    shard = Shard()
        yield from counted(shard)

    return run


def chosen(order: np.ndarray, lcp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at a start, with the lcp of those that are neighbours now."""
    keep = np.flatnonzero(start[order])
    if len(keep) == len(order) or not len(keep):
        return order[keep], lcp[keep]
    least = np.minimum.reduceat(lcp, np.append(0, keep[:-1] + 1)) if len(keep) > 1 else lcp[:1]
    least[0] = 0
    return order[keep], least


def bit_rows(batches):
    """The bits of frequent phrases: for each word of the bit set those that are set in it."""
    for batch in batches:
        size = U64(int(batch.column(2)[0].as_py()) - 1) if batch.num_rows else U64(0)
        if not batch.num_rows:
            continue
        phrases = pc.split_pattern(batch.column(1), " ")
        flat = phrases.flatten().dictionary_encode()
        marks, word = text_hashes(flat.dictionary), flat.indices.to_numpy()
        langs = batch.column(0).dictionary_encode()
        lang_marks = text_hashes(langs.dictionary)
        per = len(flat) // batch.num_rows
        starts = np.arange(batch.num_rows) * per
        of = np.zeros(len(flat), np.int64)
        of[starts] = langs.indices.to_numpy()
        key = phrase_hashes(marks, word, starts, per, of, lang_marks)
        place = np.concatenate([key & size, (key >> U64(32)) & size])
        at, row = np.unique(place >> U64(6), return_inverse=True)
        bits = np.zeros(len(at), np.uint64)
        np.bitwise_or.at(bits, row, U64(1) << (place & U64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])


def bit_set(phrases: DataFrame):
    """A broadcast bit set of phrases (lang, phrase) of one size, or None where it would be over its bound."""
    n = phrases.count()
    size = 1 << max(16, (n * BITS_A_KEY - 1).bit_length())
    if size > MAX_BITS:
        return None
    rows = phrases.select("lang", "phrase", F.lit(size).alias("size")).mapInArrow(bit_rows, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def frequent_phrases(documents: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n) of all phrases of 1 to longest words that occur at least `least` times, and each lang's number of words under the empty phrase."""
    docs = documents.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))

    def summed(sizes: range, bits) -> DataFrame:
        rows = docs.mapInArrow(count_phrases(sizes, bits), COUNTS)
        return stash(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")

    found = summed(range(1, 2), None)
    release(documents.sparkSession)
    last = found.where("phrase <> ''")
    for size in range(2, longest + 1):
        last = summed(range(size, size + 1), bit_set(last))
        release(documents.sparkSession)
        found = found.unionByName(last)
    return found


def words_of(column: str):
    """The number of words of a phrase: words hold no space."""
    return F.when(F.col(column) == "", 0).otherwise(F.length(column) - F.length(F.replace(F.col(column), F.lit(" "), F.lit(""))) + 1)


def mine_phrases(documents: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, inside: int = 50) -> DataFrame:
    """Each lang's `top` phrases of 2 to `longest` words: lang, rank, phrase, a (its count), l and r
    (the counts of the parts of its worst cut), n (words of the lang) and score
    (floor(10 ** 6 a a / (l r)), the least of all cuts).

    Texts are lower-cased (A-Z) and cut at .,;:!? and line ends; words are separated by
    spaces and tabs.  A candidate occurs `least` times or more; it goes if a longer
    candidate that holds its words has `inside` percent of its count or more.  Order: score
    and count descending, phrase ascending by bytes.  A null lang is und; a null text has
    no words; rows count as often as they occur, whatever their doc_id; other columns are
    ignored; an empty table gives an empty result.
    """
    modest_batches(documents.sparkSession)
    found = frequent_phrases(documents, least, longest)
    known = found.where("phrase <> ''")
    candidates = known.withColumn("size", words_of("phrase")).where("size >= 2")
    words = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")

    cuts = candidates.withColumn("words", words).select("lang", "phrase", F.col("n").alias("a"), "size", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(a18 * a18) * cast(1000000 as decimal(7,0)) div (l18 * r18)")
    cuts = cuts.select("*", *(exact(c).alias(f"{c}18") for c in "alr")).withColumn("score", score.cast("long"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("w")).select("lang", "phrase", "w.score", "w.a", "w.l", "w.r")

    longer = candidates.where("size >= 3").withColumn("words", words)
    inner = longer.select("lang", F.col("n").alias("outer"), "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "outer", F.explode(F.expr("transform(sequence(1, size - m + 1), s -> array_join(slice(words, s, m), ' '))")).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < inside * F.col("a")))

    totals = found.where("phrase = ''").select("lang", F.col("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
