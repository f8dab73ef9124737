"""Secret scans by a randomness test battery, in DataFrame functions only.

Rules find what is written like a secret (assignments, access keys, long
hexadecimal runs).  The battery finds what merely looks random: runs of 20 or more
characters of the base-64 alphabets.  Each candidate's encoding is inferred from its
characters (base 10, 16, 26, 32, 36, 62 or 64), and three tests ask how far it is
from being drawn uniformly from that alphabet:

* chi-squared: counts of all the alphabet's letters, upper tail by the
  Wilson-Hilferty approximation;
* runs: changes between the lower and upper half of the alphabet, normal tail;
* serial correlation of neighbouring letters' ranks, normal tail.

Fisher's method combines them into a score.  To call a candidate a secret is to reject
that it is ordinary writing, and what scores ordinary writing reaches is fitted: every
document gives decoys, all of its words run together in the ways identifiers are
(plain, capitalised, with separators) and cut up, which go through the same battery;
blocks of them that are equal count once.  A candidate's p-value is the share of the decoys of its length class that
look at least as random; Benjamini-Hochberg control within the class bounds the
expected share of ordinary strings among the findings.  Where strings are too short
for the tests to tell them apart, decoys look random too, and nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import stash

# The base rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]

#: Expected share of ordinary strings among the strings found.
FDR = 0.01
#: Scores are counted in bins of this width, up to BIN_LIMIT bins.
BIN, BIN_LIMIT = 0.02, 20_000
#: The lengths that texts are cut to for decoys.
DECOY_LENGTHS = (24, 40, 64, 128)
#: Spans that are counted up in one go; arrays grow within a block and by blocks.
BLOCK = 256
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def all_spans(text: Column, pattern: str, kind: str) -> Column:
    """(kind, start, end, value) of all leftmost, non-overlapping matches, in code points.

    \\G ties each match to the end of the one before, so that the gaps and matches
    come out in order and their lengths add up to positions, in one pass.
    """
    chained = rf"(?s)\G(.*?)({pattern})"
    gaps = F.transform(F.regexp_extract_all(text, F.lit(chained), F.lit(1)), lambda g: F.char_length(g))
    found = F.regexp_extract_all(text, F.lit(chained), F.lit(2))
    empty = F.expr(f"struct(0L as at, cast(array() as {SPAN}) as spans)")

    def add(acc, pair):
        start = acc["at"] + pair["gap"]
        end = start + F.char_length(pair["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def follow(acc, block):
        moved = F.transform(block["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["blocks"], F.array(moved)).alias("blocks"))

    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(g.cast("long").alias("gap"), f.alias("found")))
    # positions within blocks of spans first, then blocks one after the other: no array is copied for every span
    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, BLOCK), empty, add))
    none = F.expr(f"struct(0L as at, cast(array() as array<{SPAN}>) as blocks)")
    # texts without a match (nearly all) cost one plain search
    return F.when(F.regexp_like(text, F.lit(pattern)), F.flatten(F.aggregate(blocks, none, follow, lambda acc: acc["blocks"]))).otherwise(F.expr(f"cast(array() as {SPAN})"))


def normal_tails(z: Column) -> Column:
    """Upper tails of the standard normal law (Abramowitz and Stegun 26.2.17) of an array, at least 1e-300."""
    start = F.transform(z, lambda x: F.struct(x.alias("z"), (F.lit(1.0) / (1 + 0.2316419 * F.abs(x))).alias("t")))
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.transform(start, lambda s: F.struct(s["z"].alias("z"), (0.3989422804014327 * F.exp(-F.abs(s["z"]) * F.abs(s["z"]) / 2) * poly(s["t"])).alias("upper")))
    return F.transform(upper, lambda s: F.greatest(F.lit(1e-300), F.when(s["z"] >= 0, s["upper"]).otherwise(1 - s["upper"])))


def alphabet_size(value: Column) -> Column:
    """The inferred encoding, by the size of its alphabet."""
    return (
        F.when(value.rlike("^[0-9]+$"), 10)
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(value.rlike("^([a-z]+|[A-Z]+)$"), 26)
        .when(value.rlike("^[A-Z2-7]+$"), 32)
        .when(value.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36)
        .when(value.rlike("^[0-9A-Za-z]+$"), 62)
        .otherwise(64)
    )


#: What the letters of each alphabet become, 48 + rank as a character, by (letters, ranks from 0) of each alphabet's size; 0 for 10, 16 and 36.
RANKS = "".join(chr(48 + i) for i in range(64))
UPPER, LOWER_CASE, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    64: (UPPER + LOWER_CASE + DIGITS + "+-/_", RANKS[:62] + RANKS[62] * 2 + RANKS[63] * 2),
    62: (DIGITS + UPPER + LOWER_CASE, RANKS[:62]),
    32: (UPPER + "234567", RANKS[:32]),
    26: (LOWER_CASE + UPPER, RANKS[:26] * 2),
    0: (DIGITS + LOWER_CASE + UPPER, RANKS[:36] + RANKS[10:36]),
}


def ranked(value: Column, size: Column) -> Column:
    """The value's letters as those of RANKS."""
    out = F.translate(value, *ALPHABETS[0])
    for n in (26, 32, 62, 64):
        out = F.when(size == n, F.translate(value, *ALPHABETS[n])).otherwise(out)
    return out


def halves(value: Column, size: Column) -> Column:
    """Of ranked letters: a 0 for each of the lower half of the alphabet, a 1 for each of the upper."""
    marks = lambda n: "".join("1" if 2 * i >= n else "0" for i in range(64))
    out = F.translate(value, RANKS, marks(36))
    for n in (10, 16, 26, 32, 62, 64):
        out = F.when(size == n, F.translate(value, RANKS, marks(n))).otherwise(out)
    return out


def rank_of(letter: Column) -> Column:
    return (F.ascii(letter) - 48).cast("double")


def sums(c: Column) -> Column:
    """What the tests need, from ranked letters (letters, an array; runs, each letter repeated as often as it
    occurs; halves): n, the sum of the ranks, of their squares and of products of neighbours, how many are in
    the upper half of the alphabet and how often that changes, the first and last, and the sum of the
    letters' squared counts."""
    zero, n = F.lit(0.0), F.size(c["letters"])
    counted = F.transform(c["runs"], lambda r: F.struct(rank_of(r).alias("rank"), F.char_length(r).cast("double").alias("n")))
    start = F.struct(*(zero.alias(x) for x in ("sum", "squares", "counts")))
    totals = F.aggregate(counted, start, lambda acc, r: F.struct((acc["sum"] + r["n"] * r["rank"]).alias("sum"), (acc["squares"] + r["n"] * r["rank"] * r["rank"]).alias("squares"), (acc["counts"] + r["n"] * r["n"]).alias("counts")))
    following = F.slice(c["letters"], 2, F.greatest(n - 1, F.lit(0)))
    products = F.aggregate(F.zip_with(c["letters"], following, lambda x, y: rank_of(x) * rank_of(y)), zero, lambda acc, r: acc + F.coalesce(r, zero))
    high = F.char_length(F.replace(c["halves"], F.lit("0"), F.lit("")))
    changes = F.regexp_count(c["halves"], F.lit("0(?=1)|1(?=0)"))
    return F.struct(n.cast("double").alias("n"), rank_of(F.element_at(c["letters"], 1)).alias("first"), rank_of(F.element_at(c["letters"], -1)).alias("last"), totals.alias("of"), products.alias("products"), high.cast("double").alias("high"), changes.cast("double").alias("changes"))


def means(c: Column) -> Column:
    """The expected number of runs above and below the middle of the alphabet, and the mean rank."""
    s = c["sums"]
    return F.struct((2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1).alias("runs"), (s["of"]["sum"] / s["n"]).alias("rank"))


def lags(c: Column) -> Column:
    """The ranks' sum of squared deviations, and of products of neighbouring ones."""
    s, middle = c["sums"], c["means"]["rank"]
    power = s["of"]["squares"] - s["n"] * middle * middle
    lagged = s["products"] - middle * (2 * s["of"]["sum"] - s["first"] - s["last"]) + (s["n"] - 1) * middle * middle
    return F.struct(power.alias("power"), lagged.alias("lagged"))


def deviates(c: Column) -> Column:
    """The standard normal deviates of the three tests; null where a test can't be made, as nothing varies."""
    size, s, mean = c["size"].cast("double"), c["sums"], c["means"]["runs"]
    free, n = size - 1, s["n"]
    chi = (F.pow(F.greatest(F.lit(0.0), s["of"]["counts"] * size / n - n) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
    run = F.when((s["high"] >= 1) & (n - s["high"] >= 1), F.abs((1 + s["changes"] - mean) / spread))
    serial = F.when(c["lags"]["power"] > 1e-9, F.abs((c["lags"]["lagged"] / c["lags"]["power"] + 1 / n) * F.sqrt(n)))
    return F.array(chi, run, serial)


def tests(c: Column) -> Column:
    """The p-values of "uniformly random" of the three tests, from (z, upper tail) of their deviates."""
    p = lambda k: c["tails"][k]
    both = lambda k: F.when(c["z"][k].isNull(), F.lit(1e-12)).otherwise(F.least(F.lit(1.0), 2 * p(k)))
    return F.struct(F.least(p(0), F.lit(1.0)).alias("chi"), both(1).alias("run"), both(2).alias("serial"))


def fisher(p: Column) -> Column:
    """-log10 of the p-value combined by Fisher's method: minus twice the sum of logarithms is chi-squared with six degrees."""
    half = -(F.log(p["chi"]) + F.log(p["run"]) + F.log(p["serial"]))
    return (half - F.log(1 + half + half * half / 2)) / 2.302585092994046


def length_class(n: Column) -> Column:
    return F.when(n < 32, 0).when(n < 48, 1).when(n < 96, 2).otherwise(3)


def finding_bounds(candidates: list[tuple[int, int, int]], decoys: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """For each length class the largest bin of scores that Benjamini-Hochberg still calls
    findings, -1 for none, from counts (class, bin, number) of candidates and decoys."""
    out = {}
    for c in {c for c, _, _ in candidates}:
        own = sorted((b, n) for k, b, n in candidates if k == c)
        null = sorted((b, n) for k, b, n in decoys if k == c)
        m, size = sum(n for _, n in own), sum(n for _, n in null)
        seen, below, at, bound = 0, 0, 0, -1
        for b, n in own:
            seen += n
            while at < len(null) and null[at][0] <= b:
                below += null[at][1]
                at += 1
            if (1 + below) / (1 + size) <= rate * seen / m:
                bound = b
        out[c] = bound
    return out


def scored(values: Column) -> Column:
    """start, end, class and bin of an array of strings (value, start, end)."""
    bare = F.transform(values, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.regexp_replace(c["value"], "=+$", "").alias("value")))
    sized = F.transform(bare, lambda c: F.struct(*(c[x].alias(x) for x in ("start", "end", "value")), alphabet_size(c["value"]).alias("size")))
    # one step's results are the next one's variables: an expression used twice within a step would be computed twice
    carry = lambda c, *names: [c[x].alias(x) for x in ("start", "end", *names)]
    spelled = F.transform(sized, lambda c: F.struct(*carry(c, "size"), ranked(c["value"], c["size"]).alias("value")))
    lettered = F.transform(spelled, lambda c: F.struct(*carry(c, "size"), F.split(c["value"], "").alias("letters"), halves(c["value"], c["size"]).alias("halves")))
    # equal letters stand together in the sorted string
    runs = lambda c: F.regexp_extract_all(F.array_join(F.sort_array(c["letters"]), ""), F.lit(r"(.)\1*"), F.lit(0))
    step = F.transform(lettered, lambda c: F.struct(*carry(c, "size", "letters", "halves"), runs(c).alias("runs")))
    step = F.transform(step, lambda c: F.struct(*carry(c, "size"), sums(c).alias("sums")))
    step = F.transform(step, lambda c: F.struct(*carry(c, "size", "sums"), means(c).alias("means")))
    step = F.transform(step, lambda c: F.struct(*carry(c, "size", "sums", "means"), lags(c).alias("lags")))
    step = F.transform(step, lambda c: F.struct(*carry(c), length_class(c["sums"]["n"]).alias("class"), deviates(c).alias("z")))
    step = F.transform(step, lambda c: F.struct(*carry(c, "class", "z"), normal_tails(c["z"]).alias("tails")))
    tested = F.transform(step, lambda c: F.struct(*carry(c, "class"), tests(c).alias("p")))
    return F.transform(tested, lambda c: F.struct(*carry(c, "class"), F.least(F.floor(fisher(c["p"]) / BIN), F.lit(BIN_LIMIT)).cast("int").alias("bin")))


def decoy_blocks(text: Column, doc_id: Column) -> Column:
    """All of a text, its words run together, capitalised, or with a separator, in blocks of one decoy of each length."""
    words = F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))
    form = F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(3))
    joined = F.when(form == 0, F.lower(F.regexp_replace(words, " ", ""))).when(form == 1, F.regexp_replace(F.initcap(words), " ", "")).otherwise(F.translate(words, " ", "_"))
    return F.regexp_extract_all(joined, F.lit(f".{{1,{sum(DECOY_LENGTHS)}}}"), F.lit(0))


def decoys(block: Column) -> Column:
    """The strings of a block; each letter is in one, but for an end of less than a candidate's 20."""
    starts = [1 + sum(DECOY_LENGTHS[:k]) for k in range(len(DECOY_LENGTHS))]
    cut = F.array(*(F.substr(block, F.lit(at), F.lit(n)) for at, n in zip(starts, DECOY_LENGTHS, strict=True)))
    return F.transform(F.filter(cut, lambda v: F.char_length(v) >= 20), lambda v: F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), v.alias("value")))


def find_secrets(documents: DataFrame, rate: float = FDR) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, rank, kind, end) in
    order, rank being the kind's number in KINDS; positions are code points, end exclusive.

    A null or empty text has no spans.  Candidates of the battery that overlap a rule's
    span are that span.  A null doc_id is one like any other.  Repeated rows give
    repeated rows; columns other than doc_id and text are ignored, whatever their
    names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = docs.select(
        "doc_id",
        F.filter(all_spans(F.col("text"), ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 6).alias("assign"),
        all_spans(F.col("text"), ACCESS, "access").alias("access"),
        all_spans(F.col("text"), HEX, "hex").alias("hex"),
        all_spans(F.col("text"), CANDIDATE, "random").alias("random"),
    )
    based = found.select("doc_id", F.concat("assign", "access", "hex").alias("base"), "random")
    alone = F.filter("random", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), b["kind"]).cast("int").alias("rank"), b["kind"].alias("kind"), b["end"].alias("end")))
    tested = stash(based.select("doc_id", plain.alias("base"), scored(alone).alias("random")), "secret-candidates")
    # equal blocks (copies, one letter over and over) are no further evidence; what is distinct is dealt out anew
    blocks = docs.select(F.explode_outer(decoy_blocks(F.col("text"), F.col("doc_id"))).alias("block")).where("block is not null").distinct()
    ordinary = blocks.select(scored(decoys(F.col("block"))).alias("decoys"))

    def bins(strings: DataFrame, column: str) -> list[tuple[int, int, int]]:
        """At most four classes of BIN_LIMIT bins."""
        each = strings.select(F.explode_outer(column).alias("c")).where("c is not null").groupBy("c.class", "c.bin").agg(F.count(F.lit(1)).alias("n"))
        return [(r["class"], r["bin"], r["n"]) for r in each.collect()]

    bounds = finding_bounds(bins(tested, "random"), bins(ordinary, "decoys"), rate)

    def kept(c):
        limit = F.lit(-1)
        for k, b in bounds.items():
            limit = F.when(c["class"] == k, F.lit(b)).otherwise(limit)
        return c["bin"] <= limit

    more = F.transform(F.filter("random", kept), lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")))
    return tested.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
