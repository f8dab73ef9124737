"""Exact quantiles of whole numbers by refined histograms: no sort, no buffer of all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram: a round narrows each interval by this factor.
BINS = 4096


def values_at(df: DataFrame, column: str, places: list[int], least: int, most: int, bins: int = BINS) -> dict[int, int]:
    """The values at the 0-based places of the ascending order of a column of whole numbers between least and most.

    Every round counts, in one pass, the values of the intervals that still matter in `bins` bins each
    (at most bins rows an interval reach the driver) and goes on with the bin that holds the place."""
    found: dict[int, int] = {}
    open_ = {p: (least, most - least + 1, p) for p in places}  # place: begin and width of its interval, places left in it
    while open_:
        intervals = sorted({x[:2] for x in open_.values()})
        steps = [max(1, -(-width // bins)) for _, width in intervals]
        x = F.col(column)
        spots = [F.when((x >= lo) & (x < lo + width), F.struct(F.lit(i).alias("i"), F.floor((x - lo) / step).cast("long").alias("bin"))) for i, ((lo, width), step) in enumerate(zip(intervals, steps, strict=True))]
        rows = df.select(F.explode(F.filter(F.array(*spots), lambda s: s.isNotNull())).alias("s")).groupBy("s.i", "s.bin").agg(F.count(F.lit(1)).alias("n")).collect()
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            counts.setdefault(r["i"], []).append((r["bin"], r["n"]))
        for p, (lo, width, left) in list(open_.items()):
            i = intervals.index((lo, width))
            for b, n in sorted(counts[i]):
                if left < n:
                    break
                left -= n
            begin, step = lo + b * steps[i], steps[i]
            if step == 1:
                found[p] = begin
                del open_[p]
            else:
                open_[p] = (begin, step, left)
    return found


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float], bins: int = BINS) -> dict[str, float | int | None]:
    """count, minimum, maximum and the quantile of each share, interpolated between the two nearest
    places as SQL's percentile does; nulls don't count.  Without values everything but count is null."""
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias(column))
    n, least, most = own.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    out: dict[str, float | int | None] = {"count": n, "minimum": least, "maximum": most}
    if not n:
        return out | dict.fromkeys(shares)
    at = {name: share * (n - 1) for name, share in shares.items()}
    values = values_at(own, column, sorted({f(x) for x in at.values() for f in (math.floor, math.ceil)}), least, most, bins)
    for name, x in at.items():
        lo, hi = math.floor(x), math.ceil(x)
        out[name] = float(values[lo]) if lo == hi else (hi - x) * values[lo] + (x - lo) * values[hi]
    return out
