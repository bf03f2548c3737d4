"""Exact order statistics by refined histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

BINS = 1024


def order_statistics(df: DataFrame, value: Column, ranks: Callable[[int], list[int]]) -> tuple[int, dict[int, float]]:
    """``(n, {rank: value})``: how many values count, and those at the 1-based ``ranks(n)`` in ascending order.

    Null, NaN and infinite values do not count.  Every round counts the values between a rank's bounds in ``BINS`` bins and goes
    on inside the bin that holds the rank, until all values in it are equal; bins carry their own least and greatest value, so
    rounding in the bin's number cannot move a value past another.  A round is one combining aggregate over one narrow
    column: no sort, no buffer of values, and at most ``BINS`` rows for each rank reach the driver.
    """
    v = value.cast("double")
    column = cut_lineage(df.select(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("v")).filter("v is not null"))
    whole = column.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    found: dict[int, float] = {}
    open_ = {r: (whole.lo, whole.hi, 0) for r in set(ranks(whole.n)) if 1 <= r <= whole.n}
    while open_:
        found.update({r: lo for r, (lo, hi, _) in open_.items() if lo == hi})
        open_ = {r: b for r, b in open_.items() if r not in found}
        if not open_:
            break
        bounds = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit((hi / 2 - lo / 2) / BINS).alias("w"))
                           for r, (lo, hi, _) in open_.items()])
        inside = column.select("v", F.explode(F.filter(bounds, lambda b: F.col("v").between(b["lo"], b["hi"]))).alias("b"))
        # halves, so that the width of the widest range is still a number; a width of nothing parts the least value from the rest
        at = F.when(F.col("b.w") > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("b.lo") / 2) / F.col("b.w")))).otherwise(
            (F.col("v") > F.col("b.lo")).cast("long"))
        bins = inside.groupBy(F.col("b.r").alias("r"), at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r, (_, _, below) in list(open_.items()):
            for b in sorted((b for b in bins if b.r == r), key=lambda b: b.bin):
                if below + b.n >= r:
                    open_[r] = (b.lo, b.hi, below)
                    break
                below += b.n
    return whole.n, found


def median_and_share(df: DataFrame, value: Column, percent: int) -> tuple[float | None, float | None]:
    """The median (the mean of the two in the middle of an even number) and the least value that ``percent`` of all reach."""
    def ranks(n):
        return [(n + 1) // 2, n // 2 + 1, max(1, -(-percent * n // 100))]
    n, at = order_statistics(df, value, ranks)
    if not n:
        return None, None
    low, high, top = (at[r] for r in ranks(n))
    return low / 2 + high / 2 if n % 2 == 0 else low, top
