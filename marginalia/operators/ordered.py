"""Ordered scans that survive a hot key.

``lead`` or a running maximum over ``PARTITION BY key`` sorts every row of a key in
one task, which fails when a key owns a third of the table.  Here the order is cut
into segments (an hour, an arrival block, ...): rows are scanned within
``(key, segment)``, one summary row per segment is scanned per key, and the two are
joined.  Both scans are bounded, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _names(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def next_marked(df: DataFrame, keys, segment: str, order, value: Column, mark: Column,
                out: str) -> DataFrame:
    """``value`` of the nearest later row of the same key for which ``mark`` holds.

    ``segment`` must be monotone in ``order``: no row of a later segment may sort
    before a row of an earlier one.
    """
    keys = _names(keys)
    order = _names(order)
    local = W.partitionBy(*keys, segment).orderBy(*order)
    after = local.rowsBetween(1, W.unboundedFollowing)
    carried = F.when(mark, F.struct(value.alias("v")))
    rows = df.withColumn("_here", F.first(carried, ignorenulls=True).over(after))

    at = F.struct(*order)
    heads = (df.groupBy(*keys, segment)
             .agg(F.min_by(F.struct(value.alias("v")), F.when(mark, at)).alias("_head")))
    later = W.partitionBy(*keys).orderBy(segment).rowsBetween(1, W.unboundedFollowing)
    heads = (heads.withColumn("_later", F.first("_head", ignorenulls=True).over(later))
             .select(*keys, segment, "_later"))
    joined = rows.join(heads, [*keys, segment], "left")
    return joined.withColumn(out, F.coalesce("_here", "_later")["v"]).drop("_here", "_later")


def running_max_before(df: DataFrame, keys, segment: str, order, value: Column, out: str) -> DataFrame:
    """Largest ``value`` among strictly earlier rows of the same key."""
    keys = _names(keys)
    order = _names(order)
    before = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_here", F.max(value).over(before))
    peaks = df.groupBy(*keys, segment).agg(F.max(value).alias("_peak"))
    earlier = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    peaks = peaks.withColumn("_earlier", F.max("_peak").over(earlier)).select(*keys, segment, "_earlier")
    joined = rows.join(peaks, [*keys, segment], "left")
    return joined.withColumn(out, F.greatest("_here", "_earlier")).drop("_here", "_earlier")


def top_per_key(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key.

    The filter sits directly on the rank, so Spark limits each partition to ``k``
    rows per key before the shuffle (WindowGroupLimit); a hot key sends at most
    ``k`` rows from each task.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    window = W.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
