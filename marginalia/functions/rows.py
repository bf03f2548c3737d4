"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def spread_array(df: DataFrame, keep, array, value: str, position: str | None = None) -> DataFrame:
    """One row per element of ``array`` next to the ``keep`` columns.

    A plain explode makes the optimizer add a "not empty" filter and push it down,
    which evaluates a costly array expression a second time, without its staging.  The
    outer form has no such filter; the placeholder row of an empty array goes by its
    missing position.
    """
    at = position or "_at"
    array = F.col(array) if isinstance(array, str) else array
    flat = df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())
    return flat if position else flat.drop(at)
