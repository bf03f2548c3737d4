"""Order statistics against sorting."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marginalia.operators.selection import median_and_share, order_statistics


@pytest.mark.parametrize("kind", ["spread", "ties", "extreme", "one"])
def test_selected_values_equal_sorted_ones(spark, kind):
    rng = random.Random(9)
    values = {"spread": [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(801)], "ties": [rng.randrange(4) / 3 for _ in range(400)],
              "extreme": [1.7e308, -1.7e308, 5e-324, 0.0, 1e-300, 2e-300, 1.0, 1.0000000000000002], "one": [7.5]}[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan, math.inf, -math.inf]], "x double").repartition(3)
    ranks = lambda n: sorted({1, 2, n // 3 + 1, n - 1, n, n + 5})
    n, found = order_statistics(df, F.col("x"), ranks)
    ordered = sorted(values)
    assert n == len(values) and found == {r: ordered[r - 1] for r in ranks(n) if 1 <= r <= n}
    if kind != "extreme":
        assert median_and_share(df, F.col("x"), 95) == (pytest.approx(statistics.median(values)), ordered[math.ceil(0.95 * n) - 1])


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert median_and_share(df, F.col("x"), 95) == (None, None) and median_and_share(df.limit(0), F.col("x"), 95) == (None, None)
