"""Tables cut into segments give the pieces that whole tables give."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import long_tables, tables


def made(seed):
    rng = random.Random(seed)

    def cell(most):
        return rng.choice(["", None, "  x  ", "12.5", " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, most)))])

    headers = [(0, ["Name", "Value", "Note"], "Table 1: Sizes"), (1, ["Name", "", "Note"], ""), (2, ["A", "a"], None), (3, ["A"], "empty"),
               (4, ["Only"], "gaps"), (5, ["K", "V"], "long rows"), (6, ["A", "B"], "one row")]
    body = [(k, i, [cell(4) for _ in range(rng.choice((2, 3, 4)))]) for k, n in ((0, 230), (1, 41), (2, 77)) for i in range(n)]
    body += [(4, i, ["", " "] if i % 3 else ["v  1", None]) for i in range(30)]
    body += [(5, i, [f"k{i}", " ".join(["word"] * rng.choice((1, 30, 150, 390, 500)))]) for i in range(120)]
    body += [(6, 0, ["x", "1"]), (9, 0, ["no", "header"])]
    rng.shuffle(body)
    return headers, body


@pytest.mark.parametrize("segment_rows", [10, 17, 1000])
def test_segments_equal_whole_tables(spark, segment_rows):
    headers, body = made(5)
    heads = spark.createDataFrame(headers, "k int, header array<string>, caption string")
    rows = spark.createDataFrame(body, "k int, i int, cells array<string>")
    got = long_tables.long_table_pieces(rows, heads, "k", "i", segment_rows)
    whole = (heads.join(rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "cells"))).alias("b")), "k")
             .select("k", F.concat(F.array("header"), F.transform("b", lambda r: r["cells"])).alias("rows"), "caption"))
    expected = tables.table_pieces(whole)
    columns = ("k", "is_numeric", "part", "parts", "text")
    key = lambda r: (r["k"], r["part"])
    got, expected = (sorted((r.asDict() for r in x.select(*columns).collect()), key=key) for x in (got, expected))
    assert got == expected and {r["k"] for r in got} == {0, 1, 2, 4, 5, 6}


def test_piece_ends_by_rows_and_words():
    assert long_tables.piece_ends([1] * 12) == [10, 11] + [12] * 10
    assert long_tables.piece_ends([500, 200, 200, 1]) == [1, 3, 4, 4] and long_tables.piece_ends([]) == []


def test_empty_tables(spark):
    heads = spark.createDataFrame([], "k int, header array<string>, caption string")
    rows = spark.createDataFrame([], "k int, i int, cells array<string>")
    assert long_tables.long_table_pieces(rows, heads, "k", "i").count() == 0


def test_one_table_with_most_rows_is_dealt_to_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") < 3600, 0).otherwise(F.col("id")).alias("k"), "id")
        tasks = long_tables.numbered(rows.repartition(4), ["k"], ["id"]).withColumn("task", F.spark_partition_id())
        assert tasks.filter("k = 0 and _rn = id").count() == 3600 and tasks.filter("k > 0 and _rn = 0").count() == 400
        assert tasks.groupBy("task").count().agg(F.max("count")).first()[0] < 1800
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cells_are_trimmed_wherever_the_blank_is(spark):
    rows = [["a b", None, "c|d"], [" a", "b"], ["a", "b "], ["a  b", ""], ["a|", " |b"], ["a b", "c\x1fd"], ["", " "], []]
    got = [r.c for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>").select("i", long_tables._trimmed(F.col("c")).alias("c")).orderBy("i").collect()]
    assert got == [[" ".join((c or "").split()) for c in r] for r in rows]


def test_a_piece_is_counted_by_patterns_of_cells(spark):
    rows = spark.createDataFrame([(1, ["x", "1"])] * 5 + [(1, ["", "2", "3"])], "k int, cells array<string>")
    heads = spark.createDataFrame([(1, ["A", "B"], "t")], "k int, header array<string>, caption string")
    plan = long_tables.described(rows, heads, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "pattern" in plan and [r["_header"] for r in long_tables.described(rows, heads, ["k"]).collect()] == [["A", "B", "column 3"]]
