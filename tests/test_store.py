"""Commits of changes, merged reads, compaction and claims of the versioned store."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from marginalia.operators import adjacency
from marginalia.sources.store import Change, Store, StoreError


def contents(store, name, version=None):
    return sorted(tuple(r) for r in store.tables(version)[name].collect())


def test_changes_equal_a_dictionary(spark, tmp_path):
    """Rows replace rows of their key, gone keys go, a key in both has the new rows; every version can be read again."""
    store, rng, want, history = Store(spark, str(tmp_path / "s")), random.Random(4), {}, {}
    for step in range(6):
        rows = [(rng.randrange(12), part, rng.randrange(100)) for _ in range(4) for part in range(rng.randint(1, 2))]
        rows = list({(k, p): (k, p, v) for k, p, v in rows}.values())
        gone = [rng.randrange(12) for _ in range(3)]
        df = spark.createDataFrame(rows, "k int, part int, v int")
        keys = spark.createDataFrame([(g, "other") for g in gone], "k int, extra string")
        if step == 3:
            store.commit({"t": df})
            want = {}
        else:
            store.commit({"t": Change(("k",), df, keys)})
            want = {k: r for k, r in want.items() if k not in gone and k not in {r[0] for r in rows}}
        for k, p, v in rows:
            want.setdefault(k, [])
        for k in {r[0] for r in rows}:
            want[k] = [r for r in rows if r[0] == k]
        history[step + 1] = sorted(r for rs in want.values() for r in rs)
        assert contents(store, "t") == history[step + 1]
    assert all(contents(store, "t", v) == rows for v, rows in history.items())
    assert store.compact(0) == 7 and contents(store, "t") == history[6]
    assert store.vacuum() == [1, 2, 3, 4, 5, 6] and contents(store, "t") == history[6]


def test_a_small_change_writes_little(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    big = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.commit({"t": big, "u": big})
    store.commit({"t": Change(("k",), big.filter("k < 20").withColumn("v", F.lit("new")), big.filter("k between 20 and 29"))})
    assert store._bytes("v=2") * 500 < store._bytes("v=1")
    t = store.tables()
    assert t["t"].count() == 199_990 and t["t"].filter("v = 'new'").count() == 20 and t["u"].count() == 200_000
    assert "BroadcastHashJoin" in t["t"]._jdf.queryExecution().executedPlan().toString()
    assert store.compact() == 2         # one change is not yet due


def test_only_buckets_of_the_frontier_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"adjacency": "bucket"})
    edges = spark.range(4000).select(F.concat(F.lit("a"), F.col("id") % 997).alias("source_node_id"), F.concat(F.lit("b"), F.col("id") % 1009).alias("target_node_id"),
                                     F.lit("KNOWS").alias("relation_type"), F.col("id").cast("string").alias("edge_id"))
    names = edges.select(F.col("source_node_id").alias("node_id")).union(edges.select("target_node_id")).distinct().withColumn("name", F.col("node_id"))
    store.commit({"adjacency": adjacency.adjacency(edges, names, ["edge_id"])})
    store.commit({"adjacency": Change(("here",), store.tables()["adjacency"].filter("here = 'a5'"))})
    seeds = spark.createDataFrame([(1, "a5")], "question_id int, here string")
    found = adjacency.at_nodes(store.tables()["adjacency"], seeds)
    assert sorted(r.fact_key for r in found.collect()) == sorted(f"a5|knows|b{i % 1009}" for i in range(5, 4000, 997))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    near = adjacency.nearest_facts(seeds.withColumnRenamed("here", "node_id"), store.tables()["adjacency"], 1, 3, "question_id")
    assert [(r.fact_rank, r.subject, r.object) for r in near.orderBy("fact_rank").collect()] == [(1, "a5", "b1002"), (2, "a5", "b990"), (3, "a5", "b978")]


def test_one_of_two_writers_wins(spark, tmp_path):
    root, made = str(tmp_path / "s"), []
    Store(spark, root).commit({"t": spark.range(1)})

    def write(n):
        try:
            made.append((n, Store(spark, root).commit({"t": spark.range(n)}, base=1)))
        except StoreError:
            pass
    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) == 1 and made[0][1] == 2 and Store(spark, root).tables()["t"].count() == made[0][0]
    assert not [n for n in os.listdir(root) if n.startswith(("next-", "stale-", "done-"))]


def test_a_fresh_claim_is_not_taken(spark, tmp_path):
    """A claim of another attempt is left alone while it is fresh, taken over when it is old."""
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(1)})
    claim = tmp_path / "s" / "next-2"
    claim.write_bytes(b"\x00\x05other")
    with pytest.raises(StoreError):
        store.commit({"t": spark.range(2)})
    assert claim.exists()
    os.utime(claim, (1, 1))
    assert store.commit({"t": spark.range(2)}) == 2 and not claim.exists()
