import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evolution, graph, memory, ordered, search
from marginalia.plans import graph_queries
from marginalia.session import release
from marginalia.streaming import jobs

S = "\x1f"


def fact(s, r, o):
    return S.join((s, r, o))


def at(month):
    return dt.datetime(2026, month, 1)


@pytest.fixture()
def world(spark):
    memories = spark.createDataFrame([
        ("m1", "Atlas is managed by A.", fact("atlas", "managed_by", "a"), at(8), "active", None),
        ("m2", "Atlas likes B.", fact("atlas", "likes", "b"), at(8), "active", None),
        ("m3", "Atlas is managed by A!", fact("atlas", "managed_by", "a"), at(8), "active", None),
        ("m4", "old", "", None, "superseded", None)],
        "memory_id string, content string, fact_signature string, event_time timestamp, status string, replacement_id string")
    support = spark.createDataFrame([("m1", at(8), True), ("m2", at(8), True), ("m3", at(8), True)],
                                    "memory_id string, last_time timestamp, all_timed boolean")
    return memories, support


def judge(spark, world, *cases):
    memories, support = world
    notes, proposals = [], []
    for i, (content, signature, time, action, targets) in enumerate(cases):
        notes.append((f"n{i}", content, signature, time, f"d{i}", 0))
        proposals += [(f"n{i}", action, t, p, "model says so") for p, t in enumerate(targets or [None])]
    notes = spark.createDataFrame(notes, "note_id string, content string, fact_signature string, event_time timestamp, doc_id string, chunk_index int")
    proposals = spark.createDataFrame(proposals, "note_id string, action string, target_id string, position int, reason string")
    return evolution.decide(notes, proposals, memories, support), proposals


def test_guards(spark, world):
    new_boss = fact("atlas", "managed_by", "c")
    decided, _ = judge(spark, world,
                       ("later", new_boss, at(9), "update", ["m1"]), ("earlier", new_boss, at(7), "update", ["m3"]),
                       ("other predicate", fact("atlas", "likes", "c"), at(9), "update", ["m2"]),
                       ("conflict", new_boss, at(9), "retire", ["m2"]), ("unknown", new_boss, at(9), "update", ["m9"]),
                       ("inactive", new_boss, at(9), "update", ["m4"]), ("no target", new_boss, at(9), "merge", []),
                       ("keep", new_boss, at(9), "retain", ["m2"]), ("claimed", new_boss, at(9), "update", ["m1"]), ("odd", "", None, "erase", []))
    got = {r.note_id: (r.action, r.reason) for r in decided.collect()}
    assert got["n0"] == ("update", "model says so")
    assert got["n1"] == ("add", "Update blocked: explicit later event time required")
    assert got["n2"] == ("add", "Update blocked: predicate is not configured as single-valued")
    assert got["n3"] == ("add", "Consolidation blocked: facts differ")
    assert [got[f"n{i}"][0] for i in (4, 5, 6, 8, 9)] == ["rejected"] * 5
    assert got["n7"][0] == "retain"


def test_effects(spark, world):
    memories, _ = world
    boss = fact("atlas", "managed_by", "a")
    decided, proposals = judge(spark, world, ("same fact again", boss, at(9), "merge", ["m1", "m3"]), ("x", fact("atlas", "likes", "b"), at(9), "retire", ["m2"]))
    tables = {"memories": memories, "memory_sources": spark.createDataFrame([("m1", "a"), ("m3", "b"), ("m2", "c")], "memory_id string, note_id string"),
              "notes": spark.createDataFrame([("a", "m1", False, False), ("b", "m3", False, False), ("c", "m2", False, False)],
                                             "note_id string, memory_id string, vector_pending boolean, vector_delete_pending boolean")}
    out = evolution.apply_decisions(tables, decided, proposals)
    status = {r.memory_id: (r.status, r.replacement_id) for r in out["memories"].collect()}
    mine = {r.note_id: r.memory_id for r in decided.collect()}
    assert status["m1"] == ("active", None) and status["m3"] == ("retired", "m1") and status["m2"] == ("retired", mine["n1"])
    assert mine["n0"] == "m1"
    assert {(r.memory_id, r.note_id) for r in out["memory_sources"].collect()} == {("m1", "a"), ("m1", "b"), (mine["n1"], "c")}
    assert {r.note_id: r.memory_id for r in out["notes"].collect()} == {"a": "m1", "b": "m1", "c": mine["n1"]}
    assert {r.memory_id for r in out["revisions"].collect()} == {"m1", "m2", "m3"}


def test_update_leaves_the_index(spark, world):
    memories, _ = world
    decided, proposals = judge(spark, world, ("later", fact("atlas", "managed_by", "c"), at(9), "update", ["m1"]))
    notes = spark.createDataFrame([("a", "m1", True, False)], "note_id string, memory_id string, vector_pending boolean, vector_delete_pending boolean")
    sources = spark.createDataFrame([("m1", "a")], "memory_id string, note_id string")
    out = evolution.apply_decisions({"memories": memories, "memory_sources": sources, "notes": notes}, decided, proposals)
    assert tuple(out["notes"].first()) == ("a", "m1", False, True)
    ends = {r.memory_id: r.end_status for r in graph.replacement_ends(out["memories"]).collect()}
    assert ends["m1"] == "superseded" and ends["m2"] == "active"


def test_chains_and_cycles(spark):
    rows = [(f"c{i}", "retired", f"c{i + 1}") for i in range(37)] + [("c37", "active", None), ("x", "retired", "y"), ("y", "retired", "x"),
                                                                    ("lost", "retired", "nowhere"), ("s", "retired", "t"), ("t", "superseded", "c1")]
    memories = spark.createDataFrame(rows, "memory_id string, status string, replacement_id string")
    ends = {r.memory_id: r.end_status for r in graph.replacement_ends(memories).collect()}
    assert all(ends[f"c{i}"] == "active" for i in range(38))
    assert ends["x"] == ends["y"] == "retired" and ends["lost"] is None and ends["s"] == "superseded"


def test_aliases_join_known_nodes(spark):
    known = spark.createDataFrame([("node", "GPT-4", "Product"), ("node", "Generative Four", "Product")], "node_id string, name string, entity_type string")
    mentions = spark.createDataFrame([("gpt 4", "Product", "d", 0), ("GENERATIVE four", "Product", "d", 1), ("gpt4", "Product", "d", 2), ("GPT-4", "Person", "d", 3)],
                                     "name string, type string, doc_id string, chunk_index int")
    got = {r.name + r.type: (r.node_id == "node", r.is_new) for r in memory.resolve_entities(mentions, known=known).collect()}
    assert got == {"gpt 4Product": (True, False), "GENERATIVE fourProduct": (True, False), "gpt4Product": (False, True), "GPT-4Person": (False, True)}


def test_hops_ignore_direction_and_respect_depth(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "c", "b"), ("e3", "c", "d"), ("e4", "x", "y")], "edge_id string, source_node_id string, target_node_id string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    for depth, want in ((0, {"a": 0}), (2, {"a": 0, "b": 1, "c": 2}), (4, {"a": 0, "b": 1, "c": 2, "d": 3})):
        assert {r.node_id: r.distance for r in graph.hop_distances(seeds, edges, depth).collect()} == want
    with pytest.raises(ValueError):
        graph.hop_distances(seeds, edges, 6)


def test_scans_do_not_depend_on_segments(spark):
    rows = [(i % 3, i, (i * 7919) % 101, i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at int, v int, mark boolean")
    results = []
    for width in (1, 7, 1000):
        cut = df.withColumn("seg", F.floor(F.col("at") / width))
        both = ordered.next_marked(ordered.running_max_before(cut, "k", "seg", "at", F.col("v"), "peak"), "k", "seg", "at", F.col("at"), F.col("mark"), "nxt")
        results.append(sorted((r.at, r.peak, r.nxt) for r in both.collect()))
    assert results[0] == results[1] == results[2]
    assert results[0][5] == (5, (2 * 7919) % 101, 8)


def test_candidates_match_brute_force(spark):
    import random
    rng = random.Random(3)
    pick = lambda n: sorted(rng.sample("abcdefghijkl", n))          # noqa: E731
    notes = [(i, pick(rng.choice([1, 2, 3, 8]))) for i in range(40)]
    held = [(i, ["a"] + pick(rng.choice([1, 2, 4, 9])), "active" if i % 5 else "retired") for i in range(120)]
    held = [(i, sorted(set(items)), s) for i, items, s in held]
    got = memory.candidate_memories(spark.createDataFrame(notes, "note_id int, items array<string>"),
                                    spark.createDataFrame(held, "memory_id int, items array<string>, status string"), limit=6)
    want = set()
    for n, items in notes:
        scored = sorted(((-len(set(items) & set(other)), m) for m, other, s in held if s == "active" and set(items) & set(other)))
        want |= {(n, m, -c) for c, m in scored[:6]}
    assert {(r.note_id, r.memory_id, r.shared) for r in got.collect()} == want


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "atlas beacon"), (2, "beacon"), (3, "nothing")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "Who is the Atlas beacon?"), (8, "the of")], "question_id int, text string")
    assert [(r.question_id, r.doc_id, r.score) for r in search.keyword_topk(docs, asked, 5, ["doc_id"]).orderBy("rank").collect()] == [(7, 1, 1.0), (7, 2, 0.5)]
    hits = spark.createDataFrame([("n", 0.25, "t", 1), ("n", 0.9, "t", 2), ("m", 0.249, "t", 3), ("z", float("nan"), "t", 4), ("w", 5.0, "t", 5), ("", 1.0, "t", 6)],
                                 "note_id string, score double, text string, ord int")
    assert sorted((r.note_id, r.score) for r in search.filter_hits(hits, order=["ord"]).collect()) == [("n", 0.9), ("w", 1.0)]
    assert search.duplicate_keys(hits).first().note_id == "n"


def test_late_facts_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 2}", i, i, at(1) + dt.timedelta(days=(i * 7) % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "fact_key string, fact_id long, arrival long, event_time timestamp")
    for part in range(3):
        df.filter((F.col("arrival") >= part * 10) & (F.col("arrival") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.fact_id, r.action) for r in memory.supersede(df.withColumn("seg", F.floor(F.col("arrival") / 4)), "fact_key", "arrival", "event_time", "fact_id", "seg").collect()}
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = jobs.guard_late_facts(stream).writeStream.format("memory").queryName("guarded").outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert {(r.fact_id, r.action) for r in spark.table("guarded").collect()} == want
    finally:
        spark.conf.unset(key)


def test_outbox_stream_is_idempotent(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "note_id string, text string").write.parquet(str(tmp_path / "in"))
    index = {}
    stream = spark.readStream.schema("note_id string, text string").parquet(str(tmp_path / "in"))
    jobs.outbox_stream(stream, lambda batch, i: index.update({r.note_id: r.text for r in batch.collect()}), str(tmp_path / "ck")).awaitTermination(60)
    assert index == {"a": "x", "b": "y"}


def test_candidates_by_identical_text(spark):
    notes = spark.createDataFrame([("n1", ["e1"], "same"), ("n2", [], "other")], "note_id string, items array<string>, content string")
    held = spark.createDataFrame([("m1", "active", ["e1"], "x"), ("m2", "active", ["e9"], "same"), ("m3", "retired", [], "same"), ("m4", "active", ["e1"], "same")],
                                 "memory_id string, status string, items array<string>, content string")
    got = [(r.note_id, r.memory_id, r.shared, r["rank"]) for r in memory.candidate_memories(notes, held).orderBy("note_id", "rank").collect()]
    assert got == [("n1", "m1", 1, 1), ("n1", "m4", 1, 2), ("n1", "m2", 0, 3)]


def test_merge_finds_the_memory_with_the_same_facts(spark):
    notes = spark.createDataFrame([("n1", "d", 0, "t", "f2"), ("n2", "d", 1, "t", "f3")], "note_id string, doc_id string, chunk_index int, content string, fact_signature string")
    known = spark.createDataFrame([("a", "t", "f1"), ("b", "t", "f2")], "memory_id string, content string, fact_signature string")
    got = {r.note_id: (r.action, r.memory_id, r.reason) for r in memory.merge_identical(notes, known=known).collect()}
    assert got["n1"][:2] == ("merge", "b") and got["n2"][0] == "add" and got["n2"][2].endswith("facts differ")


def test_model_notes_are_asked_again_with_the_error(spark):
    from marginalia.operators import extraction
    chunks = spark.createDataFrame([("d", 0, "Atlas is managed by Mara."), ("d", 1, "fails twice"), ("d", 2, "fine at once")], "doc_id string, chunk_index int, text string")

    def model(prompt):
        entity = {"name": "Atlas", "type": "Product"}
        empty = {"is_informative": True, "entities": [], "relations": [], "keywords": ["k"], "tags": [], "context": "c", "title": "t"}
        if prompt.startswith("fails"):
            raise ValueError("down")
        if prompt.startswith("Atlas"):
            return {**empty, "entities": [entity] if "Repair error: Entity names must be unique" in prompt else [entity, entity]}
        return empty

    rows = {r.chunk_index: r for r in extraction.model_notes(chunks, model, F.col("text")).collect()}
    assert len(rows) == 3 and [e.name for e in rows[0].entities] == ["Atlas"] and rows[1].is_informative is None and rows[2].keywords == ["k"]
    assert set(rows[0].asDict()) >= {"note_id", "content"} and "_prompt" not in rows[0].asDict()


def test_links_of_an_edge_leave_once_with_its_notes_or_its_memory(spark):
    """e1 goes with its memory though another note supports it, e2 with its only note; e3 keeps one of two notes."""
    tables = {"notes": spark.createDataFrame([("n1", "d1"), ("n2", "d2")], "note_id string, doc_id string"),
              "memory_sources": spark.createDataFrame([("m1", "n1"), ("m3", "n1"), ("m3", "n2")], "memory_id string, note_id string"),
              "memories": spark.createDataFrame([("m1",), ("m3",)], "memory_id string"),
              "edges": spark.createDataFrame([("e1", "m1"), ("e2", "m3"), ("e3", "m3")], "edge_id string, memory_id string"),
              "edge_sources": spark.createDataFrame([("e1", "n1"), ("e1", "n2"), ("e2", "n1"), ("e3", "n1"), ("e3", "n2")], "edge_id string, note_id string"),
              "node_sources": spark.createDataFrame([("a", "n1")], "node_id string, note_id string"), "nodes": spark.createDataFrame([("a",), ("b",)], "node_id string")}
    gone = memory.deletions(tables, "d1")
    assert sorted(map(tuple, gone["edge_sources"].collect())) == [("e1", "n1"), ("e1", "n2"), ("e2", "n1"), ("e3", "n1")]
    assert sorted(r.edge_id for r in gone["edges"].collect()) == ["e1", "e2"] and [r.memory_id for r in gone["memories"].collect()] == ["m1"]


def test_candidates_are_sought_once_for_equal_items(spark, monkeypatch):
    asked = []
    inner = memory._best_of_kinds
    monkeypatch.setattr(memory, "_best_of_kinds", lambda kinds, *rest: (asked.append(kinds.count()), inner(kinds, *rest))[1])
    notes = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(50)] + [(50, []), (51, None)], "note_id int, items array<string>")
    held = spark.createDataFrame([(i, ["a", "b"] if i == 7 else ["a"], "active") for i in range(9)], "memory_id int, items array<string>, status string")
    got = {(r.note_id, r["rank"]): (r.memory_id, r.shared) for r in memory.candidate_memories(notes, held, limit=2).collect()}
    assert asked == [4] and len(got) == 100
    assert all(got[i, 1] == ((7, 2) if i % 2 else (0, 1)) and got[i, 2] == ((0, 1) if i % 2 else (1, 1)) for i in range(50))


def test_cascade_gives_back_shuffles_step_by_step(spark, tmp_path, monkeypatch):
    lines = [(order, 1 + k, (order * 7 + k) % 40, (order * 3 + k) % 11) for order in range(60) for k in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "FOP"[k % 3]) for k in range(60)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    held = []

    def count():
        time.sleep(0.3)         # the cleaner has a thread of its own
        held.append(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size())

    def cut(df, cut=memory.cut_lineage):
        count()
        return cut(df)

    release(spark)
    time.sleep(1)
    for module in (memory, graph_queries):
        monkeypatch.setattr(module, "cut_lineage", cut)
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, row_bytes: df, raising=False)
    out = graph_queries.delete_document_cascade(spark, str(tmp_path))
    got = {r.table_name: r.n_rows for r in out.collect()}
    count()
    kept = [(p, s) for order, _, p, s in lines if order % 3 == 1]
    assert got == {"notes": 60, "memory_sources": 60, "edge_sources": 60, "node_sources": 120, "memories": len(set(kept)), "edges": len(set(kept)),
                   "memory_entities": 2 * len(set(kept)), "nodes": len({p for p, _ in kept}) + len({s for _, s in kept})}
    assert max(held) - held[0] <= 14, held
