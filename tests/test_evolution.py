"""Decisions of a batch and their effects against a note-by-note reading of the rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.functions import identity as ident
from marginalia.operators import evolution

S = "\x1f"
DAY = lambda n: None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
NOTES = "note_id string, content string, fact_signature string, event_time timestamp, doc_id string, chunk_index int"
MEMORIES = "memory_id string, content string, fact_signature string, event_time timestamp, status string, replacement_id string"


def one_by_one(notes, proposals, memories, support, ids):
    """notes in order: (id, content, facts, day); proposals {id: (action, targets, reason)}; memories {id: [content, facts, day, status]};
    support {id: [days of facts]}."""
    out, sources = [], {m: {f"src-{m}"} for m in memories}
    ended = {}
    for note, content, facts, day in notes:
        action, targets, said = proposals[note]
        targets = list(dict.fromkeys(targets))
        active = all(t in memories and memories[t][3] == "active" for t in targets)
        if action not in ("add", "merge", "update", "retain", "retire") or not active or (action in ("merge", "update", "retire") and not targets):
            out.append((note, "rejected", "Unknown target memory", None))
            continue
        key = lambda sig: {f.rsplit(S, 1)[0] for f in sig.split("\x1e") if f}
        reason = None
        if action == "update":
            if not facts or any(f.split(S)[1] not in ("managed_by", "led_by") for f in facts.split("\x1e")):
                reason = "Update blocked: predicate is not configured as single-valued"
            elif day is None or any(memories[t][2] is None or day <= memories[t][2] for t in targets):
                reason = "Update blocked: explicit later event time required"
            elif any(d is None or day <= d for t in targets for d in support[t]):
                reason = "Update blocked: every supported target fact must be earlier"
            elif any(key(memories[t][1]) != key(facts) for t in targets):
                reason = "Update blocked: different fact subjects or predicates"
        if action in ("merge", "retire") and (any(memories[t][1] != facts for t in targets) or (not facts and any(memories[t][0] != content for t in targets))):
            reason = "Consolidation blocked: facts differ"
        if reason:
            action, targets, said = "add", [], reason
        mine = targets[0] if action == "merge" else ids[note]
        if action != "merge":
            sources[mine] = set()
        sources.setdefault(mine, set()).add(note)
        if facts and action == "merge":
            support[mine] = support[mine] + [day]
        if action in ("merge", "update", "retire"):
            for t in targets:
                if t == mine:
                    continue
                memories[t][3] = "superseded" if action == "update" else "retired"
                ended[t] = mine
                if action != "update":
                    sources[mine] |= sources[t]
                    if action == "merge":
                        support[mine] = support[mine] + support[t]
                    sources[t] = set()
        out.append((note, action, said, mine))
    return out, sources, ended


def made_batch(seed, n_memories=7, n_notes=60):
    rng = random.Random(seed)
    boss = lambda w: S.join((f"atlas{seed}", "managed_by", w))
    memories, support = {}, {}
    for i in range(n_memories):
        m, day = f"m{seed}-{i}", rng.choice([0, 3, 5, None])
        memories[m] = [f"text {i % 3}", rng.choice([boss("a"), boss("a"), boss("b"), S.join(("x", "likes", "y")), ""]), day, rng.choice(["active"] * 6 + ["retired"])]
        support[m] = [day] if memories[m][1] else []
    notes, proposals = [], {}
    for i in range(n_notes):
        note = f"n{seed}-{i:03d}"
        notes.append((note, f"text {rng.randrange(3)}", rng.choice([boss("a"), boss("a"), boss("b"), S.join(("x", "likes", "y")), ""]), rng.choice([None, *range(12)])))
        targets = rng.sample(sorted(memories), rng.choice([0, 1, 1, 1, 2, 3])) + rng.choice([[], [], [], [], ["nowhere"]])
        same = [m for m in memories if memories[m][1] == notes[-1][2]]
        action = rng.choice(["add", "merge", "merge", "update", "update", "retain", "retire", "erase"])
        if action in ("merge", "retire") and same and rng.random() < 0.7:
            targets = rng.sample(same, min(len(same), rng.choice([1, 1, 1, 2])))
        proposals[note] = (action, targets, f"said {i}")
    return notes, proposals, memories, support


def test_a_batch_is_judged_as_note_by_note(spark):
    batches = [made_batch(seed) for seed in range(12)]
    notes = [n for b in batches for n in b[0]]
    frame = spark.createDataFrame([(n, c, f, DAY(d), n.split("-")[0], int(n.split("-")[1])) for n, c, f, d in notes], NOTES).repartition(5)
    rows = [(n, a, t, p, r) for b in batches for n, (a, ts, r) in b[1].items() for p, t in enumerate(ts or [None])]
    proposals = spark.createDataFrame(rows, "note_id string, action string, target_id string, position int, reason string").repartition(3)
    memories = spark.createDataFrame([(m, c, f, DAY(d), s, None) for b in batches for m, (c, f, d, s) in b[2].items()], MEMORIES)
    support = spark.createDataFrame([(m, DAY(max((d for d in ds if d is not None), default=None)), None not in ds) for b in batches for m, ds in b[3].items() if ds],
                                    "memory_id string, last_time timestamp, all_timed boolean")
    sources = [(m, f"src-{m}") for b in batches for m in b[2]]
    ids = {r.note_id: r.i for r in frame.select("note_id", ident.memory_id("note_id").alias("i")).collect()}
    decided = evolution.decide(frame, proposals, memories, support)
    got = {r.note_id: (r.action, r.reason, r.memory_id) for r in decided.collect()}
    want, held, ended = [], {}, {}
    for b in batches:
        out, src, end = one_by_one(b[0], b[1], b[2], b[3], ids)
        want += out
        held.update(src)
        ended.update(end)
    assert got == {n: (a, r, m) for n, a, r, m in want}
    assert {a for a, _, _ in got.values()} == {"add", "merge", "update", "retain", "retire", "rejected"} and len({r for _, r, _ in got.values() if "blocked" in r}) == 5
    # effects: states, pointers, sources and notes
    old_notes = spark.createDataFrame([(s, m, False, False) for m, s in sources], "note_id string, memory_id string, vector_pending boolean, vector_delete_pending boolean")
    new = [(n, m, True, False) for n, a, _, m in want if m]
    born = spark.createDataFrame([(ids[n], c, f, DAY(d), "active", None) for n, c, f, d in notes if got[n][2] == ids[n]], MEMORIES)
    tables = {"memories": memories.unionByName(born), "notes": old_notes.union(spark.createDataFrame(new, old_notes.schema)),
              "memory_sources": spark.createDataFrame(sources + [(m, n) for n, m, _, _ in new], "memory_id string, note_id string")}
    out = evolution.apply_decisions(tables, decided, proposals)
    after = {r.memory_id: (r.status, r.replacement_id) for r in out["memories"].collect()}
    for b in batches:
        for m, (_, _, _, status) in b[2].items():
            assert after[m] == (status, ended.get(m)), m
    final = {}
    for r in out["memory_sources"].collect():
        final.setdefault(r.memory_id, set()).add(r.note_id)
    assert final == {m: s for m, s in held.items() if s}
    status = {m: v[3] for b in batches for m, v in b[2].items()}
    for r in out["notes"].collect():
        assert r.note_id in held[r.memory_id]
        assert r.vector_delete_pending == (status.get(r.memory_id) == "superseded") and not (r.vector_delete_pending and r.vector_pending)
    assert {r.memory_id for r in out["revisions"].collect()} == set(ended) | {m for _, a, _, m in want if a == "merge"}


def test_a_hot_memory_needs_few_rounds(spark):
    """Thousands of notes at one memory: merges, then one update that closes it for the rest."""
    n = 3000
    boss = S.join(("atlas", "managed_by", "a"))
    notes = spark.range(n).select(F.format_string("n%05d", "id").alias("note_id"), F.lit("t").alias("content"), F.lit(boss).alias("fact_signature"),
                                  F.lit(DAY(5)).alias("event_time"), F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"))
    notes = notes.withColumn("event_time", F.when(F.col("chunk_index") % 100 == 50, F.lit(DAY(4))).when(F.col("chunk_index") == 2000, F.lit(DAY(9))).otherwise(F.col("event_time")))
    action = F.when((F.col("chunk_index") % 100 == 50) | (F.col("chunk_index") == 2000), "update").otherwise("merge")
    proposals = notes.select("note_id", action.alias("action"), F.lit("m").alias("target_id"), F.lit(0).alias("position"), F.lit("why").alias("reason"))
    memories = spark.createDataFrame([("m", "t", boss, DAY(0), "active", None)], MEMORIES)
    support = spark.createDataFrame([("m", DAY(0), True)], "memory_id string, last_time timestamp, all_timed boolean")
    counts = {r.action: r["count"] for r in evolution.decide(notes, proposals, memories, support).groupBy("action").count().collect()}
    # twenty early updates are stopped by merged facts of day 5; note 2000 closes the memory for the 999 after it
    assert counts == {"merge": 1980, "add": 20, "update": 1, "rejected": 999}


def test_unusable_replies_are_rejected(spark):
    asked = spark.createDataFrame([("n1", "a", [("m1",)]), ("n2", "bad", [("m1",)]), ("n3", "alien", [("m1",)]), ("n4", "none", [])],
                                  "note_id string, content string, candidates array<struct<memory_id:string>>")

    def model(prompt):
        if '"bad"' in prompt:
            return ["no"]
        return {"action": "merge" if '"a"' in prompt else "add", "target_ids": ["m1", "m1"] if '"a"' in prompt else ["m9"] if '"alien"' in prompt else [], "reason": "r"}
    got = {r.note_id: (r.action, r.target_id) for r in evolution.model_proposals(model)(asked).collect()}
    assert got == {"n1": ("merge", "m1"), "n2": (None, None), "n3": (None, None), "n4": ("add", None)}
