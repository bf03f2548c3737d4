"""Memory evolution of a batch: proposals judged in arrival order, and what the accepted ones change.

A note may add to the memories, be merged into one, supersede or retire some.  What it may do depends on earlier notes of
the batch only through the memories it aims at: an accepted update, retirement or merge of several closes memories for all
later notes.  So notes that close nothing are judged at once, and those that would close something in rounds, each at the
moment when no earlier one is still undecided at any of its targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import identity as ident
from ..session import broadcast_if_small, cut_lineage
from .memory import NOTE_ORDER, blocked_reason, fact_keys, single_valued
from .ordered import running_max_before

ACTIONS = ("add", "merge", "update", "retain", "retire")
_NEVER = 1 << 62        # stands for a time that is not known to be earlier than anything


def _micros(time):
    return F.unix_micros(time)


def judged_alone(notes: DataFrame, proposals: DataFrame, memories: DataFrame, support: DataFrame, order, exclusive) -> tuple[DataFrame, DataFrame]:
    """``(judged, targets)``: every proposal against the stored memories, without regard to the other notes.

    ``judged`` has ``proposed, said, canonical, at, broken, blocked, closing`` for each note, ``targets`` its targets once each
    with ``at``, ``closes`` and the note's action.  Of conflicting rows of one note the first by position speaks.
    """
    place = F.struct(F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("target_id", F.lit("")).alias("t"))
    said = proposals.groupBy("note_id").agg(F.min(F.struct(place.alias("p"), "action", "reason")).alias("_first"))
    aimed = proposals.filter("target_id is not null").groupBy("note_id", "target_id").agg(F.min("position").alias("position"))
    live = memories.filter(F.col("status") == "active").select(
        F.col("memory_id").alias("target_id"), F.col("content").alias("_text"), F.col("fact_signature").alias("_facts"), F.col("event_time").alias("_time"))
    rows = (aimed.join(notes, "note_id").join(live, "target_id", "left").join(support.withColumnRenamed("memory_id", "target_id"), "target_id", "left"))
    when = F.col("event_time")
    flags = rows.groupBy("note_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("_text").isNull()).alias("_unknown"),
        F.bool_and(F.coalesce(when > F.col("_time"), F.lit(False))).alias("_after"),
        F.bool_and(F.col("all_timed").isNull() | F.coalesce(F.col("all_timed") & (when > F.col("last_time")), F.lit(False))).alias("_after_support"),
        F.bool_and(F.coalesce(fact_keys("fact_signature") == fact_keys("_facts"), F.lit(False))).alias("_keys"),
        F.bool_and(F.coalesce(F.col("fact_signature") == F.col("_facts"), F.lit(False))).alias("_same"),
        F.bool_and(F.coalesce(F.col("content") == F.col("_text"), F.lit(False))).alias("_texts"),
        F.min(F.struct("position", "target_id")).alias("_canon"))
    per_note = notes.join(said, "note_id").join(flags, "note_id", "left")
    action, sig, n = F.col("_first.action"), F.col("fact_signature"), F.coalesce("_n", F.lit(0))
    broken = ~F.coalesce(action.isin(*ACTIONS), F.lit(False)) | (F.coalesce("_unknown", F.lit(0)) > 0) | (action.isin("merge", "update", "retire") & (n == 0))
    blocked = blocked_reason(action, F.coalesce(sig, F.lit("")) != "", single_valued("fact_signature", exclusive), F.col("_after"), F.col("_after_support"), F.col("_keys"), F.col("_same"), F.col("_texts"))
    judged = per_note.select(
        "note_id", action.alias("proposed"), F.col("_first.reason").alias("said"), F.col("_canon.target_id").alias("canonical"), F.struct(*order, "note_id").alias("at"),
        broken.alias("broken"), blocked.alias("blocked"), n.alias("n"), "event_time", "own_last_time", "own_all_timed")
    closing = ~F.col("broken") & F.col("blocked").isNull() & (F.col("proposed").isin("update", "retire") | ((F.col("proposed") == "merge") & (F.col("n") > 1)))
    judged = cut_lineage(judged.withColumn("closing", F.coalesce(closing, F.lit(False))))
    targets = aimed.select("note_id", "target_id").join(judged.select("note_id", "at", "proposed", "closing", "canonical", "event_time", "own_last_time", "own_all_timed", "broken", "blocked"), "note_id")
    return judged, cut_lineage(targets.withColumn("closes", F.col("closing") & ((F.col("proposed") != "merge") | (F.col("target_id") != F.col("canonical")))))


def _own_times():
    """Latest time among a note's own facts in microseconds; never, when one has none; null without facts."""
    return F.when(F.col("own_all_timed"), _micros(F.col("own_last_time"))).when(F.col("own_all_timed").isNotNull(), F.lit(_NEVER))


def _outrun(targets: DataFrame, order) -> DataFrame:
    """Updates that are not later than a fact which an earlier note of the batch has merged into a target.

    Arrival is cut into segments by ranges of rows, so that the notes of one target are scanned in many tasks."""
    merges = targets.filter((F.col("proposed") == "merge") & ~F.col("closing") & ~F.col("broken") & F.col("blocked").isNull()).select(
        "target_id", "at", _own_times().alias("v"), F.lit(None).cast("string").alias("note_id"), F.lit(None).cast("long").alias("mine"))
    updates = targets.filter((F.col("proposed") == "update") & F.col("closing")).select(
        "target_id", "at", F.lit(None).cast("long").alias("v"), "note_id", _micros(F.col("event_time")).alias("mine"))
    line = merges.unionByName(updates).repartitionByRange("at")
    line = cut_lineage(line.withColumn("seg", F.spark_partition_id()))
    seen = running_max_before(line, "target_id", "seg", "at", F.col("v"), "peak")
    return seen.filter(F.col("note_id").isNotNull() & (F.col("peak") >= F.col("mine"))).select("note_id").distinct()


def _rounds(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, outrun)`` note ids among those that close something.

    In each round a note is decided when it is the earliest undecided one at all its targets; the later ones at what it
    closes fall out at once.  An update that is not later than the facts brought by an accepted merge of several falls back.
    """
    spark = targets.sparkSession
    open_ = targets.select("note_id", "target_id", "at", "closes", "proposed", "event_time", "canonical", _own_times().alias("v"))
    accepted = spark.createDataFrame([], targets.select("note_id").schema)
    outrun, brought = accepted, spark.createDataFrame([], "target_id string, t long")
    while not open_.isEmpty():
        first = open_.groupBy("target_id").agg(F.min("at").alias("_first"))
        ready = open_.join(first, "target_id").groupBy("note_id").agg(F.bool_and(F.col("at") == F.col("_first")).alias("r")).filter("r").select("note_id")
        now = cut_lineage(open_.join(ready, "note_id", "left_semi"))
        late = now.filter("proposed = 'update'").join(brought.groupBy("target_id").agg(F.max("t").alias("t")), "target_id").filter(
            F.col("t") >= _micros(F.col("event_time"))).select("note_id").distinct()
        late = cut_lineage(late)
        good = now.join(late, "note_id", "left_anti")
        closed = good.filter("closes").select("target_id")
        lost = open_.join(closed.distinct(), "target_id", "left_semi").select("note_id").distinct()
        accepted = cut_lineage(accepted.union(good.select("note_id").distinct()))
        outrun = outrun.union(late)
        brought = cut_lineage(brought.union(good.filter("proposed = 'merge'").select(F.col("canonical").alias("target_id"), F.col("v").alias("t"))))
        open_ = cut_lineage(open_.join(ready, "note_id", "left_anti").join(lost, "note_id", "left_anti"))
    return accepted, outrun


def decide(notes: DataFrame, proposals: DataFrame, memories: DataFrame, support: DataFrame, order=NOTE_ORDER,
           exclusive=config.EXCLUSIVE_RELATIONS) -> DataFrame:
    """Judge proposals of an injected model against the stored memories, note after note in arrival order.

    notes      note_id, content, fact_signature, event_time, *order [, last_time, all_timed: of the note's own facts]
    proposals  note_id, action, target_id (null without target), position, reason
    support    memory_id, last_time, all_timed: event times of the facts behind a memory; no row where there are none

    One row for each note with a proposal: ``action`` after the guards, ``proposed``, ``reason``, ``memory_id`` (the note's
    memory) and ``canonical`` (first target).  A proposal that a guard stops is an ``add`` with the guard's reason.  One that
    names a memory unknown, inactive or closed by an earlier note, or none where one is needed, is ``rejected``; so is an
    unknown action.
    """
    support = support.select("memory_id", "last_time", "all_timed")
    own = [(F.col(c) if c in notes.columns else F.when(F.coalesce("fact_signature", F.lit("")) != "", v)).alias(f"own_{c}") for c, v in (
        ("last_time", F.col("event_time")), ("all_timed", F.col("event_time").isNotNull()))]
    judged, targets = judged_alone(notes.select("note_id", "content", "fact_signature", "event_time", *order, *own), proposals, memories, support, order, exclusive)
    outrun = cut_lineage(_outrun(targets, order))
    closing = targets.filter("closing").join(outrun, "note_id", "left_anti")
    accepted, later = _rounds(cut_lineage(closing))
    blocked = outrun.union(later).withColumn("_outrun", F.lit(True))
    won = accepted.withColumn("_won", F.lit(True))
    closed = targets.filter("closes").join(accepted, "note_id", "left_semi").groupBy("target_id").agg(F.min("at").alias("_closed"))
    missed = targets.join(closed, "target_id").filter(F.col("_closed") < F.col("at")).select("note_id").distinct().withColumn("_late", F.lit(True))
    rows = judged.join(blocked, "note_id", "left").join(won, "note_id", "left").join(missed, "note_id", "left")
    rejected = F.col("broken") | F.coalesce("_late", F.lit(False)) | (F.col("closing") & F.col("_won").isNull() & F.col("_outrun").isNull())
    stopped = F.coalesce("blocked", F.when(F.col("_outrun"), F.lit("Update blocked: every supported target fact must be earlier")))
    rows = rows.withColumn("action", F.when(rejected, "rejected").when(stopped.isNotNull(), "add").otherwise(F.col("proposed")))
    rows = rows.withColumn("reason", F.when(F.col("action") == "rejected", "Unknown target memory").otherwise(F.coalesce(stopped, "said")))
    return rows.withColumn("memory_id", F.when(F.col("action") == "merge", F.col("canonical")).when(
        F.col("action") != "rejected", ident.memory_id("note_id"))).select("note_id", "action", "proposed", "reason", "memory_id", "canonical")


def closings(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """``(memory_id, by, status)``: memories that accepted decisions close, and the memory in their place."""
    hits = (decisions.filter("action in ('merge', 'update', 'retire')").join(proposals.select("note_id", "target_id").filter("target_id is not null").distinct(), "note_id")
            .filter((F.col("action") != "merge") | (F.col("target_id") != F.col("canonical"))))
    return hits.select(F.col("target_id").alias("memory_id"), F.col("memory_id").alias("by"),
                       F.when(F.col("action") == "update", "superseded").otherwise("retired").alias("status"), "note_id")


def holders(closed: DataFrame) -> DataFrame:
    """``(memory_id, holder)``: the memory that ends up with the sources of a retired one.

    A memory retired in favour of one that is itself retired later in the batch passes its sources on; pointers are doubled
    until none moves."""
    links = cut_lineage(closed.filter("status = 'retired'").select("memory_id", F.col("by").alias("holder")))
    while True:
        hop = links.select(F.col("memory_id").alias("holder"), F.col("holder").alias("_next"))
        after = cut_lineage(links.join(hop, "holder", "left").select("memory_id", F.coalesce("_next", "holder").alias("holder"), F.col("_next").isNotNull().alias("moved")))
        links = after.drop("moved")
        if after.filter("moved").isEmpty():
            return links


def apply_decisions(tables: dict[str, DataFrame], decisions: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """Effects of accepted decisions on existing memories, their sources and their notes: the whole tables after them."""
    changed, gone = effects(tables, decisions, proposals)
    out = dict(tables)
    for name, rows in changed.items():
        key = ["memory_id", "note_id"] if name == "memory_sources" else ["memory_id"] if name == "memories" else ["note_id"]
        if name == "revisions":
            out[name] = tables[name].unionByName(rows) if name in tables else rows
        elif name in tables:
            out_keys = rows.select(*key) if name not in gone else rows.select(*key).union(gone[name].select(*key))
            out[name] = tables[name].join(out_keys.distinct(), key, "left_anti").unionByName(rows.select(*tables[name].columns))
    return out


def effects(tables: dict[str, DataFrame], decisions: DataFrame, proposals: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """``(rows, gone)`` that accepted decisions put into and take out of memories, memory_sources, notes and revisions.

    Superseded and retired memories stay as history, a copy of each touched memory as it was goes to ``revisions``.  Sources
    and notes of a retired memory move to the one that holds them at the end of the batch; notes of a superseded one leave the
    vector index.  Only touched rows are returned.
    """
    closed = cut_lineage(closings(decisions, proposals))
    ends = holders(closed)
    few = broadcast_if_small(closed.select("memory_id", F.col("by").alias("_by"), F.col("status").alias("_status")), 250)
    merged = decisions.filter("action = 'merge'").select(F.col("canonical").alias("memory_id"), "note_id")
    touched = cut_lineage(closed.select("memory_id", "note_id").union(merged).distinct())
    memories = tables["memories"]
    columns = memories.columns
    hit = memories.join(few, "memory_id")
    rows = {"memories": hit.withColumn("status", F.col("_status")).withColumn("replacement_id", F.col("_by")).select(*columns),
            "revisions": memories.join(broadcast_if_small(touched, 250), "memory_id").select(*columns, "note_id")}
    moved = tables["memory_sources"].join(broadcast_if_small(ends, 200), "memory_id")
    gone = {"memory_sources": moved.select("memory_id", "note_id")}
    others = [c for c in tables["memory_sources"].columns if c not in ("memory_id", "note_id")]
    rows["memory_sources"] = moved.select(F.col("holder").alias("memory_id"), "note_id", *others).dropDuplicates(["memory_id", "note_id"])
    # a note's memory is that of its end; the end tells whether it leaves the index
    state = closed.filter("status = 'superseded'").select(F.col("memory_id").alias("_end"), F.lit(True).alias("_gone"))
    fate = (closed.select("memory_id").join(ends, "memory_id", "left").select("memory_id", F.coalesce("holder", "memory_id").alias("_end"), F.col("holder").isNotNull().alias("_moved"))
            .join(state, "_end", "left"))
    flagged = tables["notes"].join(broadcast_if_small(cut_lineage(fate), 200), "memory_id")
    out = F.coalesce("_gone", F.lit(False))
    rows["notes"] = flagged.withColumn("memory_id", F.col("_end")).withColumn("vector_pending", F.when(out, F.lit(False)).otherwise(
        F.col("_moved") | F.col("vector_pending"))).withColumn("vector_delete_pending", out | F.col("vector_delete_pending")).select(*tables["notes"].columns)
    return rows, gone


def model_proposals(complete_json):
    """Proposals by an injected model, called on the executors: ``complete_json(prompt) -> dict`` with action, target_ids, reason.

    The returned function takes ``(note_id, content, candidates)`` (candidates: array of structs of stored memories) and gives
    ``(note_id, action, target_id, position, reason)``.  A reply of another form, or with an id that was not supplied, has no
    action and is rejected by ``decide``.
    """
    def rows_of(note_id, prompt, ids):
        try:
            reply = complete_json(prompt)
            targets, action, reason = reply["target_ids"], reply["action"], reply["reason"]
            if not isinstance(targets, list) or not isinstance(reason, str) or any(t not in ids for t in targets):
                raise ValueError("unusable reply")
        except Exception:
            return [(note_id, None, None, 0, None)]
        return [(note_id, action, t, place, reason) for place, t in enumerate(dict.fromkeys(targets))] or [(note_id, action, None, 0, reason)]

    def propose(asked: DataFrame) -> DataFrame:
        prompts = asked.select("note_id", F.to_json(F.struct(F.struct("note_id", "content").alias("new_note"), F.col("candidates").alias("memories"))).alias("prompt"),
                               F.transform("candidates", lambda m: m["memory_id"]).alias("ids"))

        def call(frames):
            import pandas as pd
            for frame in frames:
                made = [r for n, p, ids in zip(frame["note_id"], frame["prompt"], frame["ids"]) for r in rows_of(n, p, set(ids))]
                yield pd.DataFrame(made, columns=["note_id", "action", "target_id", "position", "reason"]).astype({"position": "int32"})
        return cut_lineage(prompts.mapInPandas(call, "note_id string, action string, target_id string, position int, reason string"))   # asked once
    return propose
