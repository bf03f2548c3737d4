"""Files to notes, graph, memory and the vector outbox, as one batch."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import config
from ..functions import identity as ident, text as tx
from ..functions.rows import spread_array
from ..operators import adjacency, chunking, cleaning, evolution, extraction, graph, memory, tables as tb
from ..sources import files as fl
from ..session import broadcast_if_small, cut_lineage
from ..sources.store import Change, Store
from .ask import Memory

_EMPTY = {
    "notes": "note_id string, doc_id string, chunk_index int, content_hash string, content string, context string, title string, "
             "section string, page int, content_type string, source_type string, source_filename string, source_time string, "
             "keywords array<string>, tags array<string>, memory_id string, vector_pending boolean, vector_delete_pending boolean",
    "memories": "memory_id string, content string, context string, fact_signature string, event_time timestamp, status string, replacement_id string",
    "memory_sources": "memory_id string, note_id string, last_time timestamp, all_timed boolean",
    "memory_entities": "memory_id string, node_id string",
    "nodes": "node_id string, name string, entity_type string",
    "surface_forms": "node_id string, name string, entity_type string",
    "node_sources": "node_id string, note_id string",
    "edges": "edge_id string, source_node_id string, target_node_id string, relation_type string, memory_id string",
    "edge_sources": "edge_id string, note_id string",
    "events": "note_id string, memory_id string, action string, reason string, proposed string, recorded_at timestamp",
    "revisions": "memory_id string, content string, context string, fact_signature string, event_time timestamp, status string, replacement_id string, note_id string",
    "documents": "doc_id string, content_hash string, status string, cleanup_pending boolean",
    "vector_deletes": "note_id string, doc_id string",
    "support": "kind string, id string, n_sources long",
}
#: Tables that are read by bucket: the store parts their files by that column.
PARTITIONED = {"adjacency": "bucket"}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in _EMPTY.items()}


def stored_tables(store: Store) -> dict[str, DataFrame]:
    """The committed tables, empty where absent, with all columns of today's form (null where a store is older)."""
    out = empty_tables(store.spark)
    for name, held in store.tables().items():
        out[name] = held if name not in out else held.select(
            *[F.col(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in out[name].schema], *[
                c for c in held.columns if c not in out[name].columns])
    return out


def chunk_files(documents: DataFrame, describe=None) -> DataFrame:
    """Chunks of parsed documents: text, then tables, then figures, numbered per document."""
    pages = spread_array(documents, ["doc_id", "suffix"], "pages", "text", "_at").select(
        "doc_id", "suffix", (F.col("_at") + 1).alias("page"), "text")
    flat = chunking.chunk_documents(cleaning.clean_documents(pages.filter("suffix <> 'pdf'").drop("suffix"))).select(
        "doc_id", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("page"), F.col("chunk_index").cast("long").alias("at"), "section", "text",
        F.lit(False).alias("is_numeric_table"))
    paged = chunking.chunk_pages(cleaning.clean_page_texts(pages.filter("suffix = 'pdf'").drop("suffix"))).select(
        "doc_id", F.lit(0).alias("kind"), "page", F.col("position").cast("long").alias("at"), "section", "text", F.lit(False).alias("is_numeric_table"))
    where = chunking.page_sections(pages.drop("suffix")).withColumnRenamed("section", "_near")
    merged = documents.select("doc_id", tb.merge_continuations(F.col("tables").cast(f"array<{tb.TABLE}>")).alias("t"))
    each = spread_array(merged, ["doc_id"], "t", "t", "table_at").select(
        "doc_id", "table_at", "t.rows", "t.caption", "t.page", "t.section")
    cells = tb.table_pieces(each).join(where, ["doc_id", "page"], "left").select(
        "doc_id", F.lit(1).alias("kind"), "page", (F.col("table_at").cast("long") * 10_000_000 + F.col("part")).alias("at"),
        F.coalesce("section", "_near").alias("section"), "text", F.col("is_numeric").alias("is_numeric_table"))
    parts = [flat, paged, cells]
    if describe is not None:
        told = fl.describe_figures(documents, describe).join(where, ["doc_id", "page"], "left")
        parts.append(told.select("doc_id", F.lit(2).alias("kind"), "page", F.col("position").cast("long").alias("at"), F.col("_near").alias("section"),
                                 "text", F.lit(False).alias("is_numeric_table")))
    whole = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("kind", F.col("page").asc_nulls_first(), "at")) - 1
    kind = F.element_at(F.array(*map(F.lit, ("text", "table", "image_description"))), F.col("kind") + 1)
    return whole.join(documents.select("doc_id", "source_filename", "content_hash"), "doc_id").select(
        "doc_id", place.alias("chunk_index"), "text", "source_filename", "content_hash", F.lit(config.PARSER_VERSION).alias("parser_version"),
        kind.alias("content_type"), "page", "section", "is_numeric_table", F.lit(False).alias("is_ocr"))


def judge(current: dict[str, DataFrame], ready: DataFrame, named: DataFrame, outcome: DataFrame, propose) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(outcome, decisions, proposals)`` with what ``propose`` says about notes that share an entity with a stored memory.

    ``outcome`` is what identical texts give.  A note without an identical text is shown to ``propose`` with its candidates, the
    stored memories that share most of its entities; merges with stored memories of the same text are judged with them, in
    arrival order.  A note that would merge into a memory which an earlier one has closed stands for itself instead, and so do
    the copies of a note whose proposal was rejected; copies of a note that was merged go where it went.
    """
    order = list(memory.NOTE_ORDER)
    active = current["memories"].filter("status = 'active'")
    leads = outcome.filter("action = 'add' and reason = 'Preserve distinct evidence'").select("note_id")
    items = named.groupBy("note_id").agg(F.collect_set("node_id").alias("items"))
    links = current["memory_entities"].join(broadcast_if_small(cut_lineage(named.select("node_id").distinct()), 100), "node_id", "left_semi")
    held = links.groupBy("memory_id").agg(F.collect_set("node_id").alias("items"))
    wanted = ready.join(leads, "note_id", "left_semi").join(items, "note_id").select("note_id", "items")
    near = cut_lineage(memory.candidate_memories(wanted, active.select("memory_id", "status").join(held, "memory_id")))
    told = active.select("memory_id", "content", "context", "fact_signature", "event_time").join(broadcast_if_small(near, 200), "memory_id")
    shown = told.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(
        "memory_id", "content", "context", "fact_signature", "event_time").alias("m")))), lambda x: x["m"]).alias("candidates"))
    said = cut_lineage(propose(ready.select("note_id", "content").join(shown, "note_id")))
    exact = outcome.filter("action = 'merge'").join(active.select("memory_id"), "memory_id", "left_semi").select(
        "note_id", F.lit("merge").alias("action"), F.col("memory_id").alias("target_id"), F.lit(0).alias("position"), F.lit("Identical source text").alias("reason"))
    proposals = cut_lineage(said.select("note_id", "action", "target_id", F.col("position").cast("int").alias("position"), "reason").unionByName(exact))
    aimed = cut_lineage(proposals.select(F.col("target_id").alias("memory_id")).filter("memory_id is not null").distinct())
    support = current["memory_sources"].join(broadcast_if_small(aimed, 100), "memory_id", "left_semi").groupBy("memory_id").agg(
        F.max("last_time").alias("last_time"), F.bool_and("all_timed").alias("all_timed"))
    decisions = cut_lineage(evolution.decide(ready, proposals, active, support, order))
    verdict = decisions.select("note_id", F.col("action").alias("_a"), F.col("reason").alias("_r"), F.col("memory_id").alias("_m"), "proposed")
    # copies of a judged note point at the memory that it would have been
    lead = decisions.join(leads, "note_id", "left_semi").select(ident.memory_id("note_id").alias("memory_id"), F.col("action").alias("_lead"), F.col("memory_id").alias("_end"))
    both = outcome.drop("proposed").join(verdict, "note_id", "left").join(lead, "memory_id", "left").withColumn("_copy", F.col("_a").isNull() & F.col("_lead").isNotNull())
    both = cut_lineage(both.withColumn("_alone", ((F.col("action") == "merge") & (F.col("_a") == "rejected")) | (F.col("_copy") & (F.col("_lead") == "rejected"))))
    again = memory.merge_identical(ready.join(both.filter("_alone").select("note_id"), "note_id", "left_semi"), order).select(
        "note_id", F.col("memory_id").alias("_m2"), F.col("action").alias("_a2"), F.col("reason").alias("_r2"))
    moved = F.col("_copy") & (F.col("_lead") == "merge")
    out = both.join(again, "note_id", "left").select(
        "note_id", F.coalesce("_m2", F.when(moved, F.col("_end")), "_m", "memory_id").alias("memory_id"), F.coalesce("_a2", "_a", "action").alias("action"),
        F.coalesce("_r2", "_r", "reason").alias("reason"), "fact_signature", "event_time", F.when(F.coalesce("_a2", F.lit("")) == "", F.col("proposed")).alias("proposed"))
    return cut_lineage(out), decisions, proposals


def integrate(current: dict[str, DataFrame], notes: DataFrame, propose=None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """``(added, moved_out, rejected)``: rows that valid, informative notes put into the tables, sources that leave a stored
    memory, and notes whose proposal was rejected; known notes are left out.  ``propose`` is described at ``judge``."""
    fresh = notes.join(current["notes"].select("note_id"), "note_id", "left_anti")
    # of repeated notes the first by document and chunk stays
    firsts = fresh.groupBy("note_id").agg(F.min(F.struct(*memory.NOTE_ORDER)).alias("_first"))
    fresh = fresh.join(firsts, "note_id").filter(F.struct(*memory.NOTE_ORDER) == F.col("_first")).drop("_first").dropDuplicates(["note_id"])
    order = list(memory.NOTE_ORDER)
    mentions = spread_array(fresh, ["note_id", *order], "entities", "e").select(
        "note_id", *order, F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    # the outcome per mention, fact and note is small and feeds every table: fix it once
    resolved = cut_lineage(memory.resolve_entities(mentions, known=current["surface_forms"]))
    named = resolved.select("note_id", "name", "node_id")
    made = memory.nodes_from_mentions(resolved.filter("is_new")).select("node_id", "name", "entity_type")
    forms = resolved.select("node_id", "name", F.col("type").alias("entity_type")).distinct()
    facts = spread_array(fresh, ["note_id"], "relations", "r").select(
        "note_id", F.col("r.subject").alias("subject"), F.col("r.relation").alias("relation"), F.col("r.object").alias("object"))
    for role, column in (("subject", "source_node_id"), ("object", "target_node_id")):
        facts = facts.join(named.select("note_id", F.col("name").alias(role), F.col("node_id").alias(column)), ["note_id", role])
    facts = cut_lineage(facts)
    triple = F.concat_ws("\x1f", "source_node_id", "relation", "target_node_id")
    signed = facts.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set(triple)), "\x1e").alias("fact_signature"))
    times = F.transform("relations", lambda r: tx.aware_timestamp(r["event_time"]))
    ready = fresh.join(signed, "note_id", "left").withColumn("fact_signature", F.coalesce("fact_signature", F.lit(""))).withColumn(
        "event_time", memory.event_time(F.col("relations"))).withColumn("last_time", F.array_max(times)).withColumn(
        "all_timed", F.when(F.size("relations") > 0, F.forall(times, lambda t: t.isNotNull())))
    held = current["memories"].filter("status = 'active'").select("memory_id", "content", "fact_signature")
    outcome = cut_lineage(memory.merge_identical(ready, order, held).select(
        "note_id", "memory_id", "action", "reason", "fact_signature", "event_time", F.lit(None).cast("string").alias("proposed")))
    decisions = None
    if propose is not None:
        outcome, decisions, proposals = judge(current, ready, named, outcome, propose)
    rejected = outcome.filter("action = 'rejected'").join(fresh.select("note_id", "doc_id"), "note_id").select("note_id", "doc_id", "reason")
    outcome = outcome.filter("action <> 'rejected'")
    merged = fresh.join(outcome, "note_id")
    owner = outcome.select("note_id", "memory_id")
    # names and links only of notes that are taken
    named = named.join(owner.select("note_id"), "note_id", "left_semi")
    made = made.join(named.select("node_id").distinct(), "node_id", "left_semi")
    forms = forms.join(named.select("node_id", "name").distinct(), ["node_id", "name"], "left_semi")
    born = merged.filter("action <> 'merge'").select("memory_id", "content", "context", "fact_signature", "event_time",
                                                  F.lit("active").alias("status"), F.lit(None).cast("string").alias("replacement_id"))
    linked = facts.join(owner, "note_id")
    edge_rows = linked.select(ident.edge_id("source_node_id", "relation", "target_node_id", "memory_id").alias("edge_id"),
                              "source_node_id", "target_node_id", F.upper("relation").alias("relation_type"), "memory_id", "note_id")
    stored = merged.withColumn("vector_pending", F.lit(True)).withColumn("vector_delete_pending", F.lit(False))
    blank = {f.name: f.dataType for f in current["notes"].schema}
    added = {
        "notes": stored.select(*[F.col(c).cast(t) if c in stored.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]),
        "memories": born, "memory_sources": owner.join(ready.select("note_id", "last_time", "all_timed"), "note_id"),
        "memory_entities": named.join(owner, "note_id").select("memory_id", "node_id").distinct(),
        "nodes": made, "surface_forms": forms, "node_sources": named.select("node_id", "note_id").distinct(),
        "edges": edge_rows.drop("note_id").distinct(), "edge_sources": edge_rows.select("edge_id", "note_id").distinct(),
        "events": outcome.select("note_id", "memory_id", "action", "reason", "proposed", F.current_timestamp().alias("recorded_at")),
    }
    moved_out = current["memory_sources"].select(*memory.KEYS["memory_sources"]).limit(0)
    if decisions is not None:
        fixed = {name: cut_lineage(added[name].select(*current[name].columns)) for name in ("memories", "memory_sources", "notes")}
        rows, gone = evolution.effects({name: current[name].unionByName(df) for name, df in fixed.items()}, decisions, proposals)
        away = cut_lineage(gone["memory_sources"])
        moved_out = away.join(current["memory_sources"].select(*away.columns), away.columns, "left_semi")
        added["memories"] = fixed["memories"].unionByName(rows["memories"])
        added["notes"] = replaced(fixed["notes"], cut_lineage(rows["notes"]), None, "note_id")
        added["memory_sources"] = cut_lineage(fixed["memory_sources"].join(away, away.columns, "left_anti").unionByName(rows["memory_sources"]))
        added["revisions"] = rows["revisions"]
        # the edges of a memory that took over sources stand on all of them
        heirs = cut_lineage(rows["memory_sources"].select("memory_id").union(decisions.filter("action in ('merge', 'retire')").select("memory_id")).distinct())
        edges = current["edges"].select("edge_id", "memory_id").unionByName(edge_rows.select("edge_id", "memory_id")).distinct().join(broadcast_if_small(heirs, 100), "memory_id", "left_semi")
        behind = current["memory_sources"].select("memory_id", "note_id").join(moved_out, ["memory_id", "note_id"], "left_anti").unionByName(added["memory_sources"].select("memory_id", "note_id"))
        added["edge_sources"] = added["edge_sources"].unionByName(edges.join(behind, "memory_id").select("edge_id", "note_id")).distinct()
    # what is there already by its key is not added again
    for name in ("memory_entities", "nodes", "surface_forms", "node_sources", "edges", "edge_sources", "memory_sources"):
        rows, key = added[name].dropDuplicates(list(memory.KEYS[name])), list(memory.KEYS[name])
        added[name] = cut_lineage(rows.select(*current[name].columns).join(current[name].select(*key), key, "left_anti"))
    return {name: rows.select(*current[name].columns) for name, rows in added.items()}, moved_out, rejected


def neighbourhoods(edges: DataFrame, memories: DataFrame, nodes: DataFrame, touched: DataFrame) -> DataFrame:
    """Adjacency of the ``touched`` nodes (``here``), from the active edges at them."""
    few = broadcast_if_small(touched, 100)
    near = (edges.join(few.select(F.col("here").alias("source_node_id"), F.lit(True).alias("_s")), "source_node_id", "left")
            .join(few.select(F.col("here").alias("target_node_id"), F.lit(True).alias("_t")), "target_node_id", "left").filter("_s or _t"))
    near = cut_lineage(graph.active_edges(near.select(*edges.columns), memories))
    ends = near.select(F.col("source_node_id").alias("node_id")).union(near.select("target_node_id")).distinct()
    names = nodes.select("node_id", "name").join(broadcast_if_small(ends, 100), "node_id", "left_semi")
    return adjacency.adjacency(near, names, ["edge_id"]).join(few, "here", "left_semi")


def changes_of(current: dict[str, DataFrame], added: dict[str, DataFrame], gone: dict[str, DataFrame], moved_out: DataFrame | None = None) -> dict[str, Change]:
    """What a commit writes: rows put in and keys taken out of each table, support counts and neighbourhoods that moved.
    ``moved_out`` are sources that go on under another memory."""
    out = {}
    for name in {*added, *gone} - {"support"}:
        key = memory.KEYS[name]
        out[name] = Change(key, added.get(name), gone[name].select(*key) if name in gone else None)
    # support: what the deletions left, raised by the new links
    raised = memory.support_counts(added).withColumnRenamed("n_sources", "n_added")
    ids = [raised.select("kind", "id")]
    before = current["support"]
    if gone:
        lowered = gone["support"].withColumnRenamed("n_sources", "n_left")
        before = before.join(broadcast_if_small(lowered, 150), ["kind", "id"], "left").select("kind", "id", F.coalesce("n_left", "n_sources").alias("n_sources"))
        ids.append(gone["support"].select("kind", "id"))
    if moved_out is not None:
        key = memory.KEYS["memory_sources"]
        out["memory_sources"].gone = moved_out if out["memory_sources"].gone is None else out["memory_sources"].gone.unionByName(moved_out)
        less = memory.support_counts({"memory_sources": moved_out.select(*key)}).withColumnRenamed("n_sources", "n_less")
        ids.append(less.select("kind", "id"))
        before = before.join(broadcast_if_small(cut_lineage(less), 150), ["kind", "id"], "left").select("kind", "id", (F.col("n_sources") - F.coalesce("n_less", F.lit(0))).alias("n_sources"))
    moved = cut_lineage(reduce(DataFrame.unionByName, ids).distinct())
    held = before.join(broadcast_if_small(moved, 150), ["kind", "id"], "left_semi")
    counts = moved.join(held, ["kind", "id"], "left").join(raised, ["kind", "id"], "left").select(
        "kind", "id", (F.coalesce("n_sources", F.lit(0)) + F.coalesce("n_added", F.lit(0))).alias("n_sources"))
    out["support"] = Change(memory.KEYS["support"], counts.filter("n_sources > 0"), moved)
    # neighbourhoods: the ends of edges that came or went, or whose memory changed its state
    edges = current["edges"]
    if gone:
        edges = edges.join(broadcast_if_small(gone["edges"].select("edge_id"), 100), "edge_id", "left_anti")
    edges = edges.unionByName(added["edges"])
    memories = replaced(current["memories"], added["memories"], gone.get("memories"), "memory_id")
    nodes = current["nodes"].unionByName(added["nodes"]).dropDuplicates(["node_id"])
    restated = current["memories"].select("memory_id", F.col("status").alias("_was")).join(
        broadcast_if_small(added["memories"].select("memory_id", "status"), 150), "memory_id").filter("_was <> status").select("memory_id")
    changed = [added["edges"], current["edges"].join(broadcast_if_small(cut_lineage(restated), 100), "memory_id", "left_semi"), *([gone["edges"]] if gone else [])]
    ends = reduce(DataFrame.union, [e.select(c) for e in changed for c in ("source_node_id", "target_node_id")])
    touched = cut_lineage(ends.toDF("here").distinct())
    out["adjacency"] = Change(memory.KEYS["adjacency"], cut_lineage(neighbourhoods(edges, memories, nodes, touched)), touched)
    return out


def replaced(table: DataFrame, rows: DataFrame, gone: DataFrame | None, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key and without the ``gone`` ones."""
    out = rows.select(key) if gone is None else rows.select(key).union(gone.select(key))
    return table.join(broadcast_if_small(out.distinct(), 100), key, "left_anti").unionByName(rows)


def ingest(spark: SparkSession, paths, store: Store, replace: bool = False, extract=extraction.rule_notes, describe=None, propose=None) -> DataFrame:
    """Ingest files in one commit and return one report row per file.

    ``propose`` (such as ``evolution.model_proposals(model)``) is asked how notes change the memories they share entities
    with; without it notes are added, or merged with identical ones.  A note whose proposal is rejected is not stored, and
    its document is reported as failed and may be retried.

    ``status`` is ingested, replaced, skipped_duplicate or failed.  A replacement that
    yields an invalid or no informative note is refused and the old document stays; a
    new document with some invalid notes is stored but reported failed and may be retried.
    """
    base = store.version()
    current = stored_tables(store)
    scanned = fl.scan_files(spark, paths)
    # the first pass only hashes and checks; the bytes are read again for wanted files alone
    seen = cut_lineage(scanned.drop("content"))
    twin = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("error").isNotNull(), "source_filename")) > 1
    ledger = current["documents"].select("doc_id", F.col("content_hash").alias("_hash"), F.col("status").alias("_status"))
    known = seen.withColumn("_twin", twin).join(ledger, "doc_id", "left")
    same = F.col("_hash") == F.col("content_hash")
    verdict = (F.when(F.col("error").isNotNull(), "rejected").when(F.col("_twin"), "twin").when(same & (F.col("_status") == "complete"), "duplicate")
               .when(F.col("_hash").isNotNull() & ~same, "replacement").otherwise("new"))
    judged = known.withColumn("_verdict", verdict)
    wanted = judged.filter(F.col("_verdict").isin("new", *(["replacement"] if replace else []))).select(
        "source_filename", "content_hash")
    # joining on the hash also drops a file that changed between the passes
    parsed = fl.read_documents(scanned.join(wanted, ["source_filename", "content_hash"], "left_semi"))
    chunks = chunk_files(parsed.filter("error is null"), describe)
    notes = extract(chunks).withColumn("_error", extraction.note_error())
    notes = cut_lineage(notes)
    per_doc = notes.groupBy("doc_id").agg(
        F.count("*").alias("chunks_total"), F.count_if(F.col("_error").isNull() & F.col("is_informative")).alias("notes_informative"),
        F.count_if(F.col("_error").isNull() & ~F.col("is_informative")).alias("notes_skipped"), F.count_if(F.col("_error").isNotNull()).alias("n_errors"),
        F.array_sort(F.collect_set("_error")).alias("note_errors"))
    parse_errors = parsed.filter("error is not null").select("source_filename", F.col("error").alias("_parse"))
    report = judged.select("doc_id", "source_filename", "content_hash", "error", "_verdict").join(
        parse_errors, "source_filename", "left").join(per_doc, "doc_id", "left").fillna(
        0, ["chunks_total", "notes_informative", "notes_skipped", "n_errors"])
    acts = F.col("_verdict").isin("new", "replacement") & (F.lit(replace) | (F.col("_verdict") == "new"))
    stored = acts & (F.col("chunks_total") > 0) & ((F.col("_verdict") == "new") | (
        (F.col("n_errors") == 0) & (F.col("notes_informative") > 0)))
    problem = (F.when(F.coalesce("error", "_parse").isNotNull(), F.coalesce("error", "_parse"))
               .when((F.col("_verdict") == "twin") | ((F.col("_verdict") == "replacement") & F.lit(not replace)),
                     "A different file with this document ID exists. Enable replace to update it.")
               .when(acts & (F.col("chunks_total") == 0), "No readable text found. The existing document was kept.")
               .when(F.col("n_errors") > 0, F.array_join("note_errors", "; "))
               .when(acts & ~stored, "Replacement produced no informative notes. The existing document was kept."))
    status = (F.when(F.col("_verdict") == "duplicate", "skipped_duplicate").when(problem.isNotNull(), "failed")
              .when(F.col("_verdict") == "replacement", "replaced").otherwise("ingested"))
    report = cut_lineage(report.withColumn("stored", stored).withColumn("problem", problem).withColumn("status", status))
    kept_docs = report.filter("stored")
    if kept_docs.take(1):
        replacing = kept_docs.filter("_verdict = 'replacement'").select("doc_id")
        gone, cleared = {}, current
        if replacing.take(1):
            gone = memory.deletions(current, replacing)
            cleared = {**current, **{name: current[name].join(broadcast_if_small(rows.select(*memory.KEYS[name]), 200), list(memory.KEYS[name]), "left_anti")
                                     for name, rows in gone.items() if name != "support"}}
        good = notes.filter("_error is null and is_informative").join(kept_docs.select("doc_id"), "doc_id", "left_semi")
        added, moved_out, rejected = integrate(cleared, good, propose)
        changes = changes_of(current, added, gone, moved_out if propose is not None else None)
        if propose is not None:
            refused = cut_lineage(rejected.groupBy("doc_id").agg(F.first("reason").alias("_refused"), F.count("*").alias("_n")))
            report = cut_lineage(report.join(refused, "doc_id", "left").withColumn("problem", F.coalesce("problem", "_refused")).withColumn(
                "status", F.when(F.col("_refused").isNotNull(), "failed").otherwise(F.col("status"))).withColumn(
                "n_errors", F.col("n_errors") + F.coalesce("_n", F.lit(0))).drop("_refused", "_n"))
            kept_docs = report.filter("stored")
        if gone:
            changes["vector_deletes"] = Change(memory.KEYS["vector_deletes"], gone["notes"].select("note_id", "doc_id"))
        entries = kept_docs.select("doc_id", "content_hash", F.when(F.col("n_errors") > 0, "partial").otherwise("complete").alias("status"),
                                   (F.col("_verdict") == "replacement").alias("cleanup_pending"))
        changes["documents"] = Change(memory.KEYS["documents"], entries)
        store.commit(changes, base)
        store.compact()
    return report.select("doc_id", "content_hash", "status", F.col("problem").alias("error"), "chunks_total", "notes_informative", "notes_skipped")


def _delivered(call, rows: DataFrame, what: str) -> DataFrame:
    """Note ids of ``rows`` that ``call`` did not deliver: those it returns, or all if it raises."""
    nothing = rows.select("note_id").limit(0)
    if rows.isEmpty():
        return nothing
    try:
        failed = call(rows)
    except Exception as exc:
        logging.getLogger(__name__).warning("%s failed and stays pending: %s", what, exc)
        return rows.select("note_id")
    return nothing if failed is None else cut_lineage(failed.select("note_id"))


def flush_outbox(store: Store, write, delete=None) -> DataFrame:
    """Deliver pending deletions and records to a vector index and acknowledge them in one commit.

    ``delete(rows)`` receives ``(note_id, doc_id)``, ``write(records)`` receives
    ``(note_id, text, metadata)`` and must upsert by note id.  Either may return a
    DataFrame with the ``note_id`` values that failed, or raise when all did.  Deletions
    go first; a document whose old notes could not be deleted is held back.  Only what
    succeeded is acknowledged, so the next call sends the rest again.  Without ``delete``
    nothing is deleted and replaced documents wait.
    """
    base, tables = store.version(), stored_tables(store)
    notes, deletes = tables["notes"], tables["vector_deletes"]
    doomed = cut_lineage(memory.vector_deletions(notes, deletes))
    stuck = _delivered(delete, doomed, "deleting vectors") if delete is not None else doomed.select("note_id")
    ready = cut_lineage(memory.vector_upserts(notes, deletes, stuck))
    unsent = _delivered(write, memory.vector_records(ready), "writing vectors")
    after, left = memory.acknowledge(notes, deletes, stuck, ready, unsent)
    # only notes and documents that were part of this delivery are written
    sent = broadcast_if_small(cut_lineage(ready.select("note_id").union(doomed.select("note_id")).distinct()), 100)
    emptied = broadcast_if_small(deletes.select("doc_id").distinct(), 100)
    waiting = left.select("doc_id").distinct().withColumn("_waits", F.lit(True))
    documents = (tables["documents"].join(emptied, "doc_id", "left_semi").join(waiting, "doc_id", "left")
                 .withColumn("cleanup_pending", F.coalesce("_waits", F.lit(False))).select(*tables["documents"].columns))
    acted = {"notes": Change(memory.KEYS["notes"], after.join(sent, "note_id", "left_semi")), "documents": Change(memory.KEYS["documents"], documents),
             "vector_deletes": Change(memory.KEYS["vector_deletes"], left, deletes)}
    store.commit(acted, base)
    store.compact()
    return memory.outbox_counts(store.tables()["notes"], store.tables()["documents"])


def memory_of(store: Store) -> Memory:
    """The committed tables as the input of ``ask.answer_questions``."""
    t = store.tables()
    return Memory(notes=t["notes"], memories=t["memories"], nodes=t["nodes"].select("node_id", "name"),
                  surface_forms=t["surface_forms"].select("node_id", "name"), edges=t["edges"], edge_sources=t["edge_sources"], adjacency=t["adjacency"])
