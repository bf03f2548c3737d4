"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat, decontaminate, fertility, kneser_ney, odd_minhash, passages, piece_codec, site_quality, token_count, toxicity
from marginalia.llm.queries import piece_model

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, words string, kept string, score double, component string, spans string, "
          "gone string, digest string, node string, label string")
LONG = " ".join(f"w{i % 977} v{i % 613}" for i in range(30_000))
REST = ("x", "y", 1.0, "c", "s", "g", "d", "n", "l")
NONE = (None,) * len(REST)
ROWS = [(1, "", "en", "s", 0, *REST), (2, None, None, None, None, *NONE), (3, "one", "en", "s", 3, *REST), (4, LONG, "de", "s", len(LONG), *REST),
        (5, "the same few words here", "xx", None, 23, *NONE), (5, "the same few words here", "xx", None, 23, *NONE), (6, "the same few words here", "en", "t", 23, *REST),
        (None, "text without an id", "en", "s", 18, *REST), (None, None, None, None, None, *NONE), (7, " \t\n ", "en", "s", 4, *REST), (8, "ü" * 3000, "de", "s", 3000, *REST),
        (9, "\x00 zero", "en", "t", 6, *REST)]
LABELS = [(3, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, None), (5, None, None, "x"), (5, 1, 0, "x"), (5, 0, 1, "x"), (99, 1, 1, None)]
ITEMS = [(1, "the same few words", "t"), (None, "one", "t"), (2, None, None), (3, "", "t"), (4, "zero", "t"), (4, "zero", "t")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string")
    return docs, labels, items


def jobs(docs, labels, items):
    return {
        "decontaminate": lambda: decontaminate.contamination(docs, items),
        "site_quality": lambda: site_quality.site_quality(docs, labels, F.col("source"), F.col("lang")),
        "kneser_ney": lambda: kneser_ney.perplexity(docs),
        "piece_codec": lambda: piece_codec.decode(piece_codec.encode(docs, piece_model()), piece_model()),
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "odd_minhash": lambda: odd_minhash.near_duplicates(docs),
        "token_count": lambda: token_count.count_tokens(docs, piece_model()),
        "fertility": lambda: fertility.fertility(docs, piece_model()),
    }


@pytest.mark.parametrize("name", list(jobs(None, None, None)))
def test_one_row_for_each_input_row(spark, tables, name):
    rows = jobs(*tables)[name]().collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((False, r[0]) for r in ROWS if r[0] is not None)
    assert len(rows) == len(ROWS)
    empty = [t.limit(0) for t in tables]
    assert jobs(*empty)[name]().count() == 0


def test_edge_results(spark, tables):
    docs, labels, items = tables
    by_id = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    counts = by_id(token_count.count_tokens(docs, piece_model()))
    assert (counts[1].n_bytes, counts[1].n_tokens, counts[2].n_tokens) == (0, 0, 0) and counts[4].over_limit and counts[8].n_bytes == 6000
    hits = by_id(decontaminate.contamination(docs, items))
    assert hits[5]["items"] == ["1"] and [tuple(s) for s in hits[5].spans] == [(0, 4)] and hits[9]["items"] == ["4"] and not hits[3]["items"] and hits[2].n_words == 0
    groups = by_id(odd_minhash.near_duplicates(docs))
    assert (groups[6].component_id, groups[6].kept, groups[5].kept, groups[1].n_shingles, groups[1].component_id) == (5, False, True, 0, 1)
    rules = by_id(fertility.fertility(docs, piece_model()))
    assert rules[1].base_failed and not rules[2].kept and rules[4].n_words == 60_000
    scores = by_id(kneser_ney.perplexity(docs))
    assert scores[1].n_tokens == scores[2].n_tokens == 1 and scores[4].n_tokens == 60_001
    none = by_id(toxicity.toxicity(docs, labels.limit(0)))
    assert {r.score for r in none.values()} == {0.5}


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 1, "user", None, "z"), (1, 0, None, "a", "z"), (1, None, "user", "first", None), (None, 0, "user", "x", "z"),
                                   (2, 0, "user", "same", "z"), (2, 0, "user", "same", "z")], "conv_id long, turn long, role string, text string, messages string")
    rows = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert chat.read_turns(rows[1].text) == [("user", "first"), ("", "a"), ("user", "")]
    assert rows[2].n_turns == 2 and rows[None].n_turns == 1
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tables, tmp_path, name, stage):
    docs, _, items = tables
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name == corpus_pipeline.STAGES[-1][0]:
        assert len(rows) == len(ROWS)
    else:
        assert out.columns == docs.columns
        # Nothing but whole rows goes, and no text is long and repeated enough to be cut.
        left = [tuple(r) for r in rows]
        assert all(r in ROWS for r in left)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_passages_edges(spark, tables):
    docs = tables[0]
    assert passages.repeated_passages(docs).count() == 0
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    doubled = docs.union(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(40).cast("long")))
    found = passages.repeated_passages(doubled).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(40, 4)}
