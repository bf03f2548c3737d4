import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import chunking, cleaning, tables
from marginalia.plans import document_queries


def chunks(spark, *texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    cleaned = docs.select("doc_id", tx.clean_text("text").alias("text"))
    rows = chunking.chunk_documents(cleaned).orderBy("doc_id", "chunk_index").collect()
    out = [[] for _ in texts]
    for r in rows:
        out[int(r.doc_id)].append((r.section, r.text))
    return out


def test_page_furniture(spark):
    pages = [("d", p, f"ACME Report\nSecret {p}\nbody {p} a\nmiddle line\nmore {p}\nConfidential\nPage {p} of 4")
             for p in range(1, 5)] + [("one", 1, "7\nkept")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    got = {(r.doc_id, r.page): r.text for r in cleaning.remove_page_furniture(df).collect()}
    assert got["d", 2] == "Secret 2\nbody 2 a\nmiddle line\nmore 2"
    assert got["one", 1] == "7\nkept"


def test_short_first_piece_stays_alone_on_request(spark):
    text = "Nine words stand here in a very short start. " + " ".join(["Then"] + ["word"] * 470 + ["ends."]) + " " + " ".join(["Last"] + ["word"] * 300)
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    sizes = {ahead: [len(r.text.split()) for r in chunking.chunk_documents(docs, ahead=ahead).orderBy("chunk_index").collect()] for ahead in (True, False)}
    # each piece repeats the last sentence of the one before it, where both fit
    assert sizes == {True: [481, 301], False: [9, 481, 301]}


def test_pages_join_into_sentences(spark):
    df = spark.createDataFrame([("d", 1, "OpenAI released GPT-4 in\n"), ("d", 2, "\nMarch 2023."), ("d", 3, " "),
                                ("d", 4, "New topic.")], "doc_id string, page int, text string")
    assert cleaning.clean_documents(df).first().text == "OpenAI released GPT-4 in March 2023.\n\nNew topic."


def test_page_preserving_reference_cut(spark):
    df = spark.createDataFrame([("d", 1, "Body " * 20), ("d", 2, "More body.\nReferences\n[1] x"),
                                ("d", 3, "[2] y")], "doc_id string, page int, text string")
    got = [r.text for r in cleaning.clean_page_texts(df).orderBy("page").collect()]
    assert got == [("Body " * 20).strip(), "More body.", ""]


def test_sections_and_merging(spark):
    body = "This paragraph holds quite a few ordinary words about one topic. " * 6
    got = chunks(spark, f"# First\n{body}\n\n## Second\n\nshort note here.\n\nanother note here.",
                 "tiny one here.\n\ntiny two here.\n\ntiny three here.\n\ntiny four here.",
                 "a short unpunctuated assertion")[0:3]
    assert [s for s, _ in got[0]] == ["First", "Second"]
    assert got[0][1][1] == "short note here.\n\nanother note here."
    assert len(got[1]) == 1
    assert got[2] == [(None, "a short unpunctuated assertion")]


def test_boilerplate_kept_once(spark):
    line = "This document is confidential and belongs to the issuing company only, see terms."
    got = chunks(spark, f"{line}\n\nThe launch is planned for spring.\n\n{line}\n\nThe budget is fixed now.")
    assert got[0][0][1].count("confidential") == 1


def test_long_text_limits_and_overlap(spark):
    got = chunks(spark, " ".join(["word"] * 650), " ".join(f"Sentence number {i} ends here." for i in range(200)))
    assert [len(t.split()) for _, t in got[0]] == [600, 50]
    first, second = got[1][0][1], got[1][1][1]
    assert second.startswith(tx_last_sentence(first))
    assert all(len(t.split()) <= 600 for _, t in got[1])


def tx_last_sentence(text):
    return chunking._BREAK.split(text)[-1]


def test_near_duplicates_against_brute_force():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(5, 260))) for _ in range(40)]
    texts = []
    for _ in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    kept, expected = [], []
    for t in texts:
        repeat = any(SequenceMatcher(None, t, k).ratio() >= 0.95 for k in kept)
        expected.append(repeat)
        if not repeat:
            kept.append(t)
    assert chunking.near_duplicates(texts) == expected
    assert 20 < sum(expected) < 150


def test_page_chunks_carry_heading(spark):
    df = spark.createDataFrame([("d", 1, "Intro text ends.\n\n# Costs"), ("d", 2, "The cost is low."),
                                ("d", 3, "# Other\n\nDone now.")], "doc_id string, page int, text string")
    got = [(r.page, r.section, r.text) for r in chunking.chunk_pages(df).orderBy("page", "position").collect()]
    assert got == [(1, None, "Intro text ends."), (2, "Costs", "The cost is low."), (3, "Other", "Done now.")]
    where = {r.page: r.section for r in chunking.page_sections(df).collect()}
    assert where == {1: "Costs", 2: "Costs", 3: "Other"}


def pieces(spark, rows, caption=None):
    df = spark.createDataFrame([(rows, caption, None, None)],
                               "rows array<array<string>>, caption string, page int, section string")
    return tables.table_pieces(df).orderBy("part").collect()


def test_table_sentences(spark):
    one = pieces(spark, [["A", "B", "C"], ["x", "y", "z"]])
    assert [r.text for r in one] == ["Table\nColumns: A, B, C.\nA x: B is y, C is z."]
    many = pieces(spark, [["K", "V"]] + [[str(i), "v w"] for i in range(23)], "prices")
    assert [r.text.split("\n")[0] for r in many] == [f"Table: prices (part {n} of 3)" for n in (1, 2, 3)]
    assert len(many[0].text.split("\n")) == 12
    assert pieces(spark, [["only"], [""]]) == []


def test_table_shapes(spark):
    ragged = pieces(spark, [["A", "", ""], ["1", "", "3"], [None, "", ""]], "Table 4: odd")[0]
    assert ragged.text == "Table 4: odd\nColumns: A, column 3.\nA 1: column 3 is 3."
    assert ragged.is_numeric
    drawn = pieces(spark, [["A", "a"], ["x|y", ""]])[0]
    assert drawn.text == "Table\n| A | a |\n| --- | --- |\n| x/y |  |"


def test_table_continuations(spark):
    def t(page, cap, rows):
        return {"rows": rows, "caption": cap, "page": page, "section": None}
    two = [["h", "i"], ["1", "2"]]
    cases = [[t(1, None, two), t(2, None, two)], [t(1, None, two), t(2, "c", two)], [t(1, None, two), t(3, None, two)],
             [t(1, None, two), t(2, None, two), t(3, None, two)], [t(None, None, two), t(1, None, two)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, tables array<{tables.TABLE}>")
    out = df.orderBy("i").select(F.transform(tables.merge_continuations(F.col("tables")),
                                             lambda x: F.size(x["rows"])).alias("n")).collect()
    assert [r.n for r in out] == [[4], [2, 2], [2, 2], [4, 2], [2, 2]]


def test_captions_leave_prose(spark):
    row = spark.range(1).select(tables.take_captions(
        F.lit("intro\nTable 1: a\nmore\nTable 2: b\nTable 3: c"), F.lit(2)).alias("x")).first().x
    assert row.captions == ["Table 1: a", "Table 2: b"]
    assert row.text == "intro\nmore\nTable 3: c"


def test_cleaning_is_evaluated_once_when_chunked(spark):
    """Below lambdas and Python inputs nothing is shared: what is mentioned twice there is computed twice."""
    docs = spark.createDataFrame([(1, "# A\n\nSome text.")], "doc_id long, text string").select("doc_id", tx.clean_text("text").alias("text"))
    plan = chunking.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("all rights reserved") == 1


def test_last_sentence_is_found_from_the_end():
    for t in ("One. Two. Three", " Only one ", "Ends here. " + "word " * 3000 + "is long", "x" * 499 + ". Q", "a.  B" + "c" * 497, ""):
        assert chunking.last_sentence(t) == chunking._BREAK.split(t.strip())[-1]


@pytest.fixture(scope="module")
def of_connectors(spark, tmp_path_factory):
    """A folder of documents, one of 30 000 words that headings have in lower case: one level of stack for each was too many."""
    folder = tmp_path_factory.mktemp("connectors")
    rows = [(1, "One plain sentence stands here."), (2, " ".join(["the of and"] * 10_000)), (3, "The Order of the Day"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_cleaned_chunks_of_a_long_run_of_connectors(spark, of_connectors):
    got = {r.doc_id: (r.n_chunks, r.n_words) for r in document_queries.chunk_cleaned_documents(spark, of_connectors).collect()}
    assert got == {1: (1, 5), 2: (50, 30_000)}


def test_chunks_of_a_long_run_of_connectors(spark, of_connectors):
    rows = document_queries.chunk_documents(spark, of_connectors).collect()
    assert sorted((r.doc_id, r.chunk_index, r.n_words) for r in rows) == [(1, 0, 5), *((2, i, 600) for i in range(50))]


def test_hard_slices_of_a_long_run_of_connectors(spark, of_connectors):
    rows = document_queries.chunk_hard_slices(spark, of_connectors).collect()
    assert sorted((r.doc_id, r.chunk_index, r.n_words) for r in rows) == [(1, 0, 5), *((2, i, 600) for i in range(50)), (3, 0, 5)]


def test_sections_of_a_long_run_of_connectors(spark, of_connectors):
    rows = document_queries.heading_sections(spark, of_connectors).collect()
    assert sorted((r.doc_id, r.section, r.n_paragraphs) for r in rows) == [(1, "Part 0", 1), (2, "Part 0", 1)]


def test_titles_around_connectors(evaluate):
    many = " ".join(["a"] * 30_000)
    assert evaluate(tx.heading_text("x"), many, many + " Title", "of the", "Of\u00a0The Day", "the of And The", "In to Town ", "an \tA") == [
        None, None, None, "Of\u00a0The Day", None, "In to Town", None]
