import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.config import NO_INFO_TEXT
from marginalia.operators.search import keyword_search
from marginalia.plans import ask, ingest as ing
from marginalia.sources import files as fl
from marginalia.sources.store import Store, StoreError

FILLER = "The project moved ahead this season while several teams reviewed their plans together and wrote down what they had learned so far. "


def office(path, body, kind="word/document.xml", extra=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(kind, body)
        for name, text in extra:
            z.writestr(name, text)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "atlas.txt").write_text(f"﻿# Atlas\n\nAtlas is managed by Mara. {FILLER}\n\n# Budget\n\nThe budget is 1,200 units. {FILLER}", encoding="utf-8")
    (tmp_path / "copy.txt").write_text("Beacon is managed by Ivo. " + FILLER)
    (tmp_path / "again.txt").write_text("Beacon is managed by Ivo. " + FILLER)
    (tmp_path / "report.md").write_text("# Plans\n\nTable 2: offers\n\n| Plan | Price |\n|---|---|\n| Basic | 5 |\n| Plus | 9 |\n\nAfter the table come words that carry on.\n")
    (tmp_path / "my_models.csv").write_text("Model;Company;Year\nA1;Acme;2020\nB2;Bolt;2021\n")
    (tmp_path / "song.mp3").write_bytes(b"ID3")
    (tmp_path / "fake.pdf").write_text("not a pdf")
    (tmp_path / "bad.docx").write_text("not a zip")
    (tmp_path / "nul.txt").write_bytes(b"a\x00b")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    office(tmp_path / "letter.docx", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Terms</w:t></w:r></w:p>'
           f'<w:p><w:r><w:t>The terms apply to all parties from the first of May onwards.</w:t></w:r></w:p>'
           f'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Plan</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Price</w:t></w:r></w:p></w:tc></w:tr>'
           f'<w:tr><w:tc><w:p><w:r><w:t>Gold</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>12</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office(tmp_path / "sheet.xlsx", f'<workbook {s} xmlns:r="http://r"><sheets><sheet name="Models" r:id="r1"/></sheets></workbook>', "xl/workbook.xml", [
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f"<sst {s}><si><t>Model</t></si><si><t>Zeta</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Year</t></is></c></row>'
                                     f'<row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2019</v></c></row></sheetData></worksheet>')])
    return tmp_path


def test_ingest_then_ask(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    paths = str(folder / "*.*")
    report = {r.doc_id: r for r in ing.ingest(spark, paths, store).collect()}
    assert {k: r.status for k, r in report.items()} == {
        "atlas": "ingested", "copy": "ingested", "again": "ingested", "report": "ingested", "my_models": "ingested", "letter": "ingested",
        "sheet": "ingested", "song": "failed", "fake": "failed", "bad": "failed", "nul": "failed"}
    assert report["song"].error == "unsupported_file_type" and report["bad"].error == "invalid_file"
    t = store.tables()
    texts = {(r.doc_id, r.chunk_index): r for r in t["notes"].collect()}
    assert texts["atlas", 0].section == "Atlas" and texts["atlas", 1].section == "Budget"
    assert texts["report", 1].content == "Table 2: offers\nColumns: Plan, Price.\nBasic: Price is 5.".replace("Basic:", "Plan Basic:") + "\nPlan Plus: Price is 9."
    assert texts["report", 1].section == "Plans"
    assert texts["my_models", 0].content.startswith("Table: my models\nColumns: Model, Company, Year.\nModel A1: Company is Acme, Year is 2020.")
    assert texts["letter", 1].content.endswith("Plan Gold: Price is 12.") and texts["letter", 1].section == "Terms"
    assert texts["sheet", 0].content == "Table: Models\nColumns: Model, Year.\nModel Zeta: Year is 2019."
    # identical text: one memory, two sources, one edge with two sources
    beacon = t["memories"].filter(F.col("content").startswith("Beacon"))
    assert beacon.count() == 1
    assert t["memory_sources"].join(beacon, "memory_id").count() == 2
    assert t["edges"].count() == 2 and t["edge_sources"].count() == 3
    # outbox
    sent = []
    counts = ing.flush_outbox(store, lambda records: sent.extend(records.collect())).first()
    assert len(sent) == t["notes"].count() and sent[0].metadata["doc_id"]
    assert tuple(counts) == (0, 0)
    # ask: the graph passage wins, facts are numbered, nothing found is refused
    asked = spark.createDataFrame([(1, "Who manages Atlas?"), (2, "zzz qqq?"), (3, "What does plan Gold cost?")], "question_id int, question string")
    got = {r.question_id: r for r in ask.answer_questions(asked, ing.memory_of(store)).collect()}
    assert got[1].state == "GRAPH_SUPPORTED" and "Atlas is managed by Mara." in got[1].answer_text and got[1].cited[0].evidence_id == "E1"
    assert got[2].answer_text == NO_INFO_TEXT and got[2].insufficient_evidence and got[2].retries_used == 2
    assert "Gold" in got[3].answer_text
    # unchanged files are skipped, a changed one needs permission
    version = store.version()
    (folder / "atlas.txt").write_text("Atlas is managed by Nele. " + FILLER)
    (folder / "copy.txt").write_text("   \n")
    again = {r.doc_id: r for r in ing.ingest(spark, paths, store).collect()}
    assert again["letter"].status == "skipped_duplicate" and again["atlas"].status == "failed"
    assert again["atlas"].error.startswith("A different file") and store.version() == version
    # replacement: all or nothing per document
    last = {r.doc_id: r for r in ing.ingest(spark, [str(folder / "atlas.txt"), str(folder / "copy.txt")], store, replace=True).collect()}
    assert last["atlas"].status == "replaced" and last["copy"].error.startswith("No readable text")
    names = {r.name for r in store.tables()["nodes"].collect()}
    assert {"Nele", "Atlas", "Beacon", "Ivo"} <= names and "Mara" not in names
    with pytest.raises(StoreError):
        store.commit(store.tables(), base=1)


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"question": "Q1?", "expected_terms": ["a"]}\n{"question": "Q2?"}\n')
    (tmp_path / "c.md").write_text("# Title\n1. First?\n2) Second?\nprose\n")
    (tmp_path / "c.txt").write_text("# comment\nOne?\n\n3. Two?\n")
    read = lambda n: [r.question for r in fl.read_cases(spark, str(tmp_path / n)).collect()]     # noqa: E731
    assert read("c.jsonl") == ["Q1?", "Q2?"] and read("c.md") == ["First?", "Second?"] and read("c.txt") == ["One?", "Two?"]


def test_figures(spark):
    rows = [("d", [{"image": b"ok", "page": 1, "caption": "Figure 1", "width": 100, "height": 100},
                   {"image": b"tiny", "page": 1, "caption": None, "width": 10, "height": 900},
                   {"image": b"boom", "page": 1, "caption": None, "width": None, "height": None}])]
    docs = spark.createDataFrame(rows, "doc_id string, figures array<struct<image:binary,page:int,caption:string,width:int,height:int>>")

    def describe(data):
        if data == b"boom":
            raise ValueError("no")
        return data.decode() + " picture"
    assert [r.text for r in fl.describe_figures(docs, describe).collect()] == ["Figure 1\nok picture"]


def test_outbox_keeps_what_failed(spark, tmp_path):
    """Old notes of a replaced document are deleted first; what fails stays pending, the document waits meanwhile."""
    files = tmp_path / "f"
    files.mkdir()
    for name, person in (("atlas", "Mara"), ("beacon", "Ivo")):
        (files / f"{name}.txt").write_text(f"{name.title()} is managed by {person}. " + FILLER)
    store = Store(spark, str(tmp_path / "store"))
    ing.ingest(spark, str(files), store).collect()
    index = {}
    write = lambda records: index.update({r.note_id: r.text for r in records.collect()})

    def broken(rows):
        raise OSError("no connection")

    assert tuple(ing.flush_outbox(store, broken).first()) == (2, 0)
    assert tuple(ing.flush_outbox(store, write).first()) == (0, 0) and len(index) == 2
    (files / "atlas.txt").write_text("Atlas is managed by Nele. " + FILLER)
    ing.ingest(spark, str(files / "atlas.txt"), store, replace=True).collect()
    assert tuple(ing.flush_outbox(store, write, broken).first()) == (1, 1) and len(index) == 2
    assert tuple(ing.flush_outbox(store, write, lambda rows: [index.pop(r.note_id, None) for r in rows.collect()] and None).first()) == (0, 0)
    assert sorted(t[:25] for t in index.values()) == ["Atlas is managed by Nele.", "Beacon is managed by Ivo."]


def test_a_dead_writer_blocks_nobody(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = spark.range(3)
    assert store.commit({"t": one}) == 1
    (tmp_path / "store" / "try-dead").mkdir()
    claim = tmp_path / "store" / "next-2"
    claim.write_text("")
    with pytest.raises(StoreError):
        store.commit({"t": one})
    import os
    os.utime(claim, (1, 1))
    assert store.commit({"t": one}) == 2 and store.tables()["t"].count() == 3


def test_readers_keep_cells(spark):
    made = fl._read_markdown("|| Q1 | Q2 |\n|---|---|---|\n| a | 1 ||\n".encode(), "x")["tables"][0]["rows"]
    assert made == [["", "Q1", "Q2"], ["a", "1", ""]]
    assert fl._read_csv(b"a;b\n1,5;2\n3,5;4\n", "my_file")["tables"][0] == {"rows": [["a", "b"], ["1,5", "2"], ["3,5", "4"]], "caption": "my file", "page": None, "section": None}
    assert fl._read_csv(b" \n", "x") == {} and fl._read_csv(b"one\ntwo\n", "x")["tables"][0]["rows"] == [["one"], ["two"]]
    assert fl._excel_time("45000") == "2023-03-15 00:00:00" and fl._excel_time("1.5") == "1900-01-01 12:00:00"


def test_notes_evolve_stored_memories(spark, tmp_path):
    """A later fact supersedes, an equal one merges, an early one is stopped, an unknown target fails its document."""
    from marginalia.operators import evolution, extraction
    files = tmp_path / "f"
    files.mkdir()
    said = {"one": "Atlas is managed by Mara. First report.", "two": "Beacon is managed by Ivo. First report."}
    for name, text in said.items():
        (files / f"{name}.txt").write_text(text + " " + FILLER)

    def dated(chunks):
        """The month of a fact is the number of words before FILLER, so that texts carry their times."""
        month = F.when(F.col("content").contains("First"), "2026-05").when(F.col("content").contains("Later"), "2026-09").when(F.col("content").contains("Early"), "2026-02")
        notes = extraction.rule_notes(chunks)
        return notes.withColumn("relations", F.transform("relations", lambda r: r.withField("event_time", F.concat(month, F.lit("-01T00:00:00Z")))))
    store = Store(spark, str(tmp_path / "store"), ing.PARTITIONED)
    ing.ingest(spark, str(files), store, extract=dated).collect()
    for name, text in {"three": "Atlas is managed by Nele. Later report.", "four": "Beacon is managed by Ivo. Later report.", "five": "Beacon is managed by Olga. Early report.",
                       "six": "Atlas is managed by Rudi. Wrong report."}.items():
        (files / f"{name}.txt").write_text(text + " " + FILLER)

    def model(prompt):
        import json
        asked = json.loads(prompt)
        mine = [m["memory_id"] for m in asked["memories"]]
        action = "merge" if "by Ivo" in asked["new_note"]["content"] else "update"
        return {"action": action, "target_ids": ["elsewhere"] if "Wrong" in asked["new_note"]["content"] else mine[:1], "reason": "model"}
    report = {r.doc_id: r for r in ing.ingest(spark, str(files), store, extract=dated, propose=evolution.model_proposals(model)).collect()}
    assert {k: r.status for k, r in report.items()} == {"one": "skipped_duplicate", "two": "skipped_duplicate", "three": "ingested", "four": "ingested", "five": "ingested", "six": "failed"}
    assert report["six"].error == "Unknown target memory"
    t = {name: df.collect() for name, df in store.tables().items()}
    by_text = {r.content.split(". ")[0]: r for r in t["memories"]}
    assert by_text["Atlas is managed by Mara"].status == "superseded" and by_text["Atlas is managed by Mara"].replacement_id == by_text["Atlas is managed by Nele"].memory_id
    assert by_text["Beacon is managed by Ivo"].status == "active" and set(by_text) == {"Atlas is managed by Mara", "Atlas is managed by Nele", "Beacon is managed by Ivo", "Beacon is managed by Olga"}
    notes = {r.doc_id: r for r in t["notes"]}
    assert notes["four"].memory_id == notes["two"].memory_id and "six" not in notes
    assert notes["one"].vector_delete_pending and not notes["one"].vector_pending and notes["three"].vector_pending
    assert {r.reason for r in t["events"]} == {"Preserve distinct evidence", "model", "Update blocked: explicit later event time required"}
    assert {r.memory_id for r in t["revisions"]} == {by_text["Atlas is managed by Mara"].memory_id, by_text["Beacon is managed by Ivo"].memory_id}
    ivo = by_text["Beacon is managed by Ivo"].memory_id
    edge = {r.edge_id for r in t["edges"] if r.memory_id == ivo}
    assert len(edge) == 1 and {r.note_id for r in t["edge_sources"] if r.edge_id in edge} == {notes["two"].note_id, notes["four"].note_id}
    counts = {(r.kind, r.id): r.n_sources for r in t["support"]}
    assert counts["memory", ivo] == 2 and counts["edge", edge.pop()] == 2
    assert {(r.kind, r.id): r.n_sources for r in ing.memory.support_counts(store.tables()).collect()} == counts
    # the neighbourhood of Atlas knows only the living fact
    assert {p.fact_key for p in t["adjacency"] if "atlas" in p.fact_key} == {"atlas|managed_by|nele"}
