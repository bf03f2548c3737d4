"""The pipeline's stages against plain Python over what the stage before kept."""

import pyarrow.parquet as pq
import sentencepiece

import __spark_entry__
import corpus_pipeline
from marginalia.llm import decontaminate, fertility
from marginalia.llm.queries import piece_model
from marginalia.session import cut_lineage
from tests.conftest import DATA
from tests.llm.test_similarity import brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, DATA))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        made[name] = {r.doc_id: r for r in docs.collect()}
    vocab = fertility._tokens(piece_model())
    fluent = {d: r for d, r in kept.items() if fertility.measure((r.text or "").encode(), r.lang, vocab, fertility.BANDS)[-1]}
    assert made["quality_rules"] == fluent
    groups = brute_components([(d, r.text) for d, r in fluent.items()], 5, 80)
    assert made["near_dedup"] == {d: r for d, r in fluent.items() if groups[d] == d}
    # Each fifty-word sequence that several documents had is left in the first of them at most, give or take the edges.
    before, after = made["near_dedup"], made["substring_dedup"]
    assert set(before) == set(after)
    owner: dict = {}
    for d in sorted(before):
        w = before[d].text.lower().split()
        for i in range(len(w) - 49):
            owner.setdefault(tuple(w[i:i + 50]), d)
    left = sum(owner.get(tuple(w[i:i + 50]), d) != d for d, r in after.items() for w in [r.text.lower().split()] for i in range(len(w) - 49))
    repeated = sum(owner[tuple(w[i:i + 50])] != d for d, r in before.items() for w in [r.text.lower().split()] for i in range(len(w) - 49))
    assert left <= 0.02 * repeated
    for d, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == before[d].text or len(r.text) < len(before[d].text))
    items = [decontaminate.words_of(t.encode()) for t in pq.read_table(f"{DATA}/benchmark.parquet")["text"].to_pylist()]
    windows = {tuple(w[i:i + 10]) for w in items if len(w) >= 10 for i in range(len(w) - 9)}
    assert all(len(w) >= 10 for w in items)
    clean = {d: r for d, r in after.items() for w in [decontaminate.words_of(r.text.encode())] if not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))}
    assert made["benchmark_decontamination"] == clean and len(clean) < len(after)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    coded = made["piece_encoding"]
    assert set(coded) == set(clean)
    for d, r in coded.items():
        assert r.ids == library.encode(clean[d].text) and r.text == clean[d].text and r.n_tokens == len(r.ids)
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == coded


def test_registered():
    names = __spark_entry__.queries()
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert {"op2_chat_format", "op3_decontaminate", "op8_near_dedup"} <= set(__spark_entry__.oracle_sql())
