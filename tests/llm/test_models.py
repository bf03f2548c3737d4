"""Operators 4, 5 and 7 against brute force and held-out accuracy."""

import collections
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marginalia.llm import kneser_ney, site_quality, toxicity
from marginalia.llm.queries import QUERIES
from tests.conftest import DATA

#: Labels are few in the smallest tables; accuracy needs these.
MORE = DATA.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*(pq.read_table(f"{DATA}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def brute_discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if min(n) <= 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2])))


def test_kneser_ney_by_definition(spark, texts):
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in texts.items()}
    pairs, words, before, total, followers = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for d, w in tokens.items():
        if remainder(d, 7) != 2:
            pairs.update(zip([0] + w[:-1], w))
    for (u, w), n in pairs.items():
        words[w] += n
        before[w] += 1
        total[u] += n
        followers[u][min(n, 3) - 1] += 1
    by_pair, by_word, n_tokens, n_pairs = brute_discounts(pairs.values()), brute_discounts(before.values()), sum(words.values()), len(pairs)
    less = lambda n, by: n - by[min(n, 3) - 1] if n else 0.0
    spare = 1 - sum(less(n, by_word) for n in before.values()) / n_pairs

    def probability(u, w):
        lower = less(before[w], by_word) / n_pairs + spare / (len(words) + 1)
        return less(pairs[u, w], by_pair) / total[u] + sum(a * b for a, b in zip(by_pair, followers[u])) / total[u] * lower if total[u] else lower

    # Probabilities after a context, an unknown word included, sum to one.
    for u in (0, b"the", b"neverseen"):
        assert math.isclose(sum(probability(u, w) for w in words) + probability(u, b"unknown word"), 1, rel_tol=1e-9)
    for r in QUERIES["op5_lm_score"][0](spark, DATA).collect():
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 7) == 2, len(w), sum(words[x] > 0 for x in w), n_tokens)
        assert math.isclose(r.base_score, sum(math.log10((words[x] + 1) / (n_tokens + 1 * (len(words) + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(probability(u, x)) for u, x in zip([0] + w[:-1], w)), rel_tol=1e-9)


def test_model_does_not_depend_on_shards_or_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    seen = [sorted((r.doc_id, round(r.score, 9)) for r in kneser_ney.perplexity(docs.repartition(n), shards=s).collect()) for n, s in ((1, 1), (3, 5))]
    assert seen[0] == seen[1]


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 2**63, 100, dtype=np.uint64), np.arange(300), np.array([70_000, 5]), np.zeros(0, np.int64), np.array([1 << 40])]
    assert all((a == b).all() for a, b in zip(arrays, kneser_ney.unpacked(kneser_ney.packed(*arrays))))


def test_large_counts_are_kept(spark):
    docs = spark.createDataFrame([(i, "a b " * 400) for i in range(3)], "doc_id long, text string")
    model = kneser_ney.train(docs, shards=2)
    h = kneser_ney.word_hashes([b"a", b"b"])
    u, w = h[:1], h[1:]
    assert kneser_ney.bigram_counts(model, u, w, kneser_ney.bigram_hash(u, w)).tolist() == [1200]


def accuracy(rows, labels, wanted):
    known = [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]
    return sum(wanted(r) == y for y, r in known) / len(known), known


def labels_of(folder, column):
    table = pq.read_table(f"{folder}/labels.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table[column].to_pylist()))


def test_toxicity_held_out(spark):
    rows = QUERIES["op7_toxicity"][0](spark, MORE).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    share, known = accuracy(rows, labels_of(MORE, "toxic"), lambda r: r.predicted)
    assert share >= 0.93
    toxic, ordinary = ([r.score for y, r in known if y == k] for k in (1, 0))
    assert np.mean([t > o for t in toxic for o in ordinary]) > 0.9  # the chance that a toxic text scores above an ordinary one


def test_class_counts_by_definition(spark):
    """Contexts of words and stems by class and fold, against plain sets."""
    rows = [("nasty fool here", 1, 0), ("a nasty foolish fool", 1, 1), ("a kind fool here", 0, 0), ("kind kind words", 0, 1)]
    words, forms = toxicity.count_contexts(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    stems = {r.key: r for r in words.join(forms, "w").select(F.explode("keys").alias("key"), "a0", "a1", "b0", "b1", "c0", "c1").groupBy("key")
             .agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1", "c0", "c1"))).collect()}
    pairs = {(m, y): set() for m in "abc" for y in (0, 1)}
    for text, y, fold in rows:
        w = text.encode().split()
        for m in ("ab"[fold], "c"):
            pairs[m, y].update(zip([b""] + w[:-1], w))
    for form in (b"fool", b"nasty", b"kind", b"foo*", b"fool*", b"fooli*", b"nas*", b"word*"):
        key = int(toxicity.word_hashes([form]).view(np.int64)[0])
        for (m, y), found in pairs.items():
            assert stems[key][f"{m}{y}"] == sum(form in toxicity.chain_of(w) for _, w in found), (form, m, y)


def test_unseen_forms_are_judged_by_their_stem():
    forms = {b"stupid": (0, 40), b"stupid*": (0, 8), b"stup*": (0, 48), b"stupi*": (0, 48), b"stu*": (10, 50), b"there": (500, 480), b"the*": (900, 880), b"ther*": (500, 480)}
    key = toxicity.word_hashes(list(forms))
    order = np.argsort(key)
    counts = toxicity.Counts(key[order], np.array(list(forms.values()), float)[order], np.array([10_000.0, 10_000.0]))
    known, unseen, common, new = toxicity.word_ratios(counts, [b"stupid", b"stupidest", b"there", b"zzz"])
    assert known > unseen > 1.5 and abs(common) < 0.1 and new == 0


def test_site_quality(spark):
    rows = QUERIES["op4_site_quality"][0](spark, MORE).collect()
    share, _ = accuracy(rows, labels_of(MORE, "quality"), lambda r: int(r.kept))
    assert share >= 0.95


def test_site_posteriors_by_definition(spark):
    """Posteriors recomputed from the documents' own scores; sparse paths lie nearer to their host, sparse hosts to the corpus."""
    rng = np.random.default_rng(4)
    good, bad = "a plain sentence of some ordinary words here. ", "%%% $$$ ### !!! *** &&& "
    docs, labels = [], []
    for i in range(240):
        host = i % 4
        y = int(rng.random() < (0.95, 0.9, 0.3, 0.6)[host])
        docs.append((i, (good if y else bad) * int(rng.integers(1, 6)) + str(i), f"h{host}", f"p{i % 7}"))
        labels.append((i, y))
    docs.append((1000, good, "lone", "p"))
    docs.append((1001, "", "h2", "p1"))
    table = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    rows = {r.doc_id: r for r in site_quality.site_quality(table, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("host"), F.col("path")).collect()}
    place = {d: (h, p) for d, _, h, p in docs}
    p = {d: r.document_score for d, r in rows.items()}
    corpus = sum(p.values()) / len(p)
    host_n, path_n = collections.Counter(h for h, _ in place.values()), collections.Counter(place.values())
    host_p, path_p = collections.Counter(), collections.Counter()
    for d, at in place.items():
        host_p[at[0]] += p[d]
        path_p[at] += p[d]
    # The strengths follow from two documents and are then the same for all.
    a_of = lambda d: (rows[d].host_posterior * (host_n[place[d][0]] - 1) - host_p[place[d][0]] + p[d]) / (corpus - rows[d].host_posterior)
    a, b = a_of(0), (rows[0].path_posterior * (path_n[place[0]] - 1) - path_p[place[0]] + p[0]) / (rows[0].host_posterior - rows[0].path_posterior)
    for d, r in rows.items():
        h = place[d][0]
        host = (host_p[h] - p[d] + a * corpus) / (host_n[h] - 1 + a)
        assert math.isclose(r.host_posterior, host, rel_tol=1e-6)
        assert math.isclose(r.path_posterior, (path_p[place[d]] - p[d] + b * host) / (path_n[place[d]] - 1 + b), rel_tol=1e-5)
    assert math.isclose(rows[1000].host_posterior, corpus, rel_tol=1e-9) and rows[2].host_posterior < rows[0].host_posterior
    assert rows[1001].score < 0.6 < rows[1000].score
