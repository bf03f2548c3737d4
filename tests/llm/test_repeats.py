"""Periodic runs, vantage-point clusters and line dedup against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import line_dedup, queries, runs, vantage
from tests.llm.test_edges import ROWS, SCHEMA


# --- periodic runs ----------------------------------------------------------

def brute_runs(words, least, exponent):
    """Every stretch of equal words p apart, kept if no smaller period covers it."""
    out, n = [], len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, exponent * p) and not any(
                    all(words[k] == words[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(rng):
    words = [rng.choice("abcdefghijklmnopqrst"[:rng.choice([1, 2, 3, 5, 20])]) for _ in range(rng.randint(0, 70))]
    if len(words) > 12 and rng.random() < 0.6:
        a, p = rng.randrange(len(words) - 9), rng.randint(1, 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (7, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(exponent)
    texts = [made_words(rng) for _ in range(600)]
    assert runs.runs_of(texts, least, exponent) == [brute_runs(t, least, exponent) for t in texts]


def test_squares_of_long_words():
    assert runs.squares([1] * 3000) == {(0, 1): 2999}
    assert runs.squares([i % 7 for i in range(3000)]) == {(0, 7): 2999}
    # Fibonacci words hold runs of every Fibonacci period
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    got = sorted((s, e - s + 1, p) for (s, p), e in runs.squares(b).items())
    assert got == sorted(brute_runs(b, 2, 2))


def digest_row(doc_id, text):
    words = queries.looped(doc_id, (text or "").encode().split())
    words = [w.decode() for w in words]
    found = brute_runs(words, 6, 4)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, None if i % 17 == 0 else rng.choice([" ", "\n", "\t\v"]).join(made_words(rng))) for i in range(400)]
    rows += [(1001, "x y " * 9), (1002, "ü " * 8), (1003, ""), (1004, " \t"), (1005, "a b c d e " * 4 + "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert {r.doc_id: tuple(r) for r in got} == {i: digest_row(i, t) for i, t in rows}
    looped = [i for i, t in rows if t and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(looped) > 20 and {r.doc_id for r in got if r.n_runs} & set(looped)


def test_runs_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_words == by_id[2].n_words == by_id[7].n_words == 0 and by_id[2].text == "" and by_id[2].runs == []
    assert by_id[4].n_words == 60_000 and by_id[4].runs == [] and by_id[6].text == "the same few words here"
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")
    row = runs.periodic_runs(long).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 1)] and row.text == "la"


# --- clusters ---------------------------------------------------------------

def brute_clusters(vectors, k, rounds, seeds):
    """vectors: {id: integer list}; seeds: ids in order."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], object)
    centroids = [vectors[i] for i in seeds[:k]]

    def assign():
        out = []
        for row in x:
            d = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
            out.append((min(d), d.index(min(d))))
        return out
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            mine = [x[n] for n, (_, own) in enumerate(at) if own == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return {i: (own, d) for i, (d, own) in zip(ids, assign())}, centroids


@pytest.mark.parametrize("k", [1, 3, 20])
def test_clusters_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    points = rng.integers(-6, 6, (300, 5)) / 2.0 - 0.25     # many ties and equal vectors
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assigned, centroids = vantage.cluster(df, k, F.col("vec_id") * -1, rounds=4, dimensions=5, scale=4.0)
    want, final = brute_clusters({i: [int(np.floor(4 * v)) for v in p] for i, p in rows}, k, 4, sorted(range(300), reverse=True))
    assert {r.vec_id: (r.cluster, r.distance) for r in assigned.collect()} == want
    assert centroids.tolist() == [list(map(int, c)) for c in final]


def test_tree_is_exact_on_ties():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 9, 60):
        centroids = rng.integers(-3, 4, (k, 3))
        x = rng.integers(-4, 5, (500, 3))
        number, best = vantage.VantageTree(centroids).nearest(x)
        d = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (number == d.argmin(1)).all()
    far = np.array([[1 << 27] * 64, [-(1 << 27)] * 64])
    number, best = vantage.VantageTree(far).nearest(far)
    assert number.tolist() == [0, 1] and best.tolist() == [0, 0]


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster string, distance string, vector string"
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [0.5, 0.5]), (None, [9.0, 9.0]), (8, [-1.0, 0.1])]
    df = spark.createDataFrame([(*r, "a", None, "b") for r in bad + good], schema)
    assigned, centroids = vantage.cluster(df, 8, F.col("vec_id"), dimensions=2)
    got = vantage.with_inertia(assigned, centroids).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 7)] * 3 + [(False, 8), (True, 0)]
    assert {r.distance for r in got} == {0} and {r.inertia for r in got} == {0}     # as many centroids as vectors
    assert len({r.cluster for r in got}) == 4                                        # equal vectors: the smaller number
    for none in (df.limit(0), df.filter("vec_id < 7")):
        assigned, centroids = vantage.cluster(none, 8, F.col("vec_id"), dimensions=2)
        assert vantage.with_inertia(assigned, centroids).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vantage.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 1, F.col("vec_id"), dimensions=2)


# --- lines ------------------------------------------------------------------

def brute_lines(rows, least_chars=40, least_docs=5):
    holders = {}
    key = lambda line: line.encode().strip().lower().decode()
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = lambda i, line: len(k := key(line)) >= least_chars and len(holders[k]) >= least_docs and i != max(holders[k])
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not gone(i, x)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def line_rows(n=500, seed=2):
    """One line that a third of all rows are, lines of four, five and six documents, repeats within a document."""
    rng = random.Random(seed)
    common = "This one line stands in nearly every document of the table"
    shared = [f"shared line number {i} with some more words behind it" for i in range(n // 4)]
    rows = []
    for i in range(n):
        lines = [common] * rng.randint(0, 3) + rng.sample(shared, rng.randint(0, 4)) + [f"own {i}", "short", ""]
        lines += [rng.choice(shared).upper() + " \t"] * rng.randint(0, 2) + ["ä" * 39, "ä" * 40, "Ä" * 40]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, common)]


@pytest.mark.parametrize("width", ["1", "4", "31"])
def test_lines_equal_brute_force(spark, tmp_path, width):
    rows = line_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in queries.op13_line_dedup(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_lines(rows)
    assert sum(r[2] for r in got) > 800


def test_bitmaps(spark):
    line = "x" * 45
    rows = [(i, f"a\n{line}\nb" if i % 2 else line) for i in range(6)]
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert line_dedup.unpacked(maps[1].keep, 3).tolist() == [True, False, True] and maps[1].n_dropped == 1
    assert line_dedup.unpacked(maps[4].keep, 1).tolist() == [False]
    assert maps[5].keep is None and maps[5].n_lines == 3
    assert line_dedup.unpacked(line_dedup.packed(20, [0, 19]), 20).tolist() == [False] + [True] * 18 + [False]


def test_line_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    assert out.columns == docs.columns + ["n_lines", "n_dropped"]
    assert {r.n_dropped for r in out.collect()} == {0} and out.count() == len(ROWS)
    assert line_dedup.drop_lines(docs.limit(0), line_dedup.keep_bitmaps(docs.limit(0))).count() == 0
    # a line in four documents and in rows without an id; repeated rows and two texts of one id are one document
    line = "the very same line of more than forty characters"
    rows = [(1, line), (1, line), (1, f"{line}\nmore"), (2, line), (3, line), (4, line), (None, line), (None, line)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.keep_bitmaps(few).filter("n_dropped > 0").count() == 0
    five = few.union(spark.createDataFrame([(5, line)], few.schema))
    left = line_dedup.drop_lines(five, line_dedup.keep_bitmaps(five)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, line), (0, line), (1, ""), (1, ""), (1, "more"), (2, ""), (3, ""), (4, ""), (5, line)]
