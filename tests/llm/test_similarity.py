"""Operators 1, 3 and 8 against SQL and brute force."""

import collections
import itertools
import random
import time

import numpy as np
import pytest

from marginalia.llm import common, decontaminate, odd_minhash, passages
from marginalia.llm.queries import QUERIES
from marginalia.session import cut_lineage, release
from tests.compare import database, difference
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op3_decontaminate", "op8_near_dedup"])
def test_queries_match_sql(spark, name):
    query, sql = QUERIES[name]
    assert difference(spark, database(DATA), DATA, query, sql) is None


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def test_decontaminate_in_blocks(spark, monkeypatch):
    """A benchmark of several blocks finds what one block finds, and so does plain search."""
    rng = random.Random(3)
    items = [(i, words(rng, rng.choice([1, 2, 5, 9, 10, 11, 25]))) for i in range(60)]
    docs = []
    for d in range(40):
        w = words(rng, 60)
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1]
            at, lo = rng.randrange(50), rng.randrange(max(1, len(item) - 9))
            w[at:at + 12] = item[lo:lo + rng.choice([9, 10, 14])]
        docs.append((d, " ".join(w).upper() + "."))
    docs += docs[:3]
    wanted = {}
    for d, text in docs:
        w = text.lower().rstrip(".").split()
        hit, found = set(), set()
        for i, item in items:
            k = min(10, len(item))
            windows = {tuple(item[j:j + k]) for j in range(len(item) - k + 1)}
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in windows:
                    hit.update(range(p, p + k))
                    found.add(str(i))
        wanted[d] = (len(w), hit, sorted(found))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    seen = []
    for size in (decontaminate.BLOCK_BYTES, 1500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        rows = decontaminate.contamination(table, bench).collect()
        assert len(rows) == len(docs)
        for r in rows:
            hit = {p for s in r.spans for p in range(s.start, s.stop)}
            assert (r.n_words, hit, r["items"]) == wanted[r.doc_id]
        seen.append(sorted((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in rows))
        clean = {r.doc_id for r in decontaminate.keep_clean(table, bench).collect()}
        assert clean == {d for d, (_, hit, _) in wanted.items() if not hit}
    # Spans of several blocks may touch where one block has them apart; the words they cover are the same.
    assert [x[:2] for x in seen[0]] == [x[:2] for x in seen[1]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (50, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 0, 100: 100, 101: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(docs, width, percent):
    sets = {d: odd_minhash.exact_set(t.encode(), width) for d, t in docs}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: top(d) for d in sets}


def test_near_duplicate_groups(spark):
    """Groups of near copies whose members are not all links of one another, chains, and copies of short texts."""
    rng = random.Random(11)
    docs, d = [], 0
    for size in (1, 2, 5, 30):
        base = words(rng, 120)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "".join(words(rng, 1))
            docs.append((d := d + 1, " ".join(w)))
    drift = words(rng, 100)
    for _ in range(12):
        drift = drift[4:] + words(rng, 4)
        docs.append((d := d + 1, " ".join(drift)))
    docs += [(d + 1, "a b c"), (d + 2, "A  b C"), (d + 3, "a b"), (d + 4, "a b c d e f g h i j"), (d + 5, "a b c d e f g h i j k"), (d + 6, "x")]
    rng.shuffle(docs)
    wanted = brute_components(docs, 4, 80)
    rows = odd_minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), odd_minhash.Settings(width=4)).collect()
    assert {r.doc_id: r.component_id for r in rows} == wanted
    assert {r.doc_id for r in rows if r.kept} == set(wanted.values())
    kept = odd_minhash.keep_first(spark.createDataFrame(docs, "doc_id long, text string"), odd_minhash.Settings(width=4))
    assert {r.doc_id for r in kept.collect()} == set(wanted.values())


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    settings = odd_minhash.Settings()
    distances = {}
    for similarity in (1.0, 0.9, 0.8, 0.5, 0.0):
        seen = []
        for _ in range(30):
            n = 400
            shared = round(2 * n * similarity / (1 + similarity))
            pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate((pool[:shared], pool[n:2 * n - shared]))
            x, y = (odd_minhash.odd_sketch(odd_minhash.samples_of(s, 128), settings.sketch_longs) for s in (a, b))
            seen.append(sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y))
        distances[similarity] = seen
    means = {k: np.mean(v) for k, v in distances.items()}
    assert means[1.0] == 0 < means[0.9] < means[0.8] < means[0.5] < means[0.0]
    bits, k = 64 * settings.sketch_longs, 128
    for similarity in (0.9, 0.8, 0.5):
        expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * k * (1 - similarity)))
        assert abs(means[similarity] - expected) < 8
    assert max(distances[0.8]) <= settings.most_odd < min(distances[0.0])


def test_compact_windows_by_definition():
    """Each range of the least length has its min-hash position in exactly the window that covers it."""
    rng = np.random.default_rng(2)
    settings = passages.Settings(least_words=12, functions=2)
    sizes = np.array([40, 3, 25, 0, 8])
    shingles = rng.integers(0, 60, sizes.sum()).astype(np.uint64)
    made = passages.compact_windows(shingles, sizes, settings)
    starts = np.cumsum(sizes) - sizes
    for fn, (keys, text, fns, left, centre, right) in enumerate(made):
        low = np.uint64((1 << passages.POSITION_BITS) - 1)
        for t, n in enumerate(sizes):
            own = shingles[starts[t]:starts[t] + n]
            values = (common.mixed(own + common.mixed(np.array([fn + 1], np.uint64))) & ~low) | np.arange(n, dtype=np.uint64)
            windows = [(l, c, r) for k, l, c, r in zip(text, left, centre, right) if k == t]
            assert len(windows) <= max(0, 2 * n)
            for i in range(n):
                for j in range(i + settings.least - 1, min(n, i + settings.least)):
                    c = i + int(values[i:j + 1].argmin())
                    assert sum(l <= i and j <= r and x == c for l, x, r in windows) == 1


def test_common_run_of_any_passage():
    """46 shingles lose 9 at most, which is two edits and three runs; 60 lose 12, three edits and four runs of 12."""
    assert passages.Settings().run == 12 and passages.Settings().gram == 8
    assert passages.Settings(percent=100).run == passages.Settings().least


def test_equal_runs_have_the_same_gram():
    """Every range of ``run`` shingles holds a chosen gram, the same one wherever the range stands; short texts have none."""
    rng = np.random.default_rng(4)
    settings = passages.Settings()
    common_run = rng.integers(1, 2**63, settings.run, dtype=np.uint64)
    texts = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (settings.least, 200, 0, settings.least - 1, 90)]
    texts[1][150:162], texts[4][3:15] = common_run, common_run
    sizes = np.array([len(x) for x in texts])
    hashes, text, place = passages.winnowed_grams(np.concatenate(texts), sizes, settings)
    chosen = {t: dict(zip(place[text == t].tolist(), hashes[text == t].tolist())) for t in range(len(texts))}
    assert not chosen[2] and not chosen[3]
    for t in (0, 1, 4):
        for i in range(sizes[t] - settings.run + 1):
            assert any(k in chosen[t] for k in range(i, i + settings.run - settings.gram + 1))
    inside = lambda t, at: {h for k, h in chosen[t].items() if at <= k <= at + settings.run - settings.gram}
    both = inside(1, 150) & inside(4, 3)
    assert both
    spots = np.array([k for k, h in chosen[1].items() if h in both])
    assert passages.common_places(200, spots, settings)[150:162].all()


def test_repeated_passages(spark):
    rng = random.Random(21)
    passage, other = words(rng, 70), words(rng, 120)
    fresh = lambda n: words(rng, n)
    changed = list(other)
    changed[60] = "changed"
    docs = [(1, fresh(100) + passage + fresh(30)), (2, passage + fresh(200)), (3, fresh(150) + passage), (4, fresh(300)), (5, fresh(20) + other + fresh(20)),
            (6, changed + fresh(5)), (7, fresh(40) + passage[:49] + fresh(40)), (8, fresh(40)), (9, passage + fresh(9) + other)]
    table = spark.createDataFrame([(d, " ".join(w), len(" ".join(w))) for d, w in docs], "doc_id long, text string, n_chars long")
    found = passages.repeated_passages(table).collect()
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start, r.stop))
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8 and r.stop - r.start >= 50
    assert covered[2] == set(range(70)) and covered[3] == set(range(150, 220)) and covered[6] == set(range(120))
    assert covered[9] == set(range(70)) | set(range(79, 199)) and set(covered) == {2, 3, 6, 9}
    left = {r.doc_id: r for r in passages.without_passages(table, passages.repeated_passages(table), length="n_chars").collect()}
    whole = dict((d, w) for d, w in docs)
    assert left[1].text.split() == whole[1] and left[2].text.split() == whole[2][70:] and left[3].text.split() == whole[3][:150] and left[9].text.split() == whole[9][70:79]
    assert all(r.n_chars == len(r.text) for r in left.values())


def windows_of(text):
    hashes = common.shingle_hashes(common.word_hashes([w.encode() for w in text]), 5)
    made = passages.compact_windows(hashes, np.array([len(hashes)]), passages.Settings())
    return {(int(k), fn): int(c) for fn, (keys, _, _, _, centre, _) in enumerate(made) for k, c in zip(keys, centre)}


def in_tasks(spark, docs):
    """The documents of each list in a task of their own."""
    rows = spark.sparkContext.parallelize(docs, len(docs)).flatMap(lambda part: [(d, " ".join(w)) for d, w in part])
    return spark.createDataFrame(rows, "doc_id long, text string")


def covered_words(found):
    covered = collections.defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start, r.stop))
    return covered


def test_passage_behind_an_unrelated_first_text(spark):
    """In each task, a text that shares only the min-hash shingles of a passage stands first in all groups of the passage."""
    rng = random.Random(31)
    passage = words(rng, 60)
    a, b = words(rng, 80) + passage + words(rng, 80), words(rng, 120) + passage + words(rng, 40)
    at_a = windows_of(a)
    both = set(at_a) & set(windows_of(b))
    assert {fn for _, fn in both} == {0, 1, 2, 3}

    def unrelated():
        out = []
        for key in sorted(both):
            while key not in windows_of(piece := words(rng, 60) + a[at_a[key]:at_a[key] + 5] + words(rng, 60)):
                pass
            out += piece
        return out

    found = passages.repeated_passages(in_tasks(spark, [[(1, unrelated()), (11, a)], [(2, unrelated()), (12, b)]])).collect()
    assert covered_words(found) == {12: set(range(120, 180))} and {r.source_doc_id for r in found} == {11}


def test_passage_at_two_places_of_one_document(spark):
    """Both copies are found where the earlier document is in another task."""
    rng = random.Random(33)
    passage = words(rng, 60)
    docs = [[(1, words(rng, 30) + passage + words(rng, 30))], [(2, words(rng, 100) + passage + words(rng, 90) + passage + words(rng, 20))]]
    covered = covered_words(passages.repeated_passages(in_tasks(spark, docs)).collect())
    assert covered == {2: set(range(100, 160)) | set(range(250, 310))}


def test_members_keep_bits_of_what_is_open(spark):
    """A member holds a bit, not a number, for each open position, and spans take bits away wherever they begin and end."""
    bits = lambda *at: np.packbits(np.isin(np.arange(140), at)).tobytes()
    one = lambda doc, left: (7, doc, 1, bool(left), left, 0, 1000, 1005, 1120, 1, 1010, 1015, 1139, 1)
    made = [one(1, bits(3)), one(2, bits(0, 60, 139)), one(3, bits(0, 60, 139)), one(4, bits(5)), one(5, b"")]
    members = spark.createDataFrame(made, passages.MEMBER + ", least long")
    found = spark.createDataFrame([(2, 990, 1070, 1, 0, 80, 1.0), (2, 1100, 1200, 1, 0, 100, 1.0), (3, 990, 1070, 1, 0, 80, 1.0), (5, 0, 2000, 1, 0, 9, 1.0)], passages.FOUND)
    left = {r.doc: (r.open, bytes(r.left)) for r in passages.still_open(members, found, passages.Settings()).collect()}
    assert left == {2: (False, b""), 3: (True, bits(139)), 4: (True, bits(5)), 5: (False, b"")}


def test_release_gives_back_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    release(spark)
    time.sleep(1)
    before = files().size()
    cut_lineage(spark.range(10000).repartition(8, "id").groupBy("id").count()).count()
    assert files().size() > before
    for _ in range(50):
        release(spark)
        if files().size() <= before:
            break
        time.sleep(0.2)
    assert files().size() <= before


def test_passages_by_brute_force(spark, monkeypatch):
    """Every run of fifty words that stands in an earlier document is covered, however tasks and flushes cut the corpus."""
    monkeypatch.setattr(passages, "FLUSH_WINDOWS", 60)
    rng = random.Random(32)
    shared = [words(rng, n) for n in (50, 55, 64, 90, 130)]
    line = words(rng, 12)
    docs = []
    for d in range(40):
        text = words(rng, rng.randrange(30))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            lo = rng.randrange(len(p) - 49)
            text += p[lo:rng.randrange(lo + 50, len(p) + 1)] + rng.choice([line, words(rng, rng.randrange(40))])
        docs.append((d, text))
    covered = covered_words(passages.repeated_passages(in_tasks(spark, [docs[k::5] for k in range(5)])).collect())
    seen = set()
    for d, text in docs:
        runs = {i: tuple(text[i:i + 50]) for i in range(len(text) - 49)}
        assert {w for i, x in runs.items() if x in seen for w in range(i, i + 50)} <= covered[d]
        seen.update(runs.values())


def test_cut_words_keeps_the_rest_byte_for_byte():
    assert passages.cut_words(" a\tb  c é\nd ", [[1, 3]]) == " a\té\nd "
    assert passages.cut_words("a b c", [[0, 3]]) == "" and passages.cut_words("a b c", [[1, 9]]) == "a "
    assert passages.cut_words("a b c d", [[0, 2], [1, 3]]) == "d"
