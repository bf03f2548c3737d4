"""Operator 5, LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash
arrays in the shared folder, memory-mapped by the workers.

Words are 64-bit hashes.  A map task counts the bigrams of its texts and sends them, packed and grouped by context, to
shards; a shard adds them up and writes its bigrams as one sorted hash array with counts.  Each shard then sends, for
every word, how often it occurs and after how many contexts, and, for every context, how many followers it has by count;
word shards add these up and write them likewise.  Only a handful of totals for each shard reaches the driver.
"""

from __future__ import annotations

import functools
import os
import tempfile
import urllib.parse
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .common import columns_of, map_texts, mixed, slices, text_bytes, word_hashes

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
MIX = np.uint64(0x9E3779B97F4A7C15)
FLUSH_TOKENS = 2_500_000
#: Followers of one context are dealt to this many shards, so that a very common word does not load one of them.
SPLIT = np.uint64(16)
BIG = 255


def bigram_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * MIX + w)


def shard_of(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(u + w % SPLIT) >> np.uint64(40)).astype(np.int64) % shards


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return (w >> np.uint64(40)).astype(np.int64) % shards


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in their smallest whole-number types, bytes of equal weight together, compressed."""
    import zstandard
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype != np.uint64:
            most = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)
        head += [len(a), a.dtype.itemsize]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpacked(raw: bytes) -> list[np.ndarray]:
    import zstandard
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    count = int(data[:8].view(np.int64)[0])
    head = data[8:8 + 16 * count].view(np.int64)
    out, at = [], 8 + 16 * count
    for n, width in head.reshape(count, 2).tolist():
        part = np.ascontiguousarray(data[at:at + n * width].reshape(width, n).T).reshape(-1)
        out.append(part.view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]))
        at += n * width
    return out


def steps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names for checkpoints, as a path that workers can map into memory."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="marginalia-models-")
    url = urllib.parse.urlparse(named)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is mapped into memory: mount {named} on the workers and name the mounted folder")
    folder = os.path.join(url.path, f"bigrams-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Written aside and renamed, so that a repeated task replaces the file and a lost one leaves none half written."""
    aside = os.path.join(folder, f"{name}.{uuid.uuid4().hex}.part")
    with open(aside, "wb") as f:
        np.save(f, values)
    os.replace(aside, os.path.join(folder, f"{name}.npy"))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, tokens of each text): the words of every text in lower case and one end."""
    lists = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    w = np.full(total, END, np.uint64)
    inner = np.ones(total, bool)
    inner[ends - 1] = False
    w[inner] = word_hashes([x for words in lists for x in words])
    u = np.empty(total, np.uint64)
    u[1:] = w[:-1]
    u[ends - sizes] = BEGIN
    return u, w, sizes


def counted(u: np.ndarray, w: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hashes in order, contexts, words, counts) of distinct bigrams."""
    h = bigram_hash(u, w)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    if counts is None:
        n = np.diff(np.append(first, len(h)))
    else:
        n = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return h[first], u[order[first]], w[order[first]], n


def grouped(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams with each context once."""
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    return packed(steps(u[first]), np.diff(np.append(first, len(u))), w, n)


def ungrouped(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gaps, runs, w, n = unpacked(raw)
    return np.repeat(np.cumsum(gaps), runs), w, n


def sums_by(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sum of each of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values)]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the totals."""
    folder: str
    shards: int
    tokens: int
    distinct: int
    bigrams: int
    texts: int
    of_bigrams: tuple   # discounts by count 1, 2, 3 and more
    of_words: tuple     # the same for numbers of contexts
    spare: float        # what discounting takes from the numbers of contexts, as a share of all bigrams


def discounts(counts_of_counts) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3 and 4.  Where too few are known, half a count."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


SENT = "shard int, payload binary"
STATS = "kind int, a long, b long, c long, d long"


def train(docs: DataFrame, doc_text: str = "text", shards: int | None = None, folder: str | None = None) -> Model:
    """Count every text of ``docs`` and write the model."""
    spark = ship_package(docs.sparkSession)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or shared_folder(spark)

    def count(batches):
        held, size = [], 0

        def flush():
            u, w = (np.concatenate(x) for x in zip(*held))
            _, u, w, n = counted(u, w)
            at = shard_of(u, w, shards)
            order = np.argsort(at, kind="stable")
            u, w, n = u[order], w[order], n[order]
            bounds = np.searchsorted(at[order], np.arange(shards + 1))
            rows = [(k, grouped(u[a:b], w[a:b], n[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
            return columns_of(SENT, shard=[k for k, _ in rows], payload=[x for _, x in rows])

        for batch in batches:
            for part in slices(batch, "text"):
                u, w, _ = tokens_of(text_bytes(part.column("text")))
                held.append((u, w))
                size += len(u)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add_bigrams(key, table):
        parts = [ungrouped(x) for x in table.column("payload").to_pylist()]
        h, u, w, n = counted(*(np.concatenate(x) for x in zip(*parts)))
        shard = key[0].as_py()
        write_array(folder, f"bigram-{shard}", h)
        write_array(folder, f"bigram-count-{shard}", np.minimum(n, BIG).astype(np.uint8))
        large = n >= BIG
        write_array(folder, f"bigram-large-{shard}", h[large])
        write_array(folder, f"bigram-large-count-{shard}", n[large].astype(np.int64))
        rows = [(-1, packed(np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], np.int64)))]
        words, raw, before = sums_by(w, n, np.ones(len(n), np.int64))
        contexts, one, two, more = sums_by(u, n == 1, n == 2, n > 2)
        for keys, values, kind in ((words, (raw, before), 0), (contexts, (one, two, more), 1)):
            at = word_shard(keys, shards)
            order = np.lexsort((keys, at))
            bounds = np.searchsorted(at[order], np.arange(shards + 1))
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if b > a:
                    rows.append((k, packed(np.array([kind], np.int64), steps(keys[order[a:b]]), *(v[order[a:b]] for v in values))))
        return pa.Table.from_batches([columns_of(SENT, shard=[k for k, _ in rows], payload=[x for _, x in rows])])

    def add_words(key, table):
        shard, parts = key[0].as_py(), [unpacked(x) for x in table.column("payload").to_pylist()]
        if shard < 0:
            n = np.sum([p[0].astype(np.int64) for p in parts], axis=0).tolist()
            return pa.Table.from_batches([columns_of(STATS, kind=[0, 1], a=[n[0], n[4]], b=[n[1], 0], c=[n[2], 0], d=[n[3], 0])])
        keys, values = [], []
        for p in parts:
            k = np.cumsum(p[1])
            zero = np.zeros(len(k), np.int64)
            keys.append(k)
            values.append(np.stack([p[2], p[3], zero, zero, zero] if p[0][0] == 0 else [zero, zero, p[2], p[3], p[4]]).astype(np.int64))
        h, raw, before, one, two, more = sums_by(np.concatenate(keys), *np.concatenate(values, axis=1))
        write_array(folder, f"word-{shard}", h)
        write_array(folder, f"word-counts-{shard}", np.stack([raw, before, one, two, more], axis=1))
        kinds = [(2, int(raw.sum()), int((raw > 0).sum()), int(raw[h == END].sum()), 0), (3, *((before == k).sum() for k in (1, 2, 3, 4)))]
        return pa.Table.from_batches([columns_of(STATS, **{c: [int(x[i]) for x in kinds] for i, c in enumerate("kind a b c d".split())})])

    rows = docs.select(F.coalesce(F.col(doc_text), F.lit("")).alias("text"))
    sent = rows.mapInArrow(count, SENT).repartition(shards, "shard").groupBy("shard").applyInArrow(add_bigrams, SENT)
    stats = sent.groupBy("shard").applyInArrow(add_words, STATS).groupBy("kind").agg(*(F.sum(c).alias(c) for c in "abcd"))
    total = {r.kind: (r.a, r.b, r.c, r.d) for r in stats.collect()}  # four rows
    none = (0, 0, 0, 0)
    tokens, distinct, texts, _ = total.get(2, none)
    bigrams, by_contexts = total.get(1, none)[0], total.get(3, none)
    of_words = discounts(by_contexts)
    taken = of_words[0] * by_contexts[0] + of_words[1] * by_contexts[1] + of_words[2] * (distinct - by_contexts[0] - by_contexts[1])
    return Model(folder, shards, tokens, distinct, bigrams, texts, discounts(total.get(0, none)), of_words, taken / max(1, bigrams))


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> np.ndarray | None:
    path = os.path.join(folder, f"{name}.npy")
    return np.load(path, mmap_mode="r") if os.path.exists(path) and os.path.getsize(path) else None


def _places(stored: np.ndarray | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether found) of sorted hashes in a sorted array."""
    if stored is None or not len(stored):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
    return at, stored[at] == wanted


def _by_shard(shard: np.ndarray, h: np.ndarray, shards: int):
    order = np.lexsort((h, shard))
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, order[bounds[k]:bounds[k + 1]]


def word_counts(model: Model, w: np.ndarray) -> np.ndarray:
    """For each distinct word hash: count, contexts before it, followers with count 1, 2 and more."""
    out = np.zeros((len(w), 5), np.int64)
    for k, rows in _by_shard(word_shard(w, model.shards), w, model.shards):
        at, found = _places(_mapped(model.folder, f"word-{k}"), w[rows])
        if found.any():
            out[rows[found]] = _mapped(model.folder, f"word-counts-{k}")[at[found]]
    return out


def bigram_counts(model: Model, u: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.int64)
    for k, rows in _by_shard(shard_of(u, w, model.shards), h, model.shards):
        at, found = _places(_mapped(model.folder, f"bigram-{k}"), h[rows])
        if found.any():
            got = _mapped(model.folder, f"bigram-count-{k}")[at[found]].astype(np.int64)
            large = np.flatnonzero(got == BIG)
            if len(large):
                place, _ = _places(_mapped(model.folder, f"bigram-large-{k}"), h[rows][found][large])
                got[large] = _mapped(model.folder, f"bigram-large-count-{k}")[place]
            out[rows[found]] = got
    return out


def _discounted(n: np.ndarray, by: tuple) -> np.ndarray:
    return np.maximum(n - np.array([0.0, *by])[np.minimum(n, 3)], 0.0)


def log_probabilities(model: Model, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: log10 probability under the model, under the unigram base, and its count.

    The bigram level backs off to numbers of contexts, these to a uniform share of the vocabulary and one unknown word.
    """
    words, at = np.unique(w, return_inverse=True)
    of_word = word_counts(model, words)
    raw, before = of_word[:, 0], of_word[:, 1]
    base = np.log10((raw + 1) / (model.tokens + 1 * (model.distinct + 1)))
    if not model.bigrams:
        return np.full(len(w), -np.log10(model.distinct + 1)), base[at], raw[at]
    lower = _discounted(before, model.of_words) / model.bigrams + model.spare / (model.distinct + 1)
    contexts, cat = np.unique(u, return_inverse=True)
    of_context = word_counts(model, contexts)
    total = np.where(contexts == BEGIN, model.texts, of_context[:, 0])
    left = of_context[:, 2:] @ np.array(model.of_bigrams)
    h = bigram_hash(u, w)
    distinct, first, hat = np.unique(h, return_index=True, return_inverse=True)
    n = bigram_counts(model, u[first], w[first], distinct)[hat]
    whole = total[cat]
    known = whole > 0
    share = np.where(known, left[cat] / np.maximum(whole, 1), 1.0)
    p = np.where(known, _discounted(n, model.of_bigrams) / np.maximum(whole, 1), 0.0) + share * lower[at]
    return np.log10(p), base[at], raw[at]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` has (doc_id, held_out, text)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, w, sizes = tokens_of(text_bytes(batch.column("text")))
        logs, base, raw = log_probabilities(model, u, w)
        first = np.cumsum(sizes) - sizes
        return columns_of(SCORED, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=sizes,
                          n_known=np.add.reduceat((raw > 0).astype(np.int64), first), base_score=np.add.reduceat(base, first), score=np.add.reduceat(logs, first))

    return map_texts(docs, work, SCORED)


def perplexity(docs: DataFrame, modulus: int = 7, held_out: int = 2, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    The model learns from the texts whose crc32(doc_id as text) modulo ``modulus`` is not ``held_out``.  Tokens are words
    between ASCII white space, A-Z in lower case, and one end for each text; a null or empty text is its end alone.  Each
    row counts and is scored, repeated ones too; a null id counts as an empty one.  Other columns are not read.  Where
    nothing is learnt, every token has the probability 1.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == held_out).alias("held_out"),
                       F.col(text).alias("text"))
    model = train(rows.filter(~F.col("held_out")), shards=shards)
    return (score(rows, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
