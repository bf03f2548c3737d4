"""Operator 3, benchmark decontamination: a prefix-filtered set join with exact containment.

Every window of ten item words must occur whole, so in the prefix filter one shingle of a window is necessary: its
rarest.  Shingles are ordered by how often they occur in all documents; documents are joined on the rarest shingle of
each window, candidates whose window would begin before the text or end after it go, and the rest is compared word by
word.  Shingles are packed word numbers, so nothing rests on a hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage, ship_package
from .common import slices, text_bytes

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20
PACK = 21
#: Everything but digits, letters a-z and what is not ASCII separates words; A-Z become a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


@dataclass
class Index:
    """Windows of one block of benchmark items; its size is bounded by BLOCK_BYTES of item text."""
    vocabulary: dict[bytes, int]
    windows: np.ndarray        # window x WINDOW word numbers, 0 beyond its length
    lengths: np.ndarray
    item_at: np.ndarray        # items of window i: items[item_at[i]:item_at[i + 1]]
    items: np.ndarray
    item_ids: list[str]
    keys: np.ndarray = None    # sorted keys of shingles, then of prefix shingles
    key_at: np.ndarray = None  # windows of key i: of_key[key_at[i]:key_at[i + 1]]
    of_key: np.ndarray = None
    offset: np.ndarray = None  # where the prefix shingle stands in its window


def _key(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        key = (key << PACK) | c
    return key


def windows_of(items: list[tuple[str, bytes]]) -> Index | None:
    vocabulary: dict[bytes, int] = {}
    seen: dict[tuple, set] = {}
    names: dict[str, int] = {}
    for name, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for i in range(max(1, len(numbers) - WINDOW + 1) if numbers else 0):
            seen.setdefault(tuple(numbers[i:i + WINDOW]), set()).add(names.setdefault(name, len(names)))
    if not seen:
        return None
    if len(vocabulary) >= 1 << PACK:
        raise ValueError("a block of benchmark items has too many distinct words")
    lengths = np.fromiter(map(len, seen), np.int64, len(seen))
    table = np.zeros((len(seen), WINDOW), np.int64)
    for i, w in enumerate(seen):
        table[i, :len(w)] = w
    counts = np.fromiter(map(len, seen.values()), np.int64, len(seen))
    return Index(vocabulary, table, lengths, np.concatenate(([0], np.cumsum(counts))),
                 np.fromiter((x for s in seen.values() for x in sorted(s)), np.int64, int(counts.sum())), list(names))


def shingles_of(index: Index) -> np.ndarray:
    """Keys of the shingles of every window, window x place; -1 where there is none.  A window shorter than a shingle is
    one shingle."""
    out = np.full((len(index.lengths), WINDOW - SHINGLE + 1), -1, np.int64)
    for place in range(out.shape[1]):
        fits = (place + SHINGLE <= index.lengths) | (place == 0)
        out[fits, place] = _key([index.windows[fits, place + k] for k in range(SHINGLE)])
    return out


def order_by_rarity(index: Index, counts: np.ndarray) -> Index:
    """Keep of every window its rarest shingle; a window with a shingle that no document has can occur nowhere."""
    shingles = shingles_of(index)
    how_often = np.where(shingles >= 0, counts[np.searchsorted(index.keys, np.maximum(shingles, index.keys[0]))], np.iinfo(np.int64).max)
    # Ties go to the smaller key, so that overlapping windows share their prefix shingle.
    ranked = np.where(how_often == how_often.min(axis=1, keepdims=True), shingles, np.iinfo(np.int64).max)
    at = ranked.argmin(axis=1)
    rows = np.arange(len(at))
    live = how_often[rows, at] > 0
    key = shingles[rows, at][live]
    order = np.argsort(key, kind="stable")
    kept = rows[live][order]
    keys, first = np.unique(key[order], return_index=True)
    index.keys, index.key_at, index.of_key, index.offset = keys, np.concatenate((first, [len(kept)])), kept, at
    return index


class Texts:
    """Words of a slice of texts as numbers of the index, one after the other, with the bounds of their text."""

    def __init__(self, texts: list[bytes], vocabulary: dict):
        lists = [words_of(t) for t in texts]
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(self.sizes.sum())
        self.ids = np.zeros(total + WINDOW, np.int64)
        at = 0
        for words in lists:
            self.ids[at:at + len(words)] = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))
            at += len(words)
        self.ends = np.cumsum(self.sizes)
        self.text = np.repeat(np.arange(len(lists)), self.sizes)

    def matches(self, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of keys) of shingles of ``width`` words that stand in ``keys``."""
        n = len(self.text)
        place = np.flatnonzero(self.ids[:n])
        for k in range(1, width):
            place = place[self.ids[place + k] > 0]
        place = place[place + width <= self.ends[self.text[place]]]
        zero = np.zeros(len(place), np.int64)
        key = _key([self.ids[place + k] if k < width else zero for k in range(SHINGLE)])
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[at] == key
        return place[same], at[same]


def _widths(index: Index) -> list[int]:
    return sorted({min(SHINGLE, int(n)) for n in np.unique(index.lengths)})


def find(texts: list[bytes], index: Index) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of every text: number of words, merged spans of words inside occurring windows, item ids in order."""
    t = Texts(texts, index.vocabulary)
    n = len(t.text)
    starts, found = [], []
    for width in _widths(index) if len(index.keys) else []:
        place, key = t.matches(index.keys, width)
        for lo in range(0, len(place), CANDIDATES):
            p, k = place[lo:lo + CANDIDATES], key[lo:lo + CANDIDATES]
            many = index.key_at[k + 1] - index.key_at[k]
            window = index.of_key[np.repeat(index.key_at[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            p = np.repeat(p, many)
            start = p - index.offset[window]
            inside = start >= 0
            inside[inside] = (t.text[start[inside]] == t.text[p[inside]]) & (start[inside] + index.lengths[window[inside]] <= t.ends[t.text[p[inside]]])
            start, window = start[inside], window[inside]
            for j in range(WINDOW):
                same = (index.windows[window, j] == t.ids[start + j]) | (j >= index.lengths[window])
                start, window = start[same], window[same]
            starts.append(start)
            found.append(window)
    spans: list = [[] for _ in texts]
    items: list = [[] for _ in texts]
    if starts and sum(map(len, starts)):
        start, window = np.concatenate(starts), np.concatenate(found)
        # One span for each run of overlapping or touching windows of a text: a word is hit where more windows began than ended.
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + index.lengths[window], -1)
        hit = np.cumsum(depth)[:n] > 0
        begins = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (t.text[1:] != t.text[:-1]))))
        stops = np.flatnonzero(hit & np.concatenate((~hit[1:] | (t.text[1:] != t.text[:-1]), [True]))) + 1
        for b, e in zip(begins.tolist(), stops.tolist()):
            k = int(t.text[b])
            base = int(t.ends[k] - t.sizes[k])
            spans[k].append((b - base, e - base))
        pairs = np.unique(np.stack((t.text[start], window)), axis=1)
        for k, w in pairs.T.tolist():
            items[k].append(w)
        items = [sorted({index.item_ids[i] for w in ws for i in index.items[index.item_at[w]:index.item_at[w + 1]].tolist()}) for ws in items]
    return t.sizes, spans, items


CANDIDATES = 200_000


def index_blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, text: str):
    """Indexes of the benchmark, as many blocks as its size needs, each ordered by the rarity of its shingles in all of
    ``docs``.  The driver holds one block at a time."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    held = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(held / BLOCK_BYTES))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        index = windows_of([(r.item, r.text.encode()) for r in rows.collect()])
        if index is None:
            continue
        shingles = shingles_of(index)
        index.keys = np.unique(shingles[shingles >= 0])
        counts = np.zeros(len(index.keys), np.int64)
        for r in count_shingles(docs, index, text).collect():  # at most a row for each shingle of the block
            counts[r.key] = r.n
        yield order_by_rarity(index, counts)


def count_shingles(docs: DataFrame, index: Index, text: str) -> DataFrame:
    """How often each shingle of the index occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        counts = np.zeros(len(index.keys), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                t = Texts(text_bytes(part.column("text")), index.vocabulary)
                for width in _widths(index):
                    counts += np.bincount(t.matches(index.keys, width)[1], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["key", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans, items: where the windows of benchmark items occur in each document.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.  A window is ten consecutive words of
    an item; an item of fewer is one window.  ``spans`` are merged ranges of hit words, ``items`` the ids, as strings in
    order, of items with an occurring window.  A null text has no words; an empty benchmark, a null item or item text hits
    nothing.  A row for each input row, repeated ones too; a null id stays null; other columns are not read.

    Two scans of the documents for each block of the benchmark (counting, finding), no shuffle of documents.  A benchmark
    beyond BLOCK_BYTES is taken in several blocks, whose findings are merged by document.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = list_found(rows, benchmark, item_id, item_text)
    first = next(blocks, None)
    if first is None:
        return _found(rows, None).drop("digest")
    second = next(blocks, None)
    if second is None:
        return first.drop("digest")
    every = cut_lineage(first).unionByName(cut_lineage(second))
    for more in blocks:
        every = every.unionByName(cut_lineage(more))
    # Equal rows of documents found the same in every block: they are merged once and multiplied again.
    ordered = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = F.aggregate(ordered, F.expr("cast(array() as array<struct<start:long,stop:long>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))
    merged = (every.groupBy("doc_id", "digest", "n_words", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count("*").alias("copies"))
              .groupBy("doc_id", "digest", "n_words").agg(joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                                                          F.max("copies").alias("copies")))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_words", "spans", "items")


def list_found(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str):
    for number, index in enumerate(index_blocks(rows, benchmark, item_id, item_text, "text")):
        yield _found(rows, index).withColumn("block", F.lit(number))


def _found(rows: DataFrame, index: Index | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = text_bytes(part.column("text"))
                if index is None:
                    sizes, spans, items = [len(words_of(t)) for t in texts], [[]] * len(texts), [[]] * len(texts)
                else:
                    sizes, spans, items = find(texts, index)
                yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()),
                                       pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string())),
                                       part.column("digest")], names=["doc_id", "n_words", "spans", "items", "digest"])

    return rows.withColumn("digest", F.xxhash64("text")).select("doc_id", "text", "digest").mapInArrow(run, FOUND + ", digest long")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The input rows, all columns as they are, in which no benchmark window occurs."""
    ship_package(docs.sparkSession)
    kept = docs
    for number, index in enumerate(index_blocks(docs, benchmark, item_id, item_text, text)):
        kept = _without(cut_lineage(kept) if number else kept, index, text)
    return kept


def _without(docs: DataFrame, index: Index, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                _, spans, _ = find(text_bytes(part.column(text)), shared.value)
                yield part.filter(pa.array([not s for s in spans], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
