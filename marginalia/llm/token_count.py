"""Operator 9, token counts: heap-and-linked-list byte-pair merging that counts and emits no identifiers."""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, map_texts, text_bytes
from .pieces import PartCache, Vocabulary, vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def merged_count(part: str, vocab: Vocabulary) -> int:
    """Initial symbols minus merges.  Symbols are a linked list of [start, end) slices; the heap holds adjacent pairs whose
    joined text is a piece, best score first, leftmost among equals.  A character outside the vocabulary stands for its
    UTF-8 bytes and never merges."""
    n, scores = len(part), vocab.scores
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n and (score := scores.get(part[left:end[right]])) is not None:
            heapq.heappush(heap, (-score, left, end[right]))

    symbols = sum(1 if c in scores else len(c.encode()) for c in part)
    for i in range(n - 1):
        offer(i)
    merges = 0
    while heap:
        _, left, reach = heapq.heappop(heap)
        right = after[left] if end[left] else n
        if right >= n or end[right] != reach:
            continue  # one of the two has merged since
        end[left], end[right], after[left] = reach, 0, after[right]
        if after[left] < n:
            before[after[left]] = left
        merges += 1
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    return symbols - merges


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> PartCache:
    vocab = vocabulary(path)
    return PartCache(lambda part: merged_count(part, vocab))


def count_text(text: str, path: str) -> int:
    return sum(map(_counts(path).__getitem__, vocabulary(path).parts(text)))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every whole text under the sentencepiece model at ``path``.

    Returns doc_id, n_bytes, n_tokens, over_limit, a row for each input row.  A null or empty text has no bytes and no
    tokens.  Repeated rows are counted each; a null id stays null; other columns are not read.  ``path`` must name the
    same file on every executor.  Nothing is shuffled; a task holds one slice of texts and a bounded cache of parts.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, counts, parts = text_bytes(batch.column("text")), _counts(path), vocabulary(path).parts
        return columns_of(SCHEMA, doc_id=batch.column("doc_id"), n_bytes=list(map(len, raw)),
                          n_tokens=[sum(map(counts.__getitem__, parts(t.decode()))) for t in raw])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, work, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
