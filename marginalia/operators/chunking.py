"""Cleaned text to chunks.

A document is one row from start to end, so chunking a corpus needs no shuffle.
Paragraphs and headings are array expressions on that row; near-duplicate removal,
packing and overlap follow in one Python step.  That step reads one column, once:
what stands below it in the plan is evaluated again for every other mention.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from difflib import SequenceMatcher
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .. import config
from ..functions import text as tx
from ..functions.rows import spread_array

PIECES = T.ArrayType(T.StructType([T.StructField("section", T.StringType()),
                                   T.StructField("text", T.StringType())]))
_BREAK = re.compile(r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])""")


def near_duplicates(texts) -> list[bool]:
    """True for every text that closely repeats an earlier kept one.

    The character-matching ratio is costly, so two exact upper bounds come first: kept
    texts are looked up by the lengths that can reach the limit, then by shared
    characters.  Only candidates above the limit on both are compared.
    """
    limit = config.DUPLICATE_SIMILARITY
    drop, seen, kept = [], set(), []
    by_length: dict[int, list[int]] = {}
    lengths: list[int] = []                    # sorted
    counts, at = np.empty((64, 256), np.int32), {}     # of the kept texts that were compared so far

    def profile(text):
        return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 256, minlength=256).astype(np.int32)

    for text in texts:
        if text in seen:
            drop.append(True)
            continue
        size = len(text)
        low, high = math.floor(size * limit / (2 - limit)), math.ceil(size * (2 - limit) / limit)
        near = lengths[bisect_left(lengths, low):bisect_right(lengths, high)]
        close = [i for n in near if 2 * min(n, size) / max(n + size, 1) >= limit for i in by_length[n]]
        repeated = False
        if close:
            for i in close:
                if i not in at:
                    if len(at) == len(counts):
                        counts = np.concatenate((counts, np.empty_like(counts)))
                    counts[len(at)] = profile(kept[i])
                    at[i] = len(at)
            total = np.array([len(kept[i]) for i in close]) + size
            shared = np.minimum(counts[[at[i] for i in close]], profile(text)).sum(axis=1)
            alike = np.flatnonzero(2 * shared / np.maximum(total, 1) >= limit)
            repeated = any(SequenceMatcher(None, text, kept[close[i]]).ratio() >= limit for i in alike)
        drop.append(repeated)
        if not repeated:
            seen.add(text)
            if size not in by_length:
                insort(lengths, size)
            by_length.setdefault(size, []).append(len(kept))
            kept.append(text)
    return drop


def pack(sizes, target: int) -> list[int]:
    """Group number of every sentence: a group closes before it would pass ``target`` words."""
    groups, current, used = [], 0, 0
    for size in sizes:
        if used and used + size > target:
            current, used = current + 1, 0
        groups.append(current)
        used += size
    return groups


def split_long(text: str) -> list[str]:
    """Pieces of at most the maximum word count, cut at sentence ends where possible."""
    longest = config.MAX_CHUNK_WORDS
    if len(text.split()) <= longest:
        return [text]
    pieces, run = [], []

    def flush():
        groups = pack([size for _, size in run], config.TARGET_CHUNK_WORDS)
        for g in range(groups[-1] + 1 if groups else 0):
            pieces.append(" ".join(s for (s, _), mine in zip(run, groups) if mine == g))
        run.clear()

    for sentence in filter(None, map(str.strip, _BREAK.split(text))):
        words = sentence.split()
        if len(words) <= longest:
            run.append((sentence, len(words)))
            continue
        flush()
        pieces += [" ".join(words[i:i + longest]) for i in range(0, len(words), longest)]
    flush()
    return pieces


def merge_small(pieces: list[tuple], ahead: bool = True) -> list[tuple]:
    """Join a short piece with what follows in its section, unless ``ahead`` is off; a short tail joins backwards."""
    small, longest = config.MIN_CHUNK_WORDS, config.MAX_CHUNK_WORDS
    out: list[list] = []                       # [section, [texts], words]
    for section, text in pieces:
        size = len(text.split())
        last = out[-1] if out else None
        if ahead and last and last[0] == section and last[2] < small and last[2] + size <= longest:
            last[1].append(text)
            last[2] += size
        else:
            out.append([section, [text], size])
    if len(out) > 1:
        previous, tail = out[-2:]
        if tail[2] < small and tail[0] == previous[0] and previous[2] + tail[2] <= longest:
            previous[1] += tail[1]
            out.pop()
    return [(section, "\n\n".join(texts)) for section, texts, _ in out]


def last_sentence(text: str) -> str:
    """What follows the last sentence end; the text is searched from its end."""
    text = text.strip()
    reach = 500
    while True:
        begin = max(0, len(text) - reach)
        ends = [m.end() for m in _BREAK.finditer(text, begin)]
        if ends or not begin:
            return text[ends[-1]:] if ends else text
        reach *= 8


def add_overlap(pieces: list[tuple]) -> list[tuple]:
    """Prefix the last sentence of the previous piece of the same section, if it fits."""
    out = pieces[:1]
    for (before, previous), (section, text) in zip(pieces, pieces[1:]):
        tail = last_sentence(previous) if before == section else ""
        fits = tail and len(tail.split()) + len(text.split()) <= config.MAX_CHUNK_WORDS
        out.append((section, f"{tail} {text}" if fits else text))
    return out


def _folded(units: pd.Series, initial: pd.Series, ahead: bool) -> pd.Series:
    """Chunks from paragraphs: headings, near-duplicates, cutting, merging and overlap.  A heading stands behind ``#``,
    any other paragraph behind a blank."""
    def one(units, section):
        if units is None:
            return None
        bodies = []
        for unit in units:
            if unit[0] == "#":
                section = unit[1:]
            else:
                bodies.append((section, unit[1:]))
        repeats = near_duplicates(re.sub(r"\W+", " ", t.lower()).strip() for _, t in bodies) if len(bodies) > 1 else [False]
        pieces = [(s, part) for (s, t), again in zip(bodies, repeats) if not again for part in split_long(t)]
        return [{"section": s, "text": t} for s, t in add_overlap(merge_small(pieces, ahead))]
    return pd.Series([one(u, s) for u, s in zip(units, initial)], dtype=object)


@F.pandas_udf(PIECES)
def _fold(units: pd.Series, initial: pd.Series) -> pd.Series:
    return _folded(units, initial, True)


@F.pandas_udf(PIECES)
def _fold_tails(units: pd.Series, initial: pd.Series) -> pd.Series:
    return _folded(units, initial, False)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def near_duplicate_flags(paragraphs: pd.Series) -> pd.Series:
    """For every paragraph of an array whether it closely repeats an earlier kept one."""
    return paragraphs.map(lambda ps: None if ps is None else near_duplicates(
        re.sub(r"\W+", " ", p.lower()).strip() for p in ps))


def propagate_headings(paragraphs: DataFrame, order: str = "position", by: str = "doc_id") -> DataFrame:
    """Body paragraphs with the nearest heading above them; headings are consumed.

    For paragraphs that already are rows; a document is bounded, so its window is.
    """
    above = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    titled = paragraphs.withColumn("_title", tx.heading_text("text"))
    return (titled.withColumn("section", F.last("_title", ignorenulls=True).over(above))
            .filter(F.col("_title").isNull()).drop("_title"))


def last_heading(paragraphs: Column) -> Column:
    titles = F.filter(F.transform(paragraphs, tx.heading_text), lambda t: t.isNotNull())
    return F.try_element_at(titles, F.lit(-1))


def chunk_pieces(docs: DataFrame, text: str = "text", section: str | None = None, ahead: bool = True) -> DataFrame:
    """Add ``pieces``: the chunks of every (already cleaned) text, in order.

    ``ahead=False`` leaves a short piece alone unless it is the last, which joins backwards.
    """
    fold = _fold if ahead else _fold_tails
    initial = F.col(section) if section else F.lit(None).cast("string")
    kept = F.filter(tx.paragraphs(text), lambda p: ~tx.is_junk(p))
    units = F.transform(kept, lambda p: F.coalesce(F.concat(F.lit("#"), tx.title_of(p)), F.concat(F.lit(" "), p)))
    return docs.withColumn("pieces", fold(units, initial))


def chunk_documents(docs: DataFrame, ahead: bool = True) -> DataFrame:
    """``(doc_id, chunk_index, section, text)`` from cleaned ``(doc_id, text)``."""
    flat = spread_array(chunk_pieces(docs, ahead=ahead), ["doc_id"], "pieces", "_p", "chunk_index")
    return flat.select("doc_id", "chunk_index", F.col("_p.section").alias("section"),
                       F.col("_p.text").alias("text"))


def page_start_sections(pages: DataFrame) -> DataFrame:
    """Add ``section``: the heading in force when a page begins (``page`` orders a document)."""
    before = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    headed = pages.withColumn("_last", last_heading(tx.paragraphs("text")))
    return headed.withColumn("section", F.last("_last", ignorenulls=True).over(before)).drop("_last")


def page_sections(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, section)``: nearest heading up to and including each raw page."""
    upto = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    headed = pages.select("doc_id", "page", last_heading(tx.paragraphs("text")).alias("_last"))
    return headed.select("doc_id", "page", F.last("_last", ignorenulls=True).over(upto).alias("section"))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks that stay on their page; only the heading carries over."""
    cut = chunk_pieces(page_start_sections(pages), section="section")
    flat = spread_array(cut, ["doc_id", "page"], "pieces", "_p", "position")
    return flat.select("doc_id", "page", "position", F.col("_p.section").alias("section"),
                       F.col("_p.text").alias("text"))
