"""Operator 11, periodic runs: squares from a suffix automaton whose last occurrences are kept by link-cut access."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Numbering, map_texts, text_bytes

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """Last word of every maximal repetition of at least two periods: {(start, period): end}.

    Words are appended to a suffix automaton.  The suffixes that end at the new word are a path from its state to the
    root of the link tree; the states of the path form segments that share their last earlier occurrence.  A segment
    whose longest string (of L words) last ended p words ago, with p <= L, is a repetition of period p that began p + L
    words back.  p is its smallest period, as a smaller one would have been a later occurrence, and each end of a
    maximal repetition from two periods on shows it, so that its last end is the end of the repetition.

    Segments are the paths of a link-cut forest over the link tree: access() recolours the path to the new state, in
    splay trees ordered by depth whose roots hold the colour (the last end).  n words take O(n log n) steps.
    """
    n, most = len(words), 2 * len(words) + 2
    length, link = array("i", [0]) * most, array("i", [-1]) * most
    # transitions: the first of a state in two arrays, further ones in a dictionary
    label, target, more = array("i", [-1]) * most, array("i", [0]) * most, {}
    up, left, right, colour = array("i", [-1]) * most, array("i", [-1]) * most, array("i", [-1]) * most, array("i", [-1]) * most

    def rotate_up(x: int, y: int, z: int) -> None:
        """x takes the place of its parent y, whose parent is z; z keeps pointing at a child of its own splay tree only."""
        if left[y] == x:
            child = left[y] = right[x]
            right[x] = y
        else:
            child = right[y] = left[x]
            left[x] = y
        if child >= 0:
            up[child] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[x], up[y] = z, x

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z < 0 or (left[z] != y and right[z] != y):
                colour[x] = colour[y]
                rotate_up(x, y, z)
                return
            top = up[z]
            if top < 0 or (left[top] != z and right[top] != z):
                colour[x] = colour[z]
            if (left[z] == y) == (left[y] == x):
                rotate_up(y, z, top)
                rotate_up(x, y, up[y])
            else:
                rotate_up(x, y, z)
                rotate_up(x, z, top)

    found: dict[tuple[int, int], int] = {}
    size, last = 1, 0
    for i in range(n):
        word, new = words[i], size
        size += 1
        length[new] = i + 1
        p = last
        q = -1
        while p >= 0:
            if label[p] == word:
                q = target[p]
                break
            if label[p] < 0:
                label[p], target[p] = word, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {word: new}
                elif word in others:
                    q = others[word]
                    break
                else:
                    others[word] = new
            p = link[p]
        if p < 0:
            q = 0
        elif length[p] + 1 != length[q]:
            clone = size
            size += 1
            length[clone], link[clone], label[clone], target[clone] = length[p] + 1, link[q], label[q], target[q]
            if q in more:
                more[clone] = dict(more[q])
            while p >= 0:
                if label[p] == word:
                    if target[p] != q:
                        break
                    target[p] = clone
                else:
                    others = more.get(p)
                    if others is None or others.get(word) != q:
                        break
                    others[word] = clone
                p = link[p]
            # the clone stands just above q on the path of q, and has occurred where q has
            splay(q)
            above = left[clone] = left[q]
            if above >= 0:
                up[above] = clone
            left[q], up[clone] = clone, q
            link[q] = clone
            q = clone
        link[new] = up[new] = q
        last = new

        below, x = new, q
        while x >= 0:
            splay(x)
            end, longest = colour[x], length[x]
            period = i - end
            if end >= 0 and period <= longest:
                found[i - period - longest + 1, period] = i
            deeper = right[x]
            if deeper >= 0:
                colour[deeper] = end
            right[x] = below
            below, x = x, up[x]
        splay(new)
        colour[new] = i
    return found


def stretches(ids: np.ndarray, starts: np.ndarray, least_length: int, exponent: int) -> list[tuple[int, int]]:
    """Disjoint [from, to) ranges of words that hold every run whole; ``starts`` are the first words of the texts.

    After its first period q every word of a run recurs from at most q words before, over a stretch of at least
    (exponent - 1) * q words.  So a word whose last occurrence in its text is further back than the length of its
    stretch over (exponent - 1) belongs to no such stretch and parts it, until nothing parts any more.  A stretch is
    given with the words of a longest first period before it; ranges that meet are one.
    """
    n = len(ids)
    if not n:
        return []
    order = ids.argsort(kind="stable")
    back = np.full(n, n, np.int64)
    same = ids[order][1:] == ids[order][:-1]
    back[order[1:][same]] = np.diff(order)[same]
    text = np.zeros(n, np.int64)
    text[starts[1:]] = 1
    first = starts[np.cumsum(text)]
    back[np.arange(n) - back < first] = n
    parts = back == n
    parts[starts] = True
    inside = np.flatnonzero(~parts)
    while True:
        # stretches of consecutive words left
        begins = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
        if not len(begins):
            return []
        sizes = np.diff(np.append(begins, len(inside)))
        limit = np.repeat(sizes // (exponent - 1), sizes)
        keep = (back[inside] <= limit) & (np.repeat(sizes + sizes // (exponent - 1), sizes) >= least_length)
        if keep.all():
            break
        inside = inside[keep]
    froms = inside[begins] - sizes // (exponent - 1)
    froms = np.maximum(froms, first[inside[begins]])
    tos = inside[begins] + sizes
    ranges: list[tuple[int, int]] = []
    for start, stop in sorted(zip(froms.tolist(), tos.tolist())):
        if ranges and start < ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(stop, ranges[-1][1]))
        else:
            ranges.append((start, stop))
    return ranges


def runs_of(texts: list[list], least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every text (a list of words), by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = Numbering().of([w for t in texts for w in t])
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, stop in stretches(ids, starts, least_length, exponent):
        at = int(np.searchsorted(starts, start, "right")) - 1
        shift = start - int(starts[at])
        part = Numbering().of(ids[start:stop].tolist())
        found[filled[at]] += [(shift + s, e - s + 1, p) for (s, p), e in squares(part.tolist()).items()
                              if e - s + 1 >= max(least_length, exponent * p)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, stays in zip(words, keep.tolist()) if stays]


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT, doc_id: str = "doc_id", text: str = "text",
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, text)``: stretches of words that repeat with a period, and the text without the repeats.

    Words are what ASCII white space parts.  A run is a stretch of at least ``least_length`` words and of at least
    ``exponent`` (two or more) of its smallest period that neither neighbour extends; ``runs`` has them by start and
    period.  ``text`` holds the words outside runs and those of each run's first period, one space between them.
    ``edit`` gives the words that are searched from an id and the words of its text.

    A null or empty text has no words, no runs and an empty text.  A row for each input row, repeated ones too; a null
    id stays null; other columns are not read.  Nothing is shuffled; a task holds one slice of texts, and the automaton
    of one stretch that may hold runs.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in text_bytes(batch.column("text"))]
        if edit is not None:
            words = [edit(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), words)]
        runs = runs_of(words, least_length, exponent)
        flat = np.array([r for f in runs for r in f], np.int64).reshape(-1, 3)
        offsets = np.zeros(len(runs) + 1, np.int32)
        np.cumsum([len(f) for f in runs], out=offsets[1:])
        spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type))
        kept = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(words, runs)], pa.binary())
        return pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()),
                                pa.ListArray.from_arrays(pa.array(offsets), spans), kept.cast(pa.string())],
                               names=["doc_id", "n_words", "runs", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, work, SCHEMA)
