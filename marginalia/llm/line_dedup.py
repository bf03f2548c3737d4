"""Operator 13, line dedup: hashes of lines in ranges, sorted by document and position; keep bitmaps instead of texts."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage, ship_package
from .common import columns_of, fresh, map_texts, slices, text_bytes

LEAST_CHARS = 40
LEAST_DOCS = 5
LINE, DOCUMENT = 0, 1
HASHED = "kind int, hi long, lo long, doc_id long, digest long, at int"
DROP, OPEN, HOLDER = 0, 1, 2
JUDGED = HASHED
BITMAPS = "doc_id long, digest long, n_lines int, n_dropped int, keep binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for every line with a long enough key, and one for every document (its ``at`` is the number of lines)."""
    import xxhash

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, owner, at, n_lines = [], [], [], []
        for row, text in enumerate(text_bytes(batch.column("text"))):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            for place, line in enumerate(lines):
                if len(line) >= least_chars and long_enough(key := line_key(line), least_chars):
                    hashes.append(xxhash.xxh3_128_digest(key))
                    owner.append(row)
                    at.append(place)
        pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        rows = np.array(owner + list(range(batch.num_rows)), np.int64)
        blank = np.zeros(batch.num_rows, np.int64)
        take = pa.array(rows)
        return columns_of(HASHED, kind=pa.array(np.repeat([LINE, DOCUMENT], [len(owner), batch.num_rows]).astype(np.int32)),
                          hi=pa.array(np.concatenate([pairs[:, 0], blank])), lo=pa.array(np.concatenate([pairs[:, 1], blank])),
                          doc_id=batch.column("doc_id").take(take), digest=batch.column("digest").take(take),
                          at=pa.array(np.array(at + n_lines, np.int32)))

    return map_texts(docs, work, HASHED)


@dataclass
class Group:
    """One hash while its rows pass by: its largest document, the first few, and the rows not judged yet."""

    key: tuple[int, int]
    first: bool                                    # it may have begun in an earlier partition
    docs: list[int] = field(default_factory=list)  # distinct, largest first, at most least_docs of them
    held: list[np.ndarray] = field(default_factory=list)


def judge_range(least_docs: int):
    """Stream of one range partition, sorted by hash, document (largest first) and position.

    A hash that begins and ends inside the partition is judged here.  The first and the last one may go on in the
    partitions beside it: their undecided rows leave as OPEN, with at most ``least_docs`` of their documents as HOLDER.
    Rows wait only until ``least_docs`` documents of their hash have been seen.
    """
    names = [x.split(" ")[0] for x in JUDGED.split(", ")]

    def made(kind: int, rows: np.ndarray):
        """``rows`` has the columns hi, lo, doc_id, digest, at."""
        if len(rows):
            yield pa.record_batch([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(rows[:, i]) for i in range(4)),
                                   pa.array(rows[:, 4].astype(np.int32))], names=names)

    def advance(group: Group, rows: np.ndarray):
        """Further rows of the group."""
        docs = rows[:, 2]
        if len(group.docs) < least_docs:
            new = docs[np.flatnonzero(np.diff(docs, prepend=docs[0] + 1))]
            group.docs += [int(d) for d in new if not group.docs or d != group.docs[-1]][:least_docs - len(group.docs)]
        if group.first:
            yield from made(OPEN, rows)
        elif len(group.docs) >= least_docs:
            for part in (*group.held, rows):
                yield from made(DROP, part[part[:, 2] != group.docs[0]])
            group.held = []
        else:
            group.held.append(rows)

    def close(group: Group | None, at_edge: bool):
        if group is not None and (group.first or at_edge):
            for part in group.held:
                yield from made(OPEN, part)
            yield from made(HOLDER, np.array([(*group.key, d, 0, 0) for d in group.docs], np.int64).reshape(-1, 5))

    def run(batches):
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names[1:]])
            starts = np.flatnonzero((np.diff(table[:, 0], prepend=table[0, 0]) != 0) | (np.diff(table[:, 1], prepend=table[0, 1]) != 0))
            edges = [0, *starts.tolist(), len(table)]
            # groups inside the batch with fewer rows than documents needed cannot drop a line
            for start, stop in zip(edges, edges[1:]):
                key = (int(table[start, 0]), int(table[start, 1]))
                if group is None or group.key != key:
                    if start and stop < len(table) and stop - start < least_docs:
                        continue
                    yield from close(group, False)
                    group = Group(key, group is None)
                yield from advance(group, table[start:stop])
        yield from close(group, True)

    return run


def packed(n_lines: int, dropped: list[int]) -> bytes:
    """Keep bits of a document's lines, first line in the highest bit, compressed."""
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def pack_rows(batches):
    for batch in batches:
        gone, n_lines = batch.column("gone").to_pylist(), batch.column("n_lines").to_pylist()
        yield columns_of(BITMAPS, doc_id=batch.column("doc_id"), digest=batch.column("digest"), n_lines=batch.column("n_lines"),
                         n_dropped=list(map(len, gone)), keep=[packed(n, at) if at else None for n, at in zip(n_lines, gone)])


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, n_lines, n_dropped, keep)``: which lines of each document stay, as a compressed bitmap.

    The key of a line is the line without ASCII white space at its ends and with A-Z lower-cased.  A key of at least
    ``least_chars`` characters that at least ``least_docs`` documents hold stays in the largest ``doc_id`` alone, there at
    all its places.  ``keep`` is null where every line stays.  Keys are compared by 128-bit hashes.

    One row for each distinct (doc_id, text): repeated rows are one document, and so are rows of one id with different
    texts, which have a bitmap each (``digest`` is a hash of the text).  A null or empty text is one empty line.  Rows with
    a null id count for nothing and get no bitmap.  An empty table gives an empty result; other columns are not read.

    Hashes are dealt out in ranges of (hash, document, position), so that the lines of one frequent key go to many tasks
    and arrive sorted.  A task streams its range: it judges every hash that lies inside, and leaves the first and the last
    one open.  Open rows are judged by what at most two hashes of each range say together.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    hashed = cut_lineage(hashed_lines(rows.withColumn("digest", F.xxhash64("text")), least_chars))  # ranges are sampled from it
    order = ["hi", "lo", F.desc("doc_id"), "at", "digest"]
    ranges = hashed.filter(F.col("kind") == LINE).drop("kind").repartitionByRange(*order).sortWithinPartitions(*order)
    judged = cut_lineage(ranges.mapInArrow(judge_range(least_docs), JUDGED))
    holders = judged.filter(F.col("kind") == HOLDER).select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least_docs)
    # at most two hashes of each range partition
    late = judged.filter(F.col("kind") == OPEN).join(F.broadcast(holders), ["hi", "lo"]).filter("doc_id <> keeper")
    place = ["doc_id", "digest", "at"]
    gone = judged.filter(F.col("kind") == DROP).select(*place).union(late.select(*place))
    lines = hashed.filter(F.col("kind") == DOCUMENT).select("doc_id", "digest", F.col("at").alias("n_lines"), F.lit(None).cast("int").alias("at"))
    both = lines.unionByName(gone.withColumn("n_lines", F.lit(None).cast("int")))
    per_doc = both.groupBy("doc_id", "digest").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("at")).alias("gone"))
    return per_doc.mapInArrow(pack_rows, BITMAPS)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The input rows with the lines their bitmaps drop taken out, and the two counts as columns of the given names.

    Rows without a bitmap (a null id) stay whole, and a null text null.  Names must not clash with columns of ``docs``.
    """
    ship_package(docs.sparkSession)
    digest, key, keep = (fresh(name, docs) for name in ("digest", "key_", "keep"))
    found = bitmaps.select(F.col("doc_id").alias(key), F.col("digest").alias(digest + "_"), F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped),
                           F.col("keep").alias(keep))
    joined = docs.withColumn(digest, F.xxhash64(text)).join(
        found, (F.col(doc_id).cast("long") == F.col(key)) & (F.col(digest) == F.col(digest + "_")), "left").drop(key, digest, digest + "_")
    kept = T.StructType([f for f in joined.schema.fields if f.name != keep])
    at = joined.columns.index(text)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                made = text_bytes(batch.column(at))
                counts = []
                for i, (raw, bits, n, d) in enumerate(zip(made, *(batch.column(c).to_pylist() for c in (keep, n_lines, n_dropped)))):
                    if bits is not None:
                        made[i] = b"\n".join([line for line, stays in zip(raw.split(b"\n"), unpacked(bits, n)) if stays])
                    counts.append((n if n is not None else raw.count(b"\n") + 1, d or 0))
                columns = {name: batch.column(name) for name in batch.schema.names if name != keep}
                columns[text] = pa.array(made, pa.binary(), mask=batch.column(at).is_null().to_numpy(zero_copy_only=False)).cast(pa.string())
                for place, name in enumerate((n_lines, n_dropped)):
                    columns[name] = pa.array([c[place] for c in counts], pa.int32())
                yield pa.record_batch(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, kept)
