"""Operator 8, MinHash near-dedup: banded MinHash candidates, odd sketches, exact confirmation.

Each distinct shingle set gets MinHash samples; bands of them are bucket keys.  The samples are also folded into an odd
sketch, a bitmap in which every (position, sample) toggles one bit: the bits in which two sketches differ count the samples
that differ, so similarities near the threshold are told apart from a few machine words.  Sketches discard candidates that
are far below the threshold; what is left is confirmed on the full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import components, fresh, map_texts, mixed, shingle_hashes, slices, text_bytes, word_hashes
from .pieces import PartCache


@dataclass(frozen=True)
class Settings:
    """Five-word shingles at 0.8, unless a contract says otherwise.

    ``bands`` x ``rows`` samples: a pair at 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8.  At 0.8 a pair
    differs in 26 of 128 samples (standard deviation 4.5); ``most_odd`` lies beyond six deviations of the sketch distance
    that this gives, so the sketch discards a true pair with a probability below 1e-9.
    """
    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    sketch_longs: int = 8
    most_odd: int = 100


SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>"
_MULTIPLIERS = 0x9E3779B97F4A7C15
CHUNK = 512


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the shingles; fewer words than a shingle make one, no words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(width, len(words))))


def samples_of(shingles: np.ndarray, count: int) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over a set."""
    if not len(shingles):
        return np.zeros(count, np.uint64)
    k = np.arange(1, count + 1, dtype=np.uint64)
    mult = mixed(k) | np.uint64(1)
    shift = mixed(k + np.uint64(count))
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        # Multiply-add hashing of values that are hashes already; the chunk keeps the table in the processor's cache.
        values = mult[:, None] * shingles[None, at:at + CHUNK]
        values += shift[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray, longs: int) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    bits = mixed(samples * np.uint64(_MULTIPLIERS) + np.arange(len(samples), dtype=np.uint64)) % np.uint64(64 * longs)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = samples.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mixed(key * np.uint64(_MULTIPLIERS) + grid[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_shingles, a 128-bit digest of the shingle set, band keys and odd sketch of each whole text."""
    count = settings.bands * settings.rows

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        PartCache.release()  # reused workers come with the token caches of a stage before
        sizes, hi, lo, bands, sketches = [], [], [], [], []
        lists = [t.lower().split() for t in text_bytes(batch.column("text"))]
        hashes = word_hashes([w for x in lists for w in x])
        at = 0
        for words in lists:
            s = shingle_set(hashes[at:at + len(words)], settings.width)
            at += len(words)
            sizes.append(len(s))
            hi.append(int(mixed(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
            lo.append(int(np.bitwise_xor.reduce(mixed(s ^ np.uint64(_MULTIPLIERS)), initial=np.uint64(0)).view(np.int64)))
            if len(s):
                samples = samples_of(s, count)
                bands.append(band_keys(samples, settings.bands, settings.rows))
                sketches.append(odd_sketch(samples, settings.sketch_longs))
            else:
                bands.append(np.zeros(0, np.int64))
                sketches.append(np.zeros(settings.sketch_longs, np.int64))
        return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                               names=[x.split(" ")[0] for x in SIGNED.split(", ")])

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, SIGNED)


def odd_bits(a: str, b: str, longs: int) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, longs)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def near_enough(settings: Settings, a: str = "a", b: str = "b") -> Column:
    """What sizes and sketches cannot rule out."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (100 * F.least(na, nb) >= settings.percent * F.greatest(na, nb)) & (odd_bits(f"sketch_{a}", f"sketch_{b}", settings.sketch_longs) <= settings.most_odd)


def compared(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) with how many shingles their full sets share, and whether that reaches the similarity.  ``texts``
    has (doc_id, text)."""
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"))

    def run(batches):
        held, known = None, set()
        for batch in batches:
            counts, linked = [], []
            for a, ta, tb in zip(batch.column("a").to_pylist(), text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b"))):
                if (a, ta) != held:
                    held, known = (a, ta), exact_set(ta, settings.width)
                other = exact_set(tb, settings.width)
                shared = len(known & other)
                counts.append(shared)
                linked.append(shared > 0 and 100 * shared >= settings.percent * (len(known) + len(other) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(counts, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, shared long, linked boolean")


def exact_set(text: bytes, width: int) -> set:
    words = text.lower().split()
    if not words:
        return set()
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)}


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where their sets of distinct word shingles have a
    similarity of ``percent`` hundredths or more; the component is the smallest doc_id reachable over links.

    Words are what ASCII white space separates, A-Z in lower case; a text of fewer words than a shingle is one shingle; a
    null or empty text has an empty set and is linked with nothing.  A row for each input row; rows of one doc_id are one
    document, whose links are those of all its texts.  A row without an id is in no component (component_id null) and kept.
    Other columns are not read.  An empty table gives an empty one.

    Equal sets meet in one combining aggregate and go on as one representative.  Every bucket has a leader; each document is
    compared with the leader it shares most bands with, which settles groups of copies of any size in one comparison per
    document.  Then only members of a bucket that are not yet in one component are compared, without those that have too few
    shingles in common with anything.  No pair in a bucket that could be a link is left out, none within a settled group is made.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut_lineage(signatures(rows, settings))
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = ["n_shingles", "set_hi", "set_lo"]
    heads = filled.groupBy(*classes).agg(F.min("doc_id").alias("head"))
    members = filled.join(heads, classes).select("doc_id", "head")
    heads = heads.select(F.col("head").alias("doc_id"), *classes)
    chosen = cut_lineage(filled.join(heads, ["doc_id", *classes]).dropDuplicates(["doc_id", *classes])
                         .select("doc_id", F.col("n_shingles").alias("n"), "bands", "sketch"))
    links = links_between(chosen, rows, settings)
    edges = links.union(members.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
    labels = components(edges)
    labelled = (signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .withColumn("component_id", F.coalesce("component", "doc_id")))
    return labelled.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows, all columns as they are, without those of documents that are near duplicates of one with a smaller
    id.  Rows of one doc_id stay or go together; rows without an id, and empty texts, stay."""
    name = fresh("gone", docs)
    gone = cut_lineage(near_duplicates(docs, settings, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(name), "left_anti")


def links_between(chosen: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """Confirmed links among representatives, enough of them that every linked pair is in one component."""
    spots = chosen.select("doc_id", F.explode("bands").alias("band"))
    sizes = spots.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    near = cut_lineage(spots.join(sizes, "band"))
    texts = cut_lineage(rows.join(near.select("doc_id").distinct(), "doc_id", "left_semi"))
    # The leader of a bucket is the member that stands in the fullest buckets: in a group of copies, what they were made from.
    weights = near.groupBy("doc_id").agg(F.sum(F.log2("size")).alias("weight"))
    weighed = near.join(weights, "doc_id").select("band", "doc_id", "weight")
    leaders = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("leader"))
    led = near.select("doc_id", "band").join(leaders, "band")
    # First: each document with the leader that it shares most bands with.
    shared = led.filter("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("bands"))
    best = shared.groupBy("doc_id").agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("leader"))
    tried = cut_lineage(compared(with_sketches(best.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")), chosen, settings), texts, settings))
    first = tried.filter("linked").select("a", "b")
    label = components(first)
    # Then: members of one bucket in different components, as far as they have enough shingles in common with anything.
    placed = near.select("doc_id", "band").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed_up = (placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("band"))
    unsettled = cut_lineage(placed.join(mixed_up, "band").select("band", "doc_id", "component"))
    asked = unsettled.select("doc_id").distinct()
    led_by = tried.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("ref"), F.min("shared").alias("with_ref"))
    counted = asked.union(led_by.join(asked, "doc_id", "left_semi").select("ref")).distinct()
    alone = unshared(texts.join(counted, "doc_id", "left_semi"), settings.width)
    open_docs = cut_lineage(asked.join(chosen.select("doc_id", "n", "sketch", "bands"), "doc_id").join(alone, "doc_id", "left").join(led_by, "doc_id", "left")
                            .withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).filter(100 * F.col("common") >= settings.percent * F.col("n"))
                            .withColumn("beside", F.col("common") - F.col("with_ref")).drop("alone"))
    left = unsettled.join(open_docs, "doc_id")
    side = lambda x: left.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("component", "n", "sketch", "bands", "common", "ref", "with_ref", "beside")),
                                 F.col("doc_id").alias(x))
    needed = settings.percent * (F.col("n_a") + F.col("n_b"))
    enough = (100 + settings.percent) * F.least("common_a", "common_b") >= needed
    # Two documents compared with one leader share at most the lesser part of the leader, and of what else is not theirs alone.
    by_leader = (100 + settings.percent) * (F.least("with_ref_a", "with_ref_b") + F.least("beside_a", "beside_b")) >= needed
    possible = enough & F.when(F.col("ref_a") == F.col("ref_b"), by_leader).otherwise(F.lit(True)) & ~F.coalesce((F.col("ref_a") == F.col("b")) | (F.col("ref_b") == F.col("a")), F.lit(False))
    once = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("band")
    pairs = (side("a").join(side("b"), "band").filter((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & possible & near_enough(settings) & once)
             .select("a", "b").distinct())
    second = compared(cut_lineage(pairs), texts, settings).filter("linked").select("a", "b")
    return first.union(second)


def unshared(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, alone): how many shingles of a document stand in none of the others.

    Two documents have at most those of the smaller one's shingles in common that are not alone, which rules out what
    shares no more than a much repeated passage.  A combining aggregate by shingle; no shingle is sent back.
    """
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                lists = [t.lower().split() for t in text_bytes(part.column("text"))]
                hashes = word_hashes([w for x in lists for w in x])
                ends = np.cumsum([len(x) for x in lists])
                sets = [shingle_set(hashes[e - len(x):e], width) for x, e in zip(lists, ends)]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(x) for x in sets])
                yield pa.record_batch([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "shingle"])

    one = texts.mapInArrow(run, "doc_id long, shingle long").groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    return one.filter("doc_id = last").groupBy("doc_id").agg(F.count("*").alias("alone"))


def with_sketches(pairs: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    side = lambda x: chosen.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(near_enough(settings)).select("a", "b")
