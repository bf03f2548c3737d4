"""Operator 4, quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic classifier on counts of characters, words and repetitions gives each document its own evidence.  The expected
number of good documents of a path is shrunk towards its host, that of a host towards the whole corpus; how strongly is
estimated from how much hosts, and paths of one host, differ beyond chance.  A document's posterior odds are the odds of
its path, without the document itself, times its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, ship_package
from .common import Numbering, columns_of, map_texts, text_bytes
from .fertility import duplicate_lines, repeated_words
from .toxicity import fit_curve

#: Bound of the sample of labelled rows that the classifier learns from, for each class.
ROWS_PER_CLASS = 10_000
THRESHOLD = 0.5
#: Bounds of the prior strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
N_FEATURES = 14
_SIGNS = np.frombuffer(b"#*$%&|<>", np.uint8)


def features(text: bytes) -> list[float]:
    """Counts of one whole text, put on comparable scales."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * N_FEATURES
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = int(byte[65:91].sum() + byte[97:123].sum() + (byte[0xC2:0xF5]).sum())
    numbers = Numbering()
    ids = numbers.of(words)
    lines = text.count(b"\n") + 1
    most = int(np.bincount(ids).max())
    return [np.log1p(n), size / n, letters / size, byte[65:91].sum() / size, byte[48:58].sum() / size, byte[_SIGNS].sum() / size,
            (byte[33] + byte[63]) / size, (byte[44] + byte[46]) / size, len(numbers) / n, most / n, repeated_words(ids) / n, duplicate_lines(text) / lines,
            np.log1p(lines), lines / n]


@dataclass(frozen=True)
class Classifier:
    centre: np.ndarray
    spread: np.ndarray
    curve: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of good against bad, with the share of good labels as prior."""
        return self.curve[0] + ((x - self.centre) / self.spread) @ self.curve[1:]


def learn(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[Classifier, float]:
    """(classifier, share of good labels) from ``docs`` (doc_id, text) and ``labels`` (doc_id, good)."""
    whole = {r.good: r["count"] for r in labels.groupBy("good").count().collect()}
    share = (whole.get(1, 0) + 1.0) / (sum(whole.values()) + 2.0)
    sample = [labels.filter(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    rows = docs.join(F.broadcast(cut_lineage(sample[0].union(sample[1]))), "doc_id").select("text", F.col("good").cast("int").alias("good"))
    schema = "good int, x array<double>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [list(map(float, features(t))) for t in text_bytes(batch.column("text"))]
        return pa.record_batch([batch.column("good"), pa.array(x, pa.list_(pa.float64()))], names=["good", "x"])

    table = map_texts(rows, work, schema).toArrow()  # as many rows as the sample
    y = table.column("good").to_numpy()
    held = np.array([(y == k).sum() for k in (0, 1)])
    if not held.min():
        return Classifier(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([np.log(share / (1 - share))] + [0.0] * N_FEATURES)), share
    x = np.array(table.column("x").to_pylist())
    centre, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = (np.array([1 - share, share]) * len(y) / held)[y]
    return Classifier(centre, spread, fit_curve((x - centre) / spread, y, weight)), share


def strength(groups: DataFrame, total: str, good: str, towards: Column) -> float:
    """Prior strength in documents by the method of moments: the variance of group means around ``towards`` beyond what
    their sizes explain, every group weighted by its documents."""
    n, m = F.col(total), F.col(good) / F.col(total)
    within = towards * (1 - towards)
    r = groups.filter(n > 0).agg(F.sum(n * (m - towards) ** 2).alias("between"), F.sum(within).alias("by_chance"), F.sum(n * within).alias("within"), F.sum(n).alias("n"),
                                 F.count("*").alias("groups")).first()
    if not r.groups or r.groups < 2 or not r.within:
        return MOST_STRENGTH
    variance = max(0.0, (r.between - r.by_chance) / max(1e-9, r.n - r.n / r.groups))
    return float(np.clip(r.within / r.n / variance - 1 if variance > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH))


EVIDENCE = "doc_id long, host string, path string, log_odds double"


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, modulus: int = 3, held_out: int = 1,
                 rows_per_class: int = ROWS_PER_CLASS, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """doc_id, held_out, document_score, host_posterior, path_posterior, score, kept of every document.

    ``host`` and ``path`` are columns of ``docs``; a null one is an empty name of its own.  Labels are learnt only from rows
    whose crc32(doc_id as text) modulo ``modulus`` is not ``held_out``; null labels and ids are left aside, of several
    labels of one document the least holds.  A null or empty text has no evidence but the prior.  ``document_score`` is the
    classifier alone; the posteriors are means for the host and the path without the document itself.  A row for each input
    row, repeated ones too.  The text is read twice (sample, evidence) and never shuffled; hosts and paths are gathered by
    combining aggregates, whatever their size.
    """
    ship_package(docs.sparkSession)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("good")).filter("doc_id is not null and good is not null")
             .filter(remainder != held_out).groupBy("doc_id").agg((F.min("good") > 0).cast("int").alias("good")))
    classifier, share = learn(rows.select("doc_id", "text"), known, rows_per_class)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    prior = float(np.log(share / (1 - share)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column("text"))
        x = np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)
        odds = np.where([bool(t.split(None, 1)) for t in texts], shared.value.log_odds(x), prior)
        return columns_of(EVIDENCE, doc_id=batch.column("doc_id"), host=batch.column("host"), path=batch.column("path"), log_odds=np.clip(odds, -30, 30))

    own = cut_lineage(map_texts(rows, work, EVIDENCE).withColumn("p", 1 / (1 + F.exp(-F.col("log_odds")))))
    paths = cut_lineage(own.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("p").alias("good_path")))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("good_path").alias("good_host"))
    r = hosts.agg(F.sum("good_host").alias("good"), F.sum("n_host").alias("n")).first()
    corpus = F.lit(r.good / r.n if r.n else share)
    a = strength(hosts, "n_host", "good_host", corpus)
    sites = paths.join(hosts, "host")
    b = strength(sites, "n_path", "good_path", (F.col("good_host") + a * corpus) / (F.col("n_host") + a))
    host_posterior = (F.col("good_host") - F.col("p") + a * corpus) / (F.col("n_host") - 1 + a)
    path_posterior = (F.col("good_path") - F.col("p") + b * F.col("host_posterior")) / (F.col("n_path") - 1 + b)
    logit = F.log(F.col("path_posterior")) - F.log1p(-F.col("path_posterior"))
    return (own.join(sites, ["host", "path"]).withColumn("host_posterior", F.least(F.greatest(host_posterior, F.lit(1e-9)), F.lit(1 - 1e-9)))
            .withColumn("path_posterior", F.least(F.greatest(path_posterior, F.lit(1e-9)), F.lit(1 - 1e-9)))
            .withColumn("score", 1 / (1 + F.exp(-(F.col("log_odds") - F.lit(prior) + logit))))
            .select("doc_id", (remainder == held_out).alias("held_out"), F.col("p").alias("document_score"), "host_posterior", "path_posterior", "score",
                    (F.col("score") >= threshold).alias("kept")))
