"""Scoring of answered evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .selection import median_and_share


def case_checks() -> dict[str, Column]:
    """Checks of a case against its response; null where the case does not ask for one.

    Columns: ``expected_terms``, ``expected_doc_ids`` (arrays), ``expect_insufficient``,
    ``answer_text``, ``source_doc_ids`` (array), ``insufficient_evidence``.
    """
    answer = tx.casefold("answer_text")
    return {
        "answer_terms": F.when(F.col("expected_terms").isNotNull(), F.forall(
            "expected_terms", lambda t: F.contains(answer, tx.casefold(t)))),
        "source_documents": F.when(F.col("expected_doc_ids").isNotNull(), F.size(
            F.array_except("expected_doc_ids", "source_doc_ids")) == 0),
        "abstention": F.when(F.col("expect_insufficient").isNotNull(),
                             F.col("insufficient_evidence") == F.col("expect_insufficient")),
    }


def report(results: DataFrame) -> DataFrame:
    """One-row report over all cases; failed cases stay in the denominators.

    Also reads ``error`` (null when answered) and ``latency_seconds``, whose null, NaN and infinite values have no rank.
    One combining aggregate; the median and the nearest-rank 95th percentile are selected by histograms.
    """
    checks = case_checks()
    annotated = F.coalesce(F.col("expected_terms").isNotNull() | F.col("expected_doc_ids").isNotNull()
                           | F.col("expect_insufficient").isNotNull(), F.lit(False))
    passed = annotated
    for check in checks.values():
        passed = passed & F.coalesce(check, F.lit(True))
    fine = F.col("error").isNull()
    median, p95 = median_and_share(results, F.col("latency_seconds"), 95)
    return results.agg(
        F.count("*").alias("total_questions"),
        F.count_if(fine & ~F.coalesce("insufficient_evidence", F.lit(True))).alias("answered"),
        F.count_if(~fine).alias("errors"), F.count_if(annotated).alias("annotated_cases"),
        F.count_if(fine & passed).alias("passed_annotated_cases"),
        F.lit(median).cast("double").alias("median_latency_seconds"), F.lit(p95).cast("double").alias("p95_latency_seconds"))
