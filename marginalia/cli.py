"""Command line: ``python -m marginalia.cli --store DIR ingest PATH | ask QUESTION | check | eval FILE``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from .config import Settings
from .operators import evaluation
from .plans import ask, ingest as ing
from .session import build_session, cut_lineage
from .sources.files import read_cases
from .sources.store import Store


def evaluate(spark, store: Store, path: str, settings: Settings):
    """Answer all cases of a file as one batch and report on them."""
    cases = read_cases(spark, path).withColumn("question_id", F.xxhash64("question"))
    started = time.perf_counter()
    answers = cut_lineage(ask.answer_questions(cases.select("question_id", "question").distinct(), ing.memory_of(store), settings))
    spent = time.perf_counter() - started       # of the batch: every case is answered in it
    joined = cases.join(answers, "question_id", "left").withColumn("source_doc_ids", F.array_distinct(F.transform("sources", lambda s: s["doc_id"])))
    return evaluation.report(joined.withColumn("error", F.when(F.col("answer_text").isNull(), "not answered"))
                             .withColumn("source_doc_ids", F.coalesce("source_doc_ids", F.array().cast("array<string>")))
                             .withColumn("latency_seconds", F.lit(spent)))


def main(argv=None):
    parser = argparse.ArgumentParser(prog="marginalia")
    parser.add_argument("--store", required=True)
    parser.add_argument("--master")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("path", nargs="+")
    one.add_argument("--replace", action="store_true")
    sub.add_parser("ask").add_argument("question", nargs="+")
    sub.add_parser("eval").add_argument("file")
    sub.add_parser("check")
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    spark = build_session(master=args.master)
    store = Store(spark, args.store, ing.PARTITIONED)
    if args.command == "ingest":
        rows = ing.ingest(spark, args.path, store, args.replace)
    elif args.command == "ask":
        asked = spark.createDataFrame(list(enumerate(args.question)), "question_id long, question string")
        rows = ask.answer_questions(asked, ing.memory_of(store), settings)
    elif args.command == "eval":
        rows = evaluate(spark, store, args.file, settings)
    else:
        tables = store.tables()
        count = tables["documents"].count() if tables else 0
        rows = spark.createDataFrame([(store.version(), count)], "version int, documents long")
    failed = False
    for line in rows.toJSON().toLocalIterator():
        print(line)
        failed |= json.loads(line).get("status") == "failed"
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
