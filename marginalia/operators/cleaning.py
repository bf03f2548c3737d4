"""Document cleaning across pages.

A page is one row ``(doc_id, page, text)``.  Repeated headers and footers are found
from the at most four edge lines of each page; the page bodies are never exploded
or regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from ..functions import text as tx
from ..functions.rows import spread_array


def edge_positions(lines: Column) -> Column:
    """0-based positions of the first and last two non-blank lines."""
    filled = F.filter(F.transform(lines, lambda line, i: F.when(tx.strip(line) != "", i)),
                      lambda i: i.isNotNull())
    n = config.EDGE_LINES
    tail = F.slice(filled, F.greatest(F.size(filled) - n + 1, F.lit(1)), n)
    return F.array_distinct(F.concat(F.slice(filled, 1, n), tail))


def repeated_edge_lines(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n_pages, repeated)``: line keys at the edges of over half of a document's pages.

    A page adds at most four keys and a key needs over half of the pages, so
    ``repeated`` has fewer than eight elements whatever the document size.
    """
    lines = F.split(text, "\n")
    staged = (pages.withColumn("_lines", lines).withColumn("_edges", edge_positions(F.col("_lines"))))
    keys = F.array_distinct(F.transform("_edges", lambda i: tx.line_key(F.get("_lines", i))))
    edges = spread_array(staged, [doc], keys, "_key")
    counted = edges.groupBy(doc, "_key").agg(F.count("*").alias("_seen"))
    totals = pages.groupBy(doc).agg(F.count("*").alias("n_pages"))
    frequent = (counted.join(totals, doc)
                .filter((F.col("n_pages") >= config.MIN_FURNITURE_PAGES) & (F.col("_key") != "")
                        & (F.col("_seen") > F.col("n_pages") * config.FURNITURE_RATIO))
                .groupBy(doc).agg(F.array_sort(F.collect_set("_key")).alias("repeated")))
    return (totals.join(frequent, doc, "left")
            .withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>"))))


def remove_page_furniture(pages: DataFrame, doc: str = "doc_id", text: str = "text",
                          out: str = "text") -> DataFrame:
    """Drop repeated edge lines and page numbers; documents of one page are kept as they are."""
    known = repeated_edge_lines(pages, doc, text)
    joined = pages.join(known, doc, "left")
    staged = (joined.withColumn("_lines", F.split(text, "\n"))
              .withColumn("_edges", edge_positions(F.col("_lines"))))
    kept = F.filter("_lines", lambda line, i: ~(F.array_contains("_edges", i) & (
        line.rlike(tx.PAGE_NUMBER) | F.array_contains("repeated", tx.line_key(line)))))
    body = F.when((F.col("n_pages") >= 2) & (F.size("_edges") > 0), F.array_join(kept, "\n")).otherwise(F.col(text))
    return staged.withColumn(out, body).drop("repeated", "n_pages", "_lines", "_edges")


def join_pages(df: DataFrame, pages: str = "pages", out: str = "text") -> DataFrame:
    """One text from an ordered array of pages; a finished sentence ends a paragraph."""
    trimmed = F.filter(F.transform(pages, lambda p: F.btrim(p, F.lit("\n"))), lambda p: p.rlike(r"(?U)\S"))
    glued = F.transform("_trimmed", lambda p: F.concat(
        p, F.when(p.rlike(r"""(?U)[.!?"]\s*\z"""), "\n\n").otherwise("\n")))
    return (df.withColumn("_trimmed", trimmed)
            .withColumn(out, F.btrim(F.array_join(glued, ""), F.lit("\n"))).drop("_trimmed"))


def repair_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.withColumn(text, tx.strip_invisible(tx.normalize_encoding(text)))


def clean_documents(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: all pages repaired, stripped of furniture, joined and tidied.

    A document is bounded by the upload limit, so collecting its pages is bounded too.
    """
    body = remove_page_furniture(repair_pages(pages))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    merged = body.groupBy("doc_id").agg(F.transform(ordered, lambda p: p["text"]).alias("_pages"))
    return join_pages(merged, "_pages", "_joined").select("doc_id", tx.tidy("_joined").alias("text"))


def clean_page_texts(pages: DataFrame) -> DataFrame:
    """Page-preserving form.  The reference list is located on the joined document and every
    page is clipped at that point."""
    body = remove_page_furniture(repair_pages(pages))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = body.groupBy("doc_id").agg(ordered.alias("_pages"))
    joined = F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n")
    start = tx.last_references_start(joined)
    cut = F.when(start > F.length(joined) * config.REFERENCES_MIN_POSITION, start)
    whole = whole.withColumn("_cut", cut).withColumn("_offsets", F.transform("_pages", lambda p, i: F.aggregate(
        F.slice("_pages", 1, i), F.lit(0), lambda acc, q: acc + F.length(q["text"]) + 2)))
    flat = whole.select("doc_id", "_cut", F.explode(F.arrays_zip("_pages", "_offsets")).alias("_p"))
    page_text, offset = F.col("_p._pages.text"), F.col("_p._offsets")
    clipped = F.when(F.col("_cut").isNull(), page_text).otherwise(
        F.substr(page_text, F.lit(1), F.greatest(F.lit(0), F.col("_cut") - offset)))
    return flat.select("doc_id", F.col("_p._pages.page").alias("page"),
                       tx.tidy(clipped, cut_references=False).alias("text"))
