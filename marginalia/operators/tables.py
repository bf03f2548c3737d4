"""Parsed tables to retrievable text.

A table is a value ``struct<rows, caption, page, section>`` as large as its file allows.
Squaring the grid is a small Arrow function; rendering and grouping are array expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config
from ..functions import text as tx
from ..functions.rows import spread_array

TABLE = "struct<rows:array<array<string>>,caption:string,page:int,section:string>"
_NUMERIC_CELL = r"(?U)^[\s\-+$€£%.,0-9]+\z"


def take_captions(text: Column, count: Column) -> Column:
    """``struct(text, captions)``: the first ``count`` caption lines leave the prose."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda line, i: F.struct(line.alias("line"), tx.caption(line).alias("caption"),
                                                         i.alias("at")))
    chosen = F.slice(F.filter(marked, lambda m: m["caption"].isNotNull()), F.lit(1), count)
    places = F.transform(chosen, lambda m: m["at"])
    prose = F.filter(lines, lambda line, i: ~F.array_contains(places, i))
    padding = F.array_repeat(F.lit(None).cast("string"), (count - F.size(chosen)).cast("int"))
    return F.struct(F.array_join(prose, "\n").alias("text"),
                    F.concat(F.transform(chosen, lambda m: m["caption"]), padding).alias("captions"))


def merge_continuations(tables: Column) -> Column:
    """Append uncaptioned tables of equal width that start at most one page after the run did."""
    def step(done, t):
        last = F.try_element_at(done, F.lit(-1))
        joins = ((F.size(done) > 0) & (F.size(last["rows"]) > 0) & (F.size(t["rows"]) > 0)
                 & (F.size(F.get(last["rows"], F.lit(0))) == F.size(F.get(t["rows"], F.lit(0))))
                 & (t["page"] - last["page"] <= 1) & (F.coalesce(t["caption"], F.lit("")) == ""))
        grown = F.struct(F.concat(last["rows"], t["rows"]).alias("rows"), last["caption"].alias("caption"),
                         last["page"].alias("page"), last["section"].alias("section"))
        kept = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(kept, F.array(grown))).otherwise(
            F.concat(done, F.array(t)))
    return F.aggregate(tables, F.array().cast(f"array<{TABLE}>"), step)


def rectangle(rows) -> list[list[str]] | None:
    """Trim cells, drop empty rows and columns, name header cells that only the body fills."""
    grid = [[" ".join(c.split()) if c else "" for c in row] for row in rows]
    grid = [row for row in grid if any(grid_cell for grid_cell in row)]
    if len(grid) < 2:
        return None
    ends = [max(i for i, c in enumerate(row) if c) + 1 for row in grid]
    width = max(ends)
    grid = [row[:width] + [""] * (width - len(row)) for row in grid]
    filled = [any(row[i] for row in grid[1:]) for i in range(width)]
    header = [f"column {i + 1}" if i >= ends[0] and filled[i] else grid[0][i] for i in range(width)]
    wanted = [i for i in range(width) if header[i] or filled[i]]
    return [[row[i] for i in wanted] for row in [header, *grid[1:]]]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def clean_rows(rows: pd.Series) -> pd.Series:
    return rows.map(lambda table: None if table is None else rectangle(table))


def is_numeric_heavy(body: Column) -> Column:
    """Most filled body cells are numbers or symbols."""
    cells = F.filter(F.flatten(body), lambda c: c != "")
    wordy = F.size(F.filter(cells, lambda c: ~c.rlike(_NUMERIC_CELL)))
    return (F.size(cells) > 0) & (wordy / F.size(cells) < config.MIN_ALPHA_CELL_RATIO)


def use_sentences(header: Column) -> Column:
    lowered = F.transform(header, F.lower)
    return ((F.size(header) <= config.MAX_SENTENCE_COLUMNS) & F.forall(header, lambda h: h != "")
            & (F.size(F.array_distinct(lowered)) == F.size(header)))


def row_sentence(header: Column, row: Column) -> Column:
    """"H v: h is v, h is v." ; empty text when the row says nothing."""
    first = F.get(row, F.lit(0))
    says = F.zip_with(header, row, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(" is "), v)))
    head = F.concat(F.get(header, F.lit(0)), F.lit(" "), first)
    return tx.bound(F.array_join(F.slice(says, F.lit(2), F.lit(1 << 30)), ", "), lambda listed: (
        F.when(~F.exists(row, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(""))
        .when((first != "") & (listed != ""), F.concat(head, F.lit(": "), listed, F.lit(".")))
        .when(first != "", F.concat(head, F.lit(".")))
        .otherwise(F.concat(listed, F.lit(".")))))


def markdown_row(cells: Column) -> Column:
    safe = F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("/")))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def group_lines(lines: Column) -> Column:
    """Consecutive lines in groups of at most ten rows or about four hundred words."""
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"),
                     F.array().cast("array<string>").alias("open"), F.lit(0).alias("words"))

    def step(acc, line):
        size = tx.word_count(line)
        full = (F.size(acc["open"]) > 0) & (
            (F.size(acc["open"]) >= config.TABLE_ROWS_PER_CHUNK)
            | (acc["words"] + size > config.TARGET_CHUNK_WORDS))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(acc["open"], F.array(line))).alias("open"),
            F.when(full, size).otherwise(acc["words"] + size).alias("words"))

    return F.aggregate(lines, empty, step, lambda acc: F.when(
        F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def table_pieces(tables: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row per text piece from rows carrying ``rows, caption, page, section``.

    Other columns pass through; ``part`` numbers the pieces of a table from 1.  With ``max_rows`` only that many body rows
    of a table are rendered, and ``rows_dropped`` says how many were not.
    """
    others = [c for c in tables.columns if c not in ("rows", "caption")]
    if max_rows:
        tables = tables.withColumn("rows_dropped", F.greatest(F.size("rows") - 1 - max_rows, F.lit(0)))
        others.append("rows_dropped")
    cleaned = (tables.withColumn("_clean", clean_rows("rows")).filter(F.col("_clean").isNotNull())
               .withColumn("_header", F.get("_clean", F.lit(0)))
               .withColumn("_body", F.slice("_clean", F.lit(2), F.lit(max_rows) if max_rows else F.size("_clean")))
               .withColumn("is_numeric", is_numeric_heavy(F.col("_body")))
               .withColumn("_talks", use_sentences(F.col("_header"))))
    spoken = F.filter(F.transform("_body", lambda r: row_sentence(F.col("_header"), r)), lambda s: s != "")
    drawn = F.transform("_body", markdown_row)
    prefix = F.when(F.col("_talks"), F.array(F.concat(
        F.lit("Columns: "), F.array_join("_header", ", "), F.lit(".")))).otherwise(F.array(
            markdown_row(F.col("_header")), markdown_row(F.transform("_header", lambda h: F.lit("---")))))
    grouped = (cleaned.withColumn("_lines", F.when(F.col("_talks"), spoken).otherwise(drawn))
               .filter(F.size("_lines") > 0)
               .withColumn("_prefix", prefix)
               .withColumn("_groups", group_lines(F.col("_lines"))))
    label = F.when(F.coalesce(F.col("caption"), F.lit("")) == "", "Table").when(
        tx.caption("caption").isNotNull(), F.col("caption")).otherwise(F.concat(F.lit("Table: "), F.col("caption")))
    flat = spread_array(grouped, [*others, "is_numeric", "_prefix", label.alias("_label"),
                                  F.size("_groups").alias("parts")], "_groups", "_lines", "_at")
    title = F.when(F.col("parts") > 1, F.concat(
        F.col("_label"), F.format_string(" (part %d of %d)", F.col("_at") + 1, F.col("parts")))).otherwise(
            F.col("_label"))
    body = F.array_join(F.concat(F.array(title), F.col("_prefix"), F.col("_lines")), "\n")
    return flat.select(*others, "is_numeric", (F.col("_at") + 1).alias("part"), "parts", body.alias("text"))
