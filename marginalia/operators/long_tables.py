"""Tables of any length to text, one input row per table row.

``tables.table_pieces`` takes a table as one value, which has to fit in a row.  Here no table is gathered: rows are
numbered by a range partitioning, cut into segments, and every segment is packed on its own.  Where a piece begins depends
on all rows before it, but only through the number of leading rows of a segment that still belong to a piece of the segment
before, at most nine.  So a segment is a small map from that number to the one it hands on, and maps are composed by
doubling, in log2(segments of the longest table) joins of one row per segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config
from ..functions import text as tx
from ..functions.rows import spread_array
from ..session import broadcast_if_small, cut_lineage, ship_package
from . import tables

SEGMENT_ROWS = 1000
_INTS = T.ArrayType(T.IntegerType())
_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
#: Leading rows of a segment that can belong to an earlier piece, and rows behind a segment that its last piece can reach.
_REACH = config.TABLE_ROWS_PER_CHUNK - 1


def piece_ends(words: np.ndarray) -> list[int]:
    """For every row, where a piece that begins there ends: ten rows or about four hundred words, one row at least."""
    before = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    by_words = np.searchsorted(before, before[:-1] + config.TARGET_CHUNK_WORDS, "right") - 1
    return np.clip(by_words, at + 1, np.minimum(at + config.TABLE_ROWS_PER_CHUNK, len(words))).tolist()


@F.pandas_udf(_SPANS)
def _map_of(words: pd.Series, own: pd.Series) -> pd.Series:
    """For every number of rows taken by an earlier piece: [rows taken from the next segment, pieces begun]."""
    def one(sizes, n):
        ends, out = piece_ends(np.asarray(sizes)), []
        for at in range(_REACH + 1):
            begun = 0
            while at < n:
                at, begun = ends[at], begun + 1
            out.append([at - n, begun])
        return out
    return pd.Series(map(one, words, own))


@F.pandas_udf(_SPANS)
def _pieces_of(words: pd.Series, own: pd.Series, taken: pd.Series) -> pd.Series:
    """[first row, rows] of every piece that begins in a segment, when ``taken`` rows belong to an earlier one."""
    def one(sizes, n, at):
        ends, out = piece_ends(np.asarray(sizes)), []
        while at < n:
            out.append([at, ends[at] - at])
            at = ends[at]
        return out
    return pd.Series(map(one, words, own, taken))


def _trimmed(cells: Column) -> Column:
    # A single blank is what it is replaced by.
    return F.transform(cells, lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " ")), F.lit("")))


def _words(line: Column) -> Column:
    """Words of a line made of trimmed cells: blanks are its only white space."""
    return F.size(F.array_remove(F.split(line, " "), ""))


def described(body: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table with body rows: header and places of the columns kept, ``is_numeric``, how rows are written.

    A column stays if its header or any body cell is filled; one that only the body fills beyond the header is named by its
    number.  Rows are counted per table and pattern of their cells by a combining aggregate; only patterns are spread to cells.
    """
    pattern = F.array_join(F.transform("cells", lambda c: F.when(c == "", "0").when(c.rlike(tables._NUMERIC_CELL), "1").otherwise("2")), "")
    counted = body.groupBy(*keys, pattern.alias("pattern")).agg(F.count("*").alias("times"))
    filled = F.filter(F.transform(F.split("pattern", "(?!\\z)"), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] != "0")
    columns = (spread_array(counted, [*keys, "times"], filled, "x").groupBy(*keys, F.col("x.i").alias("i"))
               .agg(F.sum("times").alias("n"), F.sum(F.when(F.col("x.c") == "2", F.col("times")).otherwise(0)).alias("wordy"))
               .groupBy(*keys).agg(F.collect_set("i").alias("_filled"), F.sum("n").alias("n"), F.sum("wordy").alias("wordy")))
    last = F.coalesce(F.array_max(F.transform("header", lambda h, i: F.when(h != "", i + 1))), F.lit(0))
    both = (headers.withColumn("header", _trimmed(F.coalesce("header", F.array().cast("array<string>")))).join(columns, keys)
            .withColumn("_last", last).withColumn("_width", F.greatest("_last", F.array_max("_filled") + 1)))
    names = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda i: F.struct(i.alias("i"), F.when(
        (i >= F.col("_last")) & F.array_contains("_filled", i), F.concat(F.lit("column "), (i + 1).cast("string")))
        .otherwise(F.coalesce(F.get("header", i), F.lit(""))).alias("name")))
    kept = both.withColumn("_kept", F.filter(names, lambda c: (c["name"] != "") | F.array_contains("_filled", c["i"])))
    label = F.when(F.coalesce(F.col("caption"), F.lit("")) == "", "Table").when(
        tx.caption("caption").isNotNull(), F.col("caption")).otherwise(F.concat(F.lit("Table: "), F.col("caption")))
    return (kept.withColumn("_header", F.transform("_kept", lambda c: c["name"])).withColumn("_places", F.transform("_kept", lambda c: c["i"]))
            .withColumn("_talks", tables.use_sentences(F.col("_header")))
            .select(*keys, "_header", "_places", "_talks", label.alias("_label"), (F.col("wordy") / F.col("n") < config.MIN_ALPHA_CELL_RATIO).alias("is_numeric")))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_rn``, the number of a row within its key from 0, in the order of ``order`` (which should be total).

    Rows are dealt by ranges of key and order, so a key with a third of them is spread over a third of the tasks; what is
    gathered is one count per task.
    """
    placed = cut_lineage(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)).withColumn("_id", F.monotonically_increasing_id())
    task, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    heads = cut_lineage(placed.groupBy(task.alias("_task"), *keys).agg(F.count("*").alias("_n"), F.min(within).alias("_least")))
    counts = dict(heads.groupBy("_task").agg(F.sum("_n")).collect())
    starts, total = [], 0
    for t in sorted(counts):
        starts.append((t, total))
        total += counts[t]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_task long, _start long"))
    first = heads.join(offsets, "_task").groupBy(*keys).agg(F.min(F.col("_start") + F.col("_least")).alias("_first"))
    return (placed.withColumn("_task", task).join(offsets, "_task").join(broadcast_if_small(first, 64), keys)
            .withColumn("_rn", F.col("_start") + within - F.col("_first")).drop("_task", "_start", "_id", "_first"))


def composed(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``map`` of every segment replaced by that of the table's beginning up to the segment's end."""
    reach = maps.agg(F.max("seg")).first()[0] or 0
    step = 1
    while step <= reach:
        before = maps.select(*keys, (F.col("seg") + step).alias("seg"), F.col("map").alias("_before"))
        here = lambda b: F.get("map", b[0].cast("int"))
        both = F.transform("_before", lambda b: F.array(here(b)[0], b[1] + here(b)[1]))
        maps = cut_lineage(maps.join(before, [*keys, "seg"], "left").withColumn("map", F.coalesce(both, "map")).drop("_before"))
        step *= 2
    return maps


def long_table_pieces(body: DataFrame, headers: DataFrame, keys, order, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The pieces that ``tables.table_pieces`` gives, for tables of any length: keys, is_numeric, part, parts, text.

    ``body`` has keys, order columns and ``cells`` (array of strings), ``headers`` one row per key with ``header`` and
    ``caption``.  Cells are trimmed; rows without a filled cell, tables without body rows and rows without a header row are
    left out; null cells are empty.  Rows equal in ``order`` go by their cells.  Keys must not be null.  Other columns are
    not read.  No group is larger than a segment and the rows its last piece reaches.
    """
    ship_package(body.sparkSession)
    if segment_rows <= _REACH:
        raise ValueError(f"a segment has more than {_REACH} rows")
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    filled = F.coalesce(F.exists("cells", lambda c: c.rlike(r"(?U)[^\s\x1c-\x1f]")), F.lit(False))
    # Numbered before anything is rendered: dealing by ranges reads its input twice, once to sample it.
    rows = numbered(body.select(*keys, *order, "cells").filter(filled), keys, [*order, "cells"])
    clean = rows.select(*keys, "_rn", _trimmed(F.col("cells")).alias("cells"))
    about = cut_lineage(described(clean, headers.select(*keys, "header", "caption"), keys))
    known = broadcast_if_small(about.select(*keys, "_header", "_places", "_talks"), 1024)
    def written(cells):
        row = F.transform("_places", lambda i: F.coalesce(F.get(cells, i), F.lit("")))
        return tx.bound(row, lambda r: F.when(F.col("_talks"), tables.row_sentence(F.col("_header"), r)).otherwise(tables.markdown_row(r)))

    # A row with a filled cell has one in a column that stays, so no line is empty and the numbers have no gaps.
    # What a lambda mentions is evaluated for each element, so cells, row and line are bound before.
    lines = rows.join(known, keys).select(*keys, "_rn", tx.bound(_trimmed(F.col("cells")), lambda cells: tx.bound(
        written(cells), lambda line: F.struct("_rn", _words(line).alias("words"), line.alias("line")))).alias("r"))
    seg, at = F.expr(f"_rn div {segment_rows}"), F.col("_rn") % segment_rows
    seen_by = F.when((at < _REACH) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    dealt = spread_array(lines, [*keys, "r", seg.alias("_of")], seen_by, "seg")
    segments = (dealt.groupBy(*keys, "seg").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.sum((F.col("_of") == F.col("seg")).cast("int")).cast("int").alias("own"))
                .withColumn("words", F.transform("rows", lambda r: r["words"])))
    segments = cut_lineage(segments.withColumn("map", _map_of("words", "own")))
    upto = composed(segments.select(*keys, "seg", "map"), keys).select(*keys, "seg", F.get("map", F.lit(0)).alias("_end"))
    entered = upto.select(*keys, (F.col("seg") + 1).alias("seg"), F.col("_end")[0].alias("_taken"), F.col("_end")[1].alias("_begun"))
    parts = upto.groupBy(*keys).agg(F.max(F.col("_end")[1]).alias("parts"))
    placed = (segments.join(entered, [*keys, "seg"], "left").join(parts, keys)
              .withColumn("spans", _pieces_of("words", "own", F.coalesce("_taken", F.lit(0)))))
    flat = spread_array(placed, [*keys, "rows", "parts", F.coalesce("_begun", F.lit(0)).alias("_begun")], "spans", "span", "_at")
    flat = flat.select(*keys, "parts", (F.col("_begun") + F.col("_at") + 1).alias("part"), F.transform(
        F.slice("rows", F.col("span")[0] + 1, F.col("span")[1]), lambda r: r["line"]).alias("_lines"))
    full = flat.join(broadcast_if_small(about.drop("_places"), 1024), keys)
    title = F.when(F.col("parts") > 1, F.concat("_label", F.format_string(" (part %d of %d)", "part", "parts"))).otherwise(F.col("_label"))
    prefix = F.when(F.col("_talks"), F.array(F.concat(F.lit("Columns: "), F.array_join("_header", ", "), F.lit(".")))).otherwise(
        F.array(tables.markdown_row(F.col("_header")), tables.markdown_row(F.transform("_header", lambda h: F.lit("---")))))
    return full.select(*keys, "is_numeric", "part", "parts", F.array_join(F.concat(F.array(title), prefix, "_lines"), "\n").alias("text"))
