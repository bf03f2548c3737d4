"""Operator 2, chat formatting: conversations rendered by a compiled template, with the loss mask of generated text."""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .templates import compile_template

#: Turns begin with a heading and end with a mark.  Inside texts both, and the escape sign, get an escape sign in front.
TURN_TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape(':') }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}")
CONTROL = ("\\", "###", "</turn>")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S)

FORMATTED = "conv_id long, n_turns long, text string, spans array<struct<start:int,stop:int>>"


@functools.lru_cache(maxsize=8)
def _control(more: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, (*CONTROL, *more))))


def escape(text, *more: str) -> str:
    """Every control string, and the escape sign itself, after an escape sign."""
    return _control(more).sub(lambda m: "\\" + m[0], "" if text is None else str(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text that ``TURN_TEMPLATE`` made."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@functools.lru_cache(maxsize=8)
def _renderer(template: str):
    return compile_template(template, {"escape": escape})


def format_conversations(turns: DataFrame, template: str = TURN_TEMPLATE, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, text, spans: each conversation rendered whole; spans are the code point ranges under generation markers.

    Turns are ordered by turn, ties by role and text, so equal rows keep their number and give one result whatever the
    partitioning.  Null texts and roles are empty.  Rows with a null conv_id are one conversation of their own.  An empty
    table gives no rows; other columns are not read.  A conversation is one row of the result, so it must fit in a row;
    one hash shuffle on conv_id gathers the turns.
    """
    ship_package(turns.sparkSession)
    _renderer(template)  # a template that cannot be compiled fails here
    rows = (turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("messages")))

    def run(batches):
        render = _renderer(template)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                messages = part.column("messages").to_pylist()
                made = [render({"messages": m}) for m in messages]
                spans = [[{"start": a, "stop": b} for a, b in s] for _, s in made]
                yield pa.record_batch([part.column("conv_id"), pa.array(map(len, messages), pa.int64()), pa.array([t for t, _ in made], pa.string()),
                                       pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                                      names=["conv_id", "n_turns", "text", "spans"])

    return rows.mapInArrow(run, FORMATTED)


ROWS = 200
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations: digests of their turns and of the text under the loss mask."""
    ship_package(formatted.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, whole, chars, digest, length = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(chars, pa.int64()),
                                   pa.array(digest, pa.string()), pa.array(length, pa.int64())], names=[x.split(" ")[0] for x in DIGESTS.split(", ")])

    return formatted.select("conv_id", "text", "spans").mapInArrow(run, DIGESTS)
