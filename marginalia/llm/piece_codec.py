"""Operator 6, SentencePiece encoding and decoding: exact merge-type encoding by backtracking."""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, map_texts, text_bytes
from .pieces import PartCache, SPACE, Vocabulary, vocabulary


NONE = float("-inf")


class Encoder:
    """Aho-Corasick longest matches, compatibility of neighbours by merging them again, a bitfield of failed positions.

    A sequence of pieces is what byte-pair merging makes of a text exactly if every two neighbours are what it makes of
    their joined text.  So the encoder walks over the text with the longest piece that starts at each position, takes
    shorter ones where neighbours disagree, and steps back where none is left; a position from which no sequence can
    follow is marked and never entered again, so each is entered a bounded number of times.
    """

    def __init__(self, vocab: Vocabulary):
        import ahocorasick
        self.vocab = vocab
        self.fits = functools.lru_cache(maxsize=CACHE_PAIRS)(self._fits)
        # A piece that merging its own characters does not give can stand in no encoding.
        self.usable = {p for p in vocab.ids if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.usable:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in vocab.ids if len(p) == 1)
        self.shorter = functools.lru_cache(maxsize=CACHE_PAIRS)(self._shorter)

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored adjacent pair, leftmost first, until none is left.  A merge
        changes only the scores of the two pairs beside it."""
        score, symbols = self.vocab.scores.get, list(text)
        pairs = [score(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != NONE:
            at = pairs.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + symbols[at], NONE)
            if at < len(pairs):
                pairs[at] = score(symbols[at] + symbols[at + 1], NONE)
        return symbols

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def _shorter(self, piece: str) -> str:
        """The longest usable piece that is a proper prefix, or nothing."""
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.usable), "")

    def encode(self, part: str) -> list[int]:
        """Ids of a part; a character outside the vocabulary becomes its UTF-8 bytes."""
        if self.characters.issuperset(part):
            return self._known(part)
        ids, run = [], 0
        for at, c in enumerate(part):
            if c not in self.vocab.ids:
                ids += self._known(part[run:at]) + [self.vocab.bytes[b] for b in c.encode()]
                run = at + 1
        return ids + self._known(part[run:])

    def _known(self, text: str) -> list[int]:
        n = len(text)
        if not n:
            return []
        if text in self.usable:
            return [self.vocab.ids[text]]
        longest = [1] * n
        for stop, size in self.automaton.iter(text):    # ends ascend, so a start's last match is its longest
            longest[stop - size + 1] = size
        fits, shorter = self.fits, self.shorter
        failed, any_failed = bytearray((n >> 3) + 1), False
        taken: list[str] = []
        before, at, piece = "", 0, text[:longest[0]]
        while at < n:
            while piece:
                stop = at + len(piece)
                if not (any_failed and failed[stop >> 3] >> (stop & 7) & 1) and (not before or fits(before, piece)):
                    break
                piece = shorter(piece)
            if piece:
                taken.append(piece)
                before, at = piece, stop
                if at < n:
                    piece = text[at:at + longest[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = taken.pop()
                before = taken[-1] if taken else ""
                at -= len(piece)
                piece = shorter(piece)
        return [self.vocab.ids[p] for p in taken]


CACHE_PAIRS = 120_000


@functools.lru_cache(maxsize=2)
def _parts_to_ids(path: str) -> PartCache:
    encoder = Encoder(vocabulary(path))
    return PartCache(lambda part: np.array(encoder.encode(part), np.int32).tobytes())


@functools.lru_cache(maxsize=2)
def _finer(path: str):
    """Parts of a text like those of the vocabulary, but a word ends before a mark that follows a letter in no piece: two
    characters that stand side by side in no piece are never merged across, and words recur more often without the comma."""
    vocab = vocabulary(path)
    after_letters = {p[i + 1] for p in vocab.ids for i in range(len(p) - 1) if p[i].isalpha()}
    marks = "".join(re.escape(c) for c in string.punctuation if c not in after_letters)
    return re.compile(f"{SPACE}*+[^\\W\\d_]++(?=[{marks}])|" + vocab.part.pattern) if marks else vocab.part


def parts_of(text: str, path: str) -> list[str]:
    return _finer(path).findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode_text(text: str, path: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(_parts_to_ids(path).__getitem__, parts_of(text, path))), np.int32)


@functools.lru_cache(maxsize=2)
def _surfaces(path: str) -> tuple[pa.Array, np.ndarray]:
    """UTF-8 of every id, and which ids are bytes."""
    vocab = vocabulary(path)
    made = [bytes([vocab.byte_ids[i]]) if i in vocab.byte_ids else b"" if i in vocab.controls
            else vocab.unknown_surface.encode() if i == vocab.unknown else p.replace(SPACE, " ").encode()
            for i, p in enumerate(vocab.pieces)]
    is_byte = np.zeros(len(made), bool)
    is_byte[list(vocab.byte_ids)] = True
    return pa.array(made, pa.binary()), is_byte


def _replaced(raw: bytes) -> str:
    """Undecodable bytes become one replacement mark each."""
    text = []
    while raw:
        try:
            text.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            text.append(raw[:e.start].decode() + "�")
            raw = raw[e.start + 1:]
    return "".join(text)


def decode_ids(ids: pa.ListArray, path: str) -> pa.Array:
    """Texts of lists of ids: surfaces joined, the dummy space in front removed, bytes assembled."""
    pieces, is_byte = _surfaces(path)
    values = ids.values.slice(ids.offsets[0].as_py(), ids.offsets[-1].as_py() - ids.offsets[0].as_py())
    offsets = pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(values)), b"")
    raw = joined.to_pylist()
    begins = offsets.to_numpy()
    numbers = values.to_numpy()
    out = []
    for k, x in enumerate(raw):
        # The dummy prefix is a piece's own leading mark, never a byte.
        if x.startswith(b" ") and not is_byte[numbers[begins[k]]]:
            x = x[1:]
        try:
            out.append(x.decode())
        except UnicodeDecodeError:
            out.append(_replaced(x))
    return pa.array(out, pa.string())


def encode_texts(texts: pa.Array, path: str) -> pa.ListArray:
    known = _parts_to_ids(path)
    raw = [b"".join(map(known.__getitem__, parts_of(t.decode(), path))) for t in text_bytes(texts)]
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([len(x) >> 2 for x in raw], out=offsets[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and the text that the ids decode to, in one pass: what ``decode(encode(...))`` gives, with one worker for each
    task instead of two.  A null or empty text has no ids and an empty text."""
    schema = "doc_id long, ids array<int>, text string"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_texts(batch.column("text"), path)
        return columns_of(schema, doc_id=batch.column("doc_id"), ids=ids, text=decode_ids(ids, path))

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, schema)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the sentencepiece model at ``path`` merges it.

    A null or empty text has no ids.  Each input row gives a row; other columns are not read; a null id stays null.
    Nothing is shuffled.  ``path`` must name the same file on every executor.
    """
    schema = "doc_id long, ids array<int>"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return columns_of(schema, doc_id=batch.column("doc_id"), ids=encode_texts(batch.column("text"), path))

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded text.  A null list gives a null text, an empty one an empty text."""
    from ..session import ship_package
    ship_package(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                ids = part.column("ids")
                texts = decode_ids(pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids, path)
                if ids.null_count:
                    texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.record_batch([part.column("doc_id"), ids, texts], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


DECODE_ROWS = 1000
