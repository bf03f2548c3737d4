"""Operator 10, quality rules: tokeniser fertility with rejection bands per language or script."""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Numbering, columns_of, map_texts, slices, text_bytes
from .pieces import PartCache

#: Bands of characters per token, of the share of byte-fallback tokens and of token entropy in bits.  Entropy grows with
#: the number of tokens, so its lower edge is a share of the most that a text of that length can have.
#: By language, else by the script of most letters; wide enough that only texts foreign to the vocabulary leave them.
BANDS = {
    "en": (1.75, 8.0, 0.20, 0.30),
    "de": (1.75, 8.0, 0.20, 0.30),
    "fr": (1.50, 8.0, 0.20, 0.30),
    "es": (1.60, 8.0, 0.20, 0.30),
    "latin": (1.0, 9.0, 0.35, 0.25),
    "cyrillic": (0.9, 7.0, 0.45, 0.25),
    "cjk": (0.35, 3.0, 0.80, 0.25),
    "other": (0.30, 9.0, 0.95, 0.20),
}
#: What a measure of n tokens may lie outside its band, times sqrt(n): two standard deviations, where a token's characters
#: vary by about two, byte tokens come in bunches of about four, and entropy is in bits.
CHARS_MARGIN = 4.0
BYTES_MARGIN = 1.6
ENTROPY_MARGIN = 4.0
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "chars_per_token double, byte_share double, token_entropy double, script string, base_failed boolean, kept boolean")


class Tokens:
    """Token ids of single words as packed 32-bit numbers, each distinct word encoded once while it is in the cache.

    Short byte strings lie in Python's own small blocks; an array for each word would pin the heap in which texts come and go.
    """

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.cache = PartCache(lambda word: array("i", self.model.encode(word.decode())).tobytes())

    def of(self, words: list[bytes]) -> list[bytes]:
        return list(map(self.cache.__getitem__, words))


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows of five that occur at least twice, the first occurrence included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    # Exact numbers of windows: words packed into one integer, numbered again where a further word would not fit.
    base = int(ids.max()) + 1
    window, held = ids[:n], base
    for k in range(1, WINDOW):
        if held * base >= 1 << 62:
            _, window = np.unique(window, return_inverse=True)
            held = n
        window = window * base + ids[k:k + n]
        held *= base
    _, window = np.unique(window, return_inverse=True)
    repeated = np.bincount(window)[window] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        inside[k:k + n] |= repeated
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def script_of(text: bytes) -> str:
    """Script of most letters, by the lead bytes of their UTF-8 form."""
    lead = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counts = {"latin": int(lead[65:91].sum() + lead[97:123].sum() + lead[0xC3:0xCA].sum()), "cyrillic": int(lead[0xD0:0xD4].sum()),
              "cjk": int(lead[0xE3:0xEE].sum()), "other": int(lead[0xCA:0xD0].sum() + lead[0xD4:0xE3].sum() + lead[0xEE:].sum())}
    return max(counts, key=counts.get)


def in_band(band: tuple, n_tokens: int, chars_per_token: float, byte_share: float, bits: float) -> bool:
    """Whether the measures of a text of ``n_tokens`` lie in a band, which is wider for short texts."""
    least, most, most_bytes, least_entropy = band
    n = max(n_tokens, 1)
    unit = n ** -0.5
    return (least - CHARS_MARGIN * unit <= chars_per_token <= most + CHARS_MARGIN * unit and byte_share <= most_bytes + BYTES_MARGIN * unit
            and bits >= least_entropy * np.log2(n) - ENTROPY_MARGIN * unit)


def measure(text: bytes, lang: str | None, vocab: Tokens, bands: dict) -> tuple:
    words = text.split()  # ASCII white space, as for bytes
    n_words = len(words)
    word_bytes = b"".join(words)
    word_chars = len(word_bytes.decode())
    numbers = Numbering()
    ids = numbers.of(words)
    of_word = vocab.of(list(numbers))
    sizes = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
    times = np.bincount(ids, minlength=len(of_word))
    flat = np.frombuffer(b"".join(of_word), np.int32)
    weights = np.repeat(times, sizes)
    per_token = np.bincount(flat, weights=weights) if len(flat) else np.zeros(0)
    n_tokens = int(weights.sum())
    seen = per_token[per_token > 0]
    bits = float(np.log2(n_tokens) - (seen * np.log2(seen)).sum() / n_tokens) if n_tokens else 0.0
    byte_share = float(weights[vocab.is_byte[flat]].sum() / n_tokens) if n_tokens else 0.0
    chars_per_token = word_chars / n_tokens if n_tokens else 0.0
    script = script_of(word_bytes)
    n_repeat = repeated_words(ids)
    base_failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED_PERCENT * n_words
    inside = in_band(bands.get(lang) or bands[script], n_tokens, chars_per_token, byte_share, bits)
    return (n_words, word_chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), n_repeat, n_tokens,
            chars_per_token, byte_share, bits, script, base_failed, bool(inside and not base_failed))


def fertility(docs: DataFrame, path: str, bands: dict | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Word, symbol and repetition counts, characters per token, byte-fallback share and token entropy of every whole
    text under the public sentencepiece vocabulary at ``path``, and a verdict.

    ``base_failed``: under ten words, or more than a fifth of the words in repeated five-word windows.  ``kept``: the base
    holds and the three measures lie in the band of the language, or of the script when ``lang`` is null or has no band;
    bands hold
    at every length and widen as 1/sqrt(tokens).  A null or empty text has no words and fails the
    base.  A row for each input row, repeated ones too; a null id stays null; other columns are not read.  Nothing is
    shuffled; a task holds one slice of texts and a bounded cache of words.
    """
    bands = {**BANDS, **(bands or {})}
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = _tokens(path)
        rows = [measure(t, k, vocab, bands) for t, k in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist())]
        return columns_of(SCHEMA, doc_id=batch.column("doc_id"), **{name: [r[i] for r in rows] for i, name in enumerate(names[1:])})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return map_texts(rows, work, SCHEMA)


def keep_fluent(docs: DataFrame, path: str, bands: dict | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The input rows that the rules keep, all columns as they are, repeated rows and clashing names too.  Rows without a text or
    with an empty one fail the base and go."""
    from ..session import ship_package
    ship_package(docs.sparkSession)
    bands = {**BANDS, **(bands or {})}

    def run(batches):
        vocab = _tokens(path)
        for batch in (part for whole in batches for part in slices(whole, text)):
            kept = [measure(t, k, vocab, bands)[-1] for t, k in zip(text_bytes(batch.column(text)), batch.column(lang).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
