"""Operators 6, 9 and 10 against the library and plain counting."""

import collections
import math
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from marginalia.llm import fertility, piece_codec, token_count
from marginalia.llm.queries import QUERIES, piece_model
from tests.conftest import DATA

ALPHABET = ["a", "b", "▁", " ", "  ", "the", "in", "er", "\n", "é", "ß", "漢", "字", "🙂", "0", "<s>", "</s>", "<0x41>", "\t", "\r", "\0", "ing", "tion", " th", "un", "XX", "aaaa", "...", "   "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*(pq.read_table(f"{DATA}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))


def test_random_texts(library):
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text)
        assert piece_codec.encode_text(text, piece_model()).tolist() == ids
        assert token_count.count_text(text, piece_model()) == len(ids)
        assert piece_codec.decode_ids(pa.array([ids], pa.list_(pa.int32())), piece_model())[0].as_py() == library.decode(ids)


def test_random_ids_decode_as_the_library_does(library):
    rng = random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 29871]) for _ in range(rng.randint(0, 8))]
        assert piece_codec.decode_ids(pa.array([ids], pa.list_(pa.int32())), piece_model())[0].as_py() == library.decode(ids)


def test_failed_positions_are_left_again(library):
    vocab = piece_codec.vocabulary(piece_model())
    encoder = piece_codec.Encoder(vocab)
    for word in ("thththth", "ndndndaaaa", "erererstst", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁the", "ationation", "hththhtheher"):
        assert [vocab.ids[p] for p in encoder.merged(word)] == encoder.encode(word)


def test_queries(spark, library, texts):
    import hashlib
    coded = {r.doc_id: r for r in QUERIES["op6_piece_codec"][0](spark, DATA).collect()}
    counted = {r.doc_id: r for r in QUERIES["op9_token_count"][0](spark, DATA).collect()}
    assert set(coded) == set(counted) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "")
        r = coded[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                                               hashlib.sha256(library.decode(ids).encode()).hexdigest())
        c = counted[doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len((text or "").encode()), len(ids), len(ids) > 4096)


def test_fertility_by_plain_counting(spark, library, texts):
    rows = {r.doc_id: r for r in QUERIES["op10_fertility"][0](spark, DATA).collect()}
    lang = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang"))))
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        times = collections.Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
        seen, duplicates = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                duplicates += line in seen
                seen.add(line)
        tokens = collections.Counter(t for w in words for t in library.encode(w))
        n = sum(tokens.values())
        bits = -sum(c / n * math.log2(c / n) for c in tokens.values()) if n else 0.0
        r = rows[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(inside), n)
        assert math.isclose(r.token_entropy, bits, abs_tol=1e-9)
        assert math.isclose(r.byte_share, sum(c for t, c in tokens.items() if library.is_byte(t)) / n if n else 0.0, abs_tol=1e-12)
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        low, high, most_bytes, least_bits = fertility.BANDS.get(lang[doc_id]) or fertility.BANDS[r.script]
        wide = 1 / math.sqrt(max(n, 1))
        chars = sum(map(len, words)) / n if n else 0.0
        fluent = (low - 4 * wide <= chars <= high + 4 * wide and r.byte_share <= most_bytes + 1.6 * wide
                  and bits >= least_bits * math.log2(max(n, 1)) - 4 * wide)
        assert r.kept == (fluent and not r.base_failed)


def test_bands_reject_what_the_vocabulary_does_not_know():
    vocab = fertility._tokens(piece_model())
    foreign = " ".join("ཀཁགངཅཆཇཉཏཐ" for _ in range(30)).replace("ཀ", "ꦲ")
    assert not fertility.measure(foreign.encode(), "en", vocab, fertility.BANDS)[-1]
    assert fertility.script_of("Это русский текст".encode()) == "cyrillic" and fertility.script_of("漢字かな".encode()) == "cjk"


def test_bands_hold_for_short_texts():
    """Junk is rejected at every length, short clean texts with long numbers or a sign without a piece stay."""
    vocab = fertility._tokens(piece_model())
    kept = lambda text: fertility.measure(text.encode(), "en", vocab, fertility.BANDS)[-1]
    foreign = [chr(0x1200 + 7 * i) + chr(0x1300 + 5 * i) for i in range(11)]
    assert not kept(" ".join(foreign)) and not kept(" ".join([*foreign, "word"]))
    assert not kept(" ".join(f"{chr(97 + i % 26)}{chr(98 + i % 24)}{chr(99 + i % 22)}" for i in range(7, 26)) + " x q z j k v w y p q" * 3)
    assert kept("Call the office on +1 (372) 555-7739 before noon and ask for Anna \U0001F600 please.")
    assert kept("The card number is 9597024294303453 and it ends in the month of May.")


def test_token_caches_are_small_and_given_back():
    from marginalia.llm import fertility, pieces
    vocab = fertility.Tokens(piece_model())
    words = [b"word%d" % i for i in range(300)]
    made = vocab.of(words)
    assert [np.frombuffer(x, np.int32).tolist() for x in made] == [vocab.model.encode(w.decode()) for w in words]
    assert max(map(sys.getsizeof, made)) <= 80 and len(vocab.cache) == 300
    pieces.PartCache.release()
    assert not vocab.cache and not vocab.cache.older and vocab.of(words) == made
