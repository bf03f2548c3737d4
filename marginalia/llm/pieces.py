"""Vocabulary of a sentencepiece BPE model with byte fallback, and the parts of a text that merge independently."""

from __future__ import annotations

import functools
import re

import pyarrow as pa

SPACE = "▁"
CACHE_ENTRIES = 120_000
CACHED_LENGTH = 48


class Vocabulary:
    """Pieces, scores and byte ids.  Only what the two BPE operators rely on is accepted: BPE, byte fallback, identity
    normalisation with a dummy prefix, no piece with a space mark after another character."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        form = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix
                or form.precompiled_charsmap or form.remove_extra_whitespaces or not form.add_dummy_prefix or not form.escape_whitespaces):
            raise ValueError("unsupported model: a BPE model with byte fallback, identity normalisation and dummy prefix is needed")
        kinds = [p.type for p in model.pieces]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = {i: b for b, i in self.bytes.items()}
        self.controls = {i for i, k in enumerate(kinds) if k == 3}
        self.unknown = kinds.index(2)
        self.unknown_surface = model.trainer_spec.unk_surface
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces must not hold a space mark after another character")
        alone = "" if "\n" in "".join(self.ids) else "\\n"
        self.part = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))

    def parts(self, text: str) -> list[str]:
        """Parts that no piece crosses: a piece never has a space mark after another character, and a line feed outside the
        vocabulary never merges.  Their encodings, one after the other, are the text's."""
        return self.part.findall(SPACE + text.replace(" ", SPACE)) if text else []


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PartCache(dict):
    """Results by part, of short parts, in bounded number: the entries of a full cache are kept as an older generation,
    from which those still in use come back.  A worker that goes on to another operator drops what it kept for the last: a new
    cache empties the others, and ``release`` is for operators without one."""

    made: list = []

    def __init__(self, work):
        super().__init__()
        self.work = work
        self.older: dict = {}
        self.release()
        self.made.append(self)

    @classmethod
    def release(cls):
        """Empty all caches of this process, and give back what Arrow holds of earlier batches."""
        held = [x for x in cls.made if x or x.older]
        for other in held:
            other.clear()
            other.older = {}
        if held:
            pa.default_memory_pool().release_unused()

    def __missing__(self, part):
        made = self.older.pop(part, None)
        if made is None:
            made = self.work(part)
        if len(part) <= CACHED_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[part] = made
        return made
