"""Encoding whole texts with the tokenizers library, each distinct chunk once per worker."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from corpusloom.llm.common import file_bytes, release_memory, worker_cache
from corpusloom.llm.pretoken import Chunked, by_chars, put_together


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizers file (size checked, so it may be broadcast) and the cuts that its pre-tokenizer allows.

    ``byte_level``: single spaces before a word and single newlines start a
    piece.  ``words``: white space separates pieces and is dropped.
    """

    data: bytes
    cut: str

    @classmethod
    def load(cls, path: str, cut: str) -> Vocabulary:
        return cls(file_bytes(path), cut)

    def tokenizer(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(self.data)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return tokenizer

    def id_width(self) -> int:
        return 2 if self.tokenizer().get_vocab_size() <= 1 << 16 else 4


def plain_lower(word: str) -> str:
    """Lower case where that is one letter for one, as the vocabulary's own normalizer does it; else the word itself."""
    return word.lower() if word.isascii() or (max(word) < "\u0250" and "\u0130" not in word) else word


class Encoder:
    """texts -> ids (unsigned integers of ``width`` bytes); a chunk that the worker knows already is not encoded again.

    A full stop or comma after a letter is a piece of its own in both kinds of
    vocabulary, so it is taken off a chunk before its stem is looked up.
    """

    def __init__(self, vocabulary: Vocabulary, width: int, cache_chunks: int = 1_000_000, slice_bytes: int = 8_000_000):
        self.tokenizer, self.cut = vocabulary.tokenizer(), vocabulary.cut
        self.dtype = np.dtype(f"<u{width}")
        self.code = {2: "H", 4: "I"}[width]
        self.known: dict[str, bytes] = worker_cache(f"{vocabulary.cut}-{width}-{hash(vocabulary.data)}")
        self.known[""] = b""
        self.tails = dict(zip(".,", self._encode([".", ","]), strict=True))
        self.cache_chunks, self.slice_bytes = cache_chunks, slice_bytes

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, words: list[str]) -> list[bytes]:
        known, tails = self.known, self.tails
        # U+0130 in lower case ends with a combining mark, which forms a piece with what follows.
        ends = [tails[w[-1]] if w[-1:] in tails and w[-2:-1].isalpha() and w[-2] != "\u0130" else b"" for w in words]
        stems = [w[:-1] if e else w for w, e in zip(words, ends, strict=True)]
        if self.cut == "words":
            stems = [plain_lower(s) if s else s for s in stems]
        found = [known.get(s) for s in stems]
        fresh = list({s for s, f in zip(stems, found, strict=True) if f is None})
        new: dict[str, bytes] = {}
        for at in range(0, len(fresh), 50_000):
            part = fresh[at:at + 50_000]
            new.update(zip(part, self._encode(part), strict=True))
        if len(known) < self.cache_chunks:  # memory bound: what comes first stays, frequent chunks among it
            known.update(new)
        return [(new[s] if f is None else f) + e for s, f, e in zip(stems, found, ends, strict=True)]

    def encode(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts of a slice in order, ids per text) for slices of a string array."""
        for part in by_chars(texts, self.slice_bytes):
            chunked = Chunked(part, self.cut)
            whole = {int(k): np.frombuffer(self._encode([part[int(k)].as_py()])[0], self.dtype) for k in np.flatnonzero(chunked.unsafe)}
            ids, per_text = put_together(chunked, self._chunks(chunked.words), self.dtype, whole)
            del chunked
            release_memory()
            yield ids, per_text
