"""Splitting texts into chunks that a byte-pair encoder may treat apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = "\x01"
GAP = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def chunk_lists(texts, cut: str):
    """(texts cut into chunks as a list array, mask of texts that have no safe cuts), computed by Arrow.

    ``byte_level``: under the usual byte-level pattern (an optional space, then
    letters, digits or other signs; else white space) every single space
    between two visible characters starts a piece and every such newline is a
    piece.  Texts with runs of white space, white space at the end or the mark
    itself are left to the pattern (masked).  ``words``: white space separates
    pieces and is dropped, so every space and newline is a cut.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.cast(pa.large_string())
    if cut == "words":
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(len(texts), bool)
    unsafe = pc.match_substring_regex(texts, f"{GAP}{{2}}|{GAP}\\z|{MARK}")
    marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
    return pc.split_pattern(marked, MARK), unsafe.to_numpy(zero_copy_only=False)


class Chunked:
    """The chunks of some texts: distinct ``words``, and per text the numbers of its chunks in order."""

    def __init__(self, texts, cut: str):
        lists, self.unsafe = chunk_lists(texts, cut)
        offsets = lists.offsets.to_numpy()
        encoded = lists.flatten().dictionary_encode()
        self.words: list[str] = encoded.dictionary.to_pylist()
        self.numbers = encoded.indices.to_numpy()
        self.offsets = offsets - offsets[0]


def by_chars(texts, limit: int) -> Iterator:
    """Slices of a string array of about ``limit`` bytes, one text at least."""
    if not len(texts):
        return
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    for a, b in in_slices(ends, limit):
        yield texts.slice(a, b - a)


class Splitter:
    """Texts -> numbers of their pieces under a pattern; pieces are numbered by first sight.

    The pattern runs once per distinct chunk.
    """

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.numbers: dict[str, int] = {}
        self.known: dict[str, bytes] = {"": b""}

    def _pack(self, pieces: list[str]) -> bytes:
        numbers = self.numbers
        return b"".join([numbers.setdefault(p, len(numbers)).to_bytes(4, "little") for p in pieces])

    def split(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces of all texts in order, pieces per text)."""
        chunked = Chunked(texts, "byte_level")
        known, packed = self.known, []
        for word in chunked.words:
            got = known.get(word)
            if got is None:
                got = known[word] = self._pack(self.find(word))
            packed.append(got)
        whole = {int(k): np.frombuffer(self._pack(self.find(texts[int(k)].as_py())), np.uint32) for k in np.flatnonzero(chunked.unsafe)}
        return put_together(chunked, packed, np.dtype(np.uint32), whole)


def put_together(chunked: Chunked, packed: list[bytes], dtype: np.dtype, whole: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all texts in order, values per text) from the packed values of each chunk.

    ``whole`` gives the values of texts that were not cut.
    """
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // dtype.itemsize
    values = np.frombuffer(b"".join(packed), dtype)
    starts = np.cumsum(lengths) - lengths
    running = np.concatenate([[0], np.cumsum(lengths[chunked.numbers])])
    if not whole:
        return gather(values, starts, lengths, chunked.numbers), np.diff(running[chunked.offsets])
    parts, per_text = [], np.zeros(len(chunked.offsets) - 1, np.int64)
    for k in range(len(per_text)):
        part = whole.get(k)
        if part is None:
            part = gather(values, starts, lengths, chunked.numbers[chunked.offsets[k]:chunked.offsets[k + 1]])
        parts.append(part)
        per_text[k] = len(part)
    return np.concatenate(parts) if parts else values[:0], per_text


def planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of unsigned integers, plane by plane (zstd packs that well)."""
    raw = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def from_planes(data: bytes, count: int, width: int) -> np.ndarray:
    raw = np.zeros((count, 4), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return raw.view(np.uint32).ravel()


DIRECT = 240


def split_ranks(ranks: np.ndarray) -> bytes:
    """Ranks below ``DIRECT`` as one byte, others as a class byte with 16 more bits apart (ranks below 2**20)."""
    large = ranks[ranks >= DIRECT]
    head = np.where(ranks < DIRECT, ranks, DIRECT + (ranks >> 16)).astype(np.uint8)
    return head.tobytes() + planes(large, 2)


RANK_LIMIT = (256 - DIRECT) << 16


def join_ranks(data: bytes, count: int) -> np.ndarray:
    head = np.frombuffer(data, np.uint8, count)
    out = head.astype(np.uint32)
    large = np.flatnonzero(head >= DIRECT)
    out[large] = (out[large] - DIRECT << 16) + from_planes(data[count:], len(large), 2)
    return out


def gather(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[offsets[p]:offsets[p] + lengths[p]]`` over ``picks``."""
    n = lengths[picks]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(offsets[picks] - (ends - n), n) + np.arange(ends[-1])]


def in_slices(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes (given by their running ends) sum to about ``limit``, one item at least."""
    at, base = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at, base = to, int(ends[to - 1])
