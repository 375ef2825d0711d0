"""Encoding, token files and packing against the tokenizer libraries."""

import base64
import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing, tokenfile
from corpusloom.llm.common import shared_folder
from corpusloom.llm.hf import Encoder, Vocabulary

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.Ranks.load(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def hf(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def key(value):
    return (value is not None, value or 0)


def test_bpe_equals_the_library_and_decodes_back(edge_docs, edge_rows, ranks, reference):
    out = bpe.decode(bpe.encode(edge_docs, ranks, parts=7, block_chars=50_000), ranks).collect()
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["bytes"])) for r in out), key=lambda r: (key(r[0]), r[1]))
    want = sorted(((i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in edge_rows), key=lambda r: (key(r[0]), r[1]))
    assert got == want


def test_bpe_on_documents(spark, sf, ranks, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs, ranks, parts=16, block_chars=40_000).collect()}
    assert got == {r["doc_id"]: reference.encode_ordinary(r["text"]) for r in docs.collect()}


def test_bpe_of_an_empty_table(no_docs, ranks):
    assert bpe.decode(bpe.encode(no_docs, ranks), ranks).collect() == []


def test_bpe_splits_every_code_point_like_the_library(ranks, reference):
    import pyarrow as pa

    from corpusloom.llm.pretoken import Splitter

    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}b1{c}{c} " for c in chars[k:k + 64]) for k in range(0, len(chars), 64)]
    splitter = Splitter(public_tokenizers.PATTERN)
    flat, per_text = splitter.split(pa.array(texts))
    pieces = list(splitter.numbers)
    at = 0
    for text, n in zip(texts, per_text, strict=True):
        ids = [i for p in flat[at:at + n] for i in reference._encode_single_piece(pieces[p].encode())]
        at += n
        assert ids == reference.encode_ordinary(text)


@pytest.mark.parametrize(("name", "cut", "width"), [("byte_bpe_50k.json", "byte_level", 2), ("word_bpe_49k.json", "words", 4)])
def test_encoder_equals_whole_text_encoding(spark, sf, edge_rows, name, cut, width):
    import pyarrow as pa

    texts = [t or "" for _, t in edge_rows] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["Ends. with, stops., and..", "É. Ö, ß. Σ. ΑΣ. İ, ǅ.", "<|endoftext|> is text here", "tab\tand\r\nreturn", "á. é, x"]
    encode = hf(name)
    found = [(ids, n) for ids, n in Encoder(Vocabulary.load(public_tokenizers.path(name), cut), width, slice_bytes=200_000).encode(pa.array(texts))]
    ids, per_text = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    assert [list(map(int, p)) for p in np.split(ids, np.cumsum(per_text)[:-1])] == [encode(t) for t in texts]


def test_elias_fano_round_trip_and_space():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for universe in (1, 7, 10**6, 2**45):
            values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
            back, _ = tokenfile.EliasFano.load(tokenfile.EliasFano.build(values).dump())
            assert (back.values() == values).all()
            assert [back.select(k) for k in range(0, n, 7)] == values[::7].tolist()
    ends = np.cumsum(rng.integers(1, 2000, 100_000))
    assert len(tokenfile.EliasFano.build(ends).dump()) * 8 < 100_000 * 14  # a table of 64-bit offsets has 64 a document


def test_token_files(spark, edge_docs, edge_rows):
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"), "byte_level")
    folder = shared_folder(spark, "test-ids")
    tokenfile.write(edge_docs, folder, vocabulary, end_id=2)
    rows = tokenfile.read(spark, folder, slice_tokens=50).orderBy("start").collect()
    encode = hf("byte_bpe_50k.json")
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in edge_rows), key=key)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    got = sorted((key(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows)
    assert got == sorted((key(i), [*encode(t), 2]) for i, t in edge_rows)


def test_random_access_to_a_segment(spark, sf):
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"), "byte_level")
    folder = shared_folder(spark, "test-ids")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = tokenfile.write(docs, folder, vocabulary, end_id=2).orderBy("segment").collect()
    encode, texts = hf("byte_bpe_50k.json"), {r["doc_id"]: r["text"] for r in docs.collect()}
    part = tokenfile.Segment(folder, made[0]["segment"])
    for i in (0, len(part) // 2, len(part) - 1):
        assert part.ids(i).tolist() == [*encode(texts[part.doc_id(i)]), 2]


def test_token_files_of_an_empty_table(spark, no_docs):
    vocabulary = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"), "byte_level")
    folder = shared_folder(spark, "test-ids")
    assert tokenfile.write(no_docs, folder, vocabulary, end_id=2).collect() == []
    assert tokenfile.read(spark, folder).collect() == []


def best_fit_decreasing(lengths, capacity):
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        room = free.pop(k) if k < len(free) else capacity
        n += room == capacity
        if room > x:
            bisect.insort(free, room - x)
    return n


def check_places(places, capacity):
    by = {}
    for s, o, n in places:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_of_documents(edge_docs, edge_rows, no_docs):
    vocabulary = Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"), "words")
    rows = packing.pack_documents(edge_docs, vocabulary, end_id=1, capacity=512).collect()
    encode = hf("word_bpe_49k.json")
    want = []
    for i, t in edge_rows:
        ids = [*encode(t), 1]
        want += [(key(i), k, a, len(ids[a:a + 512]), zlib.crc32(np.array(ids[a:a + 512], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    used = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 512)
    assert used == best_fit_decreasing([w[3] for w in want], 512)
    assert packing.pack_documents(no_docs, vocabulary).collect() == []


@pytest.mark.parametrize("kind", ["mixed", "one hot length", "all over half"])
def test_rounds_over_many_ranges_come_close_to_best_fit(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": np.clip(rng.lognormal(5.5, 1.2, 3000), 1, 1000).astype(int),
        "one hot length": np.where(rng.random(3000) < 0.34, 333, rng.integers(1, 1001, 3000)),
        "all over half": rng.integers(501, 1001, 500),
    }[kind].tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "number long, length long")
    out = packing.pack(pieces, 1000, range_rows=400).collect()
    assert sorted((r["number"], r["length"]) for r in out) == list(enumerate(lengths))
    used = check_places([(r["sequence"], r["offset"], r["length"]) for r in out], 1000)
    assert used <= 1.02 * best_fit_decreasing(lengths, 1000) + 1


def test_hand_down_gives_each_gap_once():
    handed, opened = packing.hand_down([(0, 4, 4000, 0, 0, 0, 0), (1, 0, 0, 3, 900, 320, 280), (2, 2, 300, 9, 900, 110, 90)], 1000)
    ranks = [k for part, a, b, *_ in handed if part == 0 for k in range(a, b)]
    assert len(ranks) == len(set(ranks)) <= 4 and not opened
    handed, opened = packing.hand_down([(0, 0, 0, 10, 4500, 500, 400)], 1000)
    assert not handed and opened == [(0, 5)]
