"""Phrase collocations by set-oriented relational mining (SETM) over persisted occurrence relations.

R_1 holds every word occurrence as (piece, position, word), sorted, and is
persisted once, in blocks of whole pieces of one language.  Every further length
is made from relations alone:

  merge-join   R_k with R_1 on the same piece and position + k gives the
               occurrences of all phrases of k + 1 words whose first k words and
               last word are frequent;
  group-count  each block counts its distinct phrases (map-side) and sends them
               as sorted arrays, dealt by the hash of the phrase; a task adds
               the counts of one part of all phrases;
  semi-join    phrases of ``min_count`` occurrences or more get a number and go
               back to the blocks that hold them; only their occurrences
               enter R_(k+1), which is persisted in turn.

A phrase crosses the network once per block and length, however frequent it is,
so no word or phrase makes a hot key.  A phrase's words are all frequent where
the phrase is, so nothing is lost.  Numbers of phrases are integers, equal phrases
have equal numbers: counts are exact.

Rules for the cases that a caller may wonder about: a null text is empty, a null
language counts as ``und`` (and meets rows that say so), repeated rows count as
often as they occur, ids are not looked at, columns other than text and language
are left behind, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, release_memory
from corpusloom.session import ship_code

BLOCK_BYTES = 4 << 20
PART_KEYS = 1_500_000      # phrase occurrences that one counting task takes at most, on average
NO_LANGUAGE = "und"
PIECE_ENDS = b".,;:!?\x0A\x0B\x0C\x0D"

_LOWER_AND_CUT = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + PIECE_ENDS + b"\t",
    bytes(range(ord("a"), ord("z") + 1)) + b"\n" * len(PIECE_ENDS) + b" ")


def occurrences(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of the word at each position, the piece number at each position.

    ``data`` is text in which ``_LOWER_AND_CUT`` was applied: words end at spaces, pieces at newlines.
    """
    raw = np.frombuffer(data, np.uint8)
    ends_piece = raw == 10
    inside = ~(ends_piece | (raw == 32))
    if not inside.any():
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int32)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, stops = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(ends_piece), starts).astype(np.int32)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int32), piece


def slices(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in runs of whole pieces of about ``size`` bytes (a longer piece stays whole)."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b"\n", at, at + size)
        if cut < 0:
            cut = data.find(b"\n", at + size)
        if cut < 0:
            break
        yield data[at:cut + 1]
        at = cut + 1
    yield data[at:]


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers >= 0 as compressed bytes: differences if they ascend, no more bytes each than the largest needs, byte by byte."""
    x = np.diff(x, prepend=0) if ascending else x
    x = np.ascontiguousarray(x, np.int64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width, ascending]) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(data: bytes) -> np.ndarray:
    n, width, ascending = int.from_bytes(data[:8], "little"), data[8], data[9]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[10:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    x = out.view(np.int64).ravel()
    return np.cumsum(x) if ascending else x


R1_SCHEMA = "block long, lang string, n long, words array<binary>, codes binary, pieces binary"


def _persist_words(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """R_1, with word numbers of the block: blocks of one language each, cut at piece ends."""
    rows = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("_lang")).where("length(_text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def block(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            held.pop(lang)
            for data in slices(b"\n".join(waiting.pop(lang)), block_bytes):
                words, codes, pieces = occurrences(data)
                if len(codes):
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([number], pa.int64()), "lang": [lang], "n": pa.array([len(codes)], pa.int64()),
                        "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                        "codes": [pack(codes)], "pieces": [pack(pieces, ascending=True)]})
                    number += 1

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_buffer().to_pybytes().translate(_LOWER_AND_CUT)
                waiting.setdefault(lang, []).append(data)
                held[lang] = held.get(lang, 0) + len(data) + 1
                # Where a task meets many languages, the fullest goes first.
                if held[lang] >= block_bytes or sum(held.values()) >= 4 * block_bytes:
                    yield from block(max(held, key=held.__getitem__))
            release_memory()
        for lang in list(waiting):
            yield from block(lang)

    return materialise(rows.mapInArrow(run, R1_SCHEMA), "occurrences")


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts a phrase, by a hash of its key."""
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


DEALT = "part long, block long, words array<binary>, keys binary, n binary"


def _dealt(block: int, part: np.ndarray, counts: np.ndarray, words: pa.Array | None = None, keys: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A block's distinct words or phrase keys (ascending) and their counts, one row per part; words also with their numbers in the block."""
    order = np.argsort(part, kind="stable")
    used, first = np.unique(part[order], return_index=True)
    groups = np.split(order, first[1:]) if len(used) else []
    for p, g in zip(used, groups):
        yield pa.RecordBatch.from_arrays([
            pa.array([p], pa.int64()), pa.array([block], pa.int64()),
            pa.nulls(1, pa.list_(pa.binary())) if words is None else pa.ListArray.from_arrays(pa.array([0, len(g)], pa.int32()), words.take(pa.array(g))),
            pa.array([pack(g if keys is None else keys[g], ascending=True)]), pa.array([pack(counts[g])])], names=["part", "block", "words", "keys", "n"])


def _group_count(dealt: DataFrame, parts: int, min_count: int, of_words: bool, label: str) -> DataFrame:
    """Adds the counts of each part; frequent keys get numbers and go back to the blocks they came from.

    Rows with a null block are the frequent words or keys themselves (words or keys, ids, n); the others say
    which of the keys that a block sent are frequent, and their numbers (found, numbers).
    """
    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sent = [unpack(k) for k in table.column("keys").to_pylist()]
        keys = table.column("words").combine_chunks().flatten() if of_words else pa.array(np.concatenate(sent), pa.int64())
        flat = pa.table({"key": keys, "n": np.concatenate([unpack(n) for n in table.column("n").to_pylist()])})
        total = flat.group_by("key").aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), min_count))
        known = total.column("key").combine_chunks()
        # rank * parts + part is unique and about as small as a gapless number.
        found = pc.index_in(keys, value_set=known).fill_null(-1).to_numpy()
        at, back = 0, []
        for block, own in zip(table.column("block").to_pylist(), sent):
            rank = found[at:at + len(own)]
            at += len(own)
            hit = rank >= 0
            if hit.any():
                back.append((block, pack(own[hit], ascending=True), pack(rank[hit].astype(np.int64) * parts + part + 1)))
        one = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known)
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(x, pa.int64()))
        pad = lambda x: pa.concat_arrays([x, pa.nulls(len(back), x.type)])
        return pa.table({
            "block": pa.array([None, *(b[0] for b in back)], pa.int64()), "found": pa.array([None, *(b[1] for b in back)], pa.binary()), "numbers": pa.array([None, *(b[2] for b in back)], pa.binary()),
            "keys": pad(one), "ids": pad(lists(np.arange(len(known)) * parts + part + 1)), "n": pad(lists(total.column("n_sum").to_numpy()))})

    schema = f"block long, found binary, numbers binary, keys array<{'binary' if of_words else 'long'}>, ids array<long>, n array<long>"
    return materialise(dealt.groupBy("part").applyInArrow(count, schema), label)


def _returned(counted: DataFrame) -> DataFrame:
    """Per block, what of it is frequent: one entry per part."""
    return counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("found", "numbers")).alias("_found"))


def _frequent(counted: DataFrame) -> DataFrame:
    return counted.where("block is null").select(F.explode(F.arrays_zip("keys", "ids", "n")).alias("r")).select(
        F.col("r.keys").alias("key"), F.col("r.ids").alias("id"), F.col("r.n").alias("a"))


def _found_arrays(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """What a block sent and is frequent, ascending, and the numbers."""
    rows = cell.as_py()
    keys, ids = np.concatenate([unpack(r["found"]) for r in rows]), np.concatenate([unpack(r["numbers"]) for r in rows])
    order = np.argsort(keys)
    return keys[order], ids[order]


REL_SCHEMA = "block long, pieces binary, number binary, codes binary, pos binary, ids binary"


def _relations(row: dict) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Pieces of all positions; R_1 and R_k as (positions, numbers)."""
    of = np.append(unpack(row["number"]), 0)[unpack(row["codes"])]
    pos = np.flatnonzero(of)
    one = pos, of[pos]
    return unpack(row["pieces"]), one, one if row["pos"] is None else (unpack(row["pos"]), unpack(row["ids"]))


def _merge_join(k: tuple[np.ndarray, np.ndarray], one: tuple[np.ndarray, np.ndarray], pieces: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """R_k with R_1 on the same piece and position + k: (positions, keys) of phrases one word longer."""
    pos, ids = k
    if not len(one[0]):
        return pos[:0], ids[:0]
    at = np.searchsorted(one[0], pos + length)
    at[at == len(one[0])] = 0
    hit = one[0][at] == pos + length
    hit[hit] = pieces[pos[hit]] == pieces[pos[hit] + length]
    return pos[hit], ids[hit] << bits | one[1][at[hit]]


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, text_col: str = "text", lang_col: str = "lang",
                     block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, a) of all phrases of up to ``max_words`` words with a >= ``min_count``; (lang, n) of all words."""
    ship_code()
    blocks = _persist_words(docs, text_col, lang_col, block_bytes)
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    occurrences_in_all = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(occurrences_in_all / part_keys))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["block", "lang", "codes"]).to_pylist()):
                keys = pc.binary_join_element_wise(batch.column("words")[i].values, row["lang"].encode(), b"\n")
                part = np.fromiter((zlib.crc32(k) % parts for k in keys.to_pylist()), np.int64, len(keys))
                yield from _dealt(row["block"], part, np.bincount(unpack(row["codes"]), minlength=len(keys)), words=keys)
            release_memory()

    counted = _group_count(blocks.select("block", "lang", "words", "codes").mapInArrow(words, DEALT), parts, min_count, True, "words-counted")
    split = F.split(F.col("key").cast("string"), "\n", 2)
    single = materialise(_frequent(counted).select("id", split[1].alias("lang"), split[0].alias("phrase"), F.lit(1).alias("n_words"), "a"), "words-frequent")
    top = single.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    bits, id_bits = int(top).bit_length(), int(top).bit_length()

    def first_relation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["_found"]).to_pylist()):
                # The block's words are numbered anew, without those that are not frequent.
                own, ids = _found_arrays(batch.column("_found")[i])
                codes = unpack(row["codes"])
                new = np.full(int(codes.max()) + 1, len(own))
                new[own] = np.arange(len(own))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]], pa.int64()), "pieces": [row["pieces"]], "number": [pack(ids)], "codes": [pack(new[codes])],
                    "pos": pa.nulls(1, pa.binary()), "ids": pa.nulls(1, pa.binary())})
            release_memory()

    phrases, longest = [single], single
    if max_words < 2 or not top:
        return _phrase_union(phrases), sizes
    relation = materialise(blocks.select("block", "codes", "pieces").join(_returned(counted), "block").mapInArrow(first_relation, REL_SCHEMA), "relation-1")
    for length in range(1, max_words):
        if bits + id_bits > 63:
            raise ValueError(f"{bits} + {id_bits} bits for the numbers of phrases and words do not fit one key")

        def longer(batches: Iterator[pa.RecordBatch], length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    pieces, one, k = _relations(row)
                    keys, counts = np.unique(_merge_join(k, one, pieces, length, bits)[1], return_counts=True)
                    yield from _dealt(row["block"], _parts(keys, parts), counts, keys=keys)
                release_memory()

        counted = _group_count(relation.mapInArrow(longer, DEALT), parts, min_count, False, f"phrases-{length + 1}")
        found = _frequent(counted).select("id", "a", F.shiftright("key", bits).alias("_head"), F.col("key").bitwiseAND((1 << bits) - 1).alias("_last"))
        longest = materialise(
            found.join(longest.select(F.col("id").alias("_head"), "lang", F.col("phrase").alias("_p")), "_head")
            .join(single.select(F.col("id").alias("_last"), F.col("phrase").alias("_w")), "_last")
            .select("id", "lang", F.concat_ws(" ", "_p", "_w").alias("phrase"), F.lit(length + 1).alias("n_words"), "a"), f"phrases-{length + 1}-frequent")
        phrases.append(longest)
        top = longest.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if not top or length + 1 == max_words:
            break
        id_bits = int(top).bit_length()

        def semi_joined(batches: Iterator[pa.RecordBatch], length=length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, row in enumerate(batch.drop_columns(["_found"]).to_pylist()):
                    pieces, one, k = _relations(row)
                    pos, keys = _merge_join(k, one, pieces, length, bits)
                    known, numbers = _found_arrays(batch.column("_found")[i])
                    at = np.searchsorted(known, keys)
                    at[at == len(known)] = 0
                    keep = known[at] == keys
                    row |= {"pos": pack(pos[keep], ascending=True), "ids": pack(numbers[at[keep]])}
                    yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int64() if c == "block" else pa.binary()) for c, v in row.items()})
                release_memory()

        relation = materialise(relation.join(_returned(counted), "block").mapInArrow(semi_joined, REL_SCHEMA), f"relation-{length + 1}")
    return _phrase_union(phrases), sizes


def _phrase_union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select("lang", "phrase", "n_words", "a")


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, scale: int = 1_000_000, covered_percent: int = 50, top: int | None = None,
                 text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of 2 to ``max_words`` words, ranked in their language.

    a: occurrences.  For the cut (after the first k words) with the lowest
    score floor(scale * a * a / (l * r)), the first of them where several tie: l and r are the occurrences
    of both sides.  A phrase goes where a longer frequent phrase that contains
    it reaches ``covered_percent`` of its occurrences.  Ranks go by score, then a, both descending, then
    by the bytes of the phrase; ``top`` keeps so many ranks (none: all).  Products are decimals of 38 digits.
    """
    phrases, sizes = frequent_phrases(docs, min_count, max_words, text_col, lang_col, block_bytes, part_keys)
    known = phrases.select("lang", "phrase", "a")
    longer = phrases.where("n_words >= 2").withColumn("_w", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("_w", F.lit(1), F.col("k")), " ").alias("_left"),
                       F.array_join(F.slice("_w", F.col("k") + 1, F.size("_w") - F.col("k")), " ").alias("_right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l")), ["lang", "_left"]) \
        .join(known.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r")), ["lang", "_right"])
    exact = "cast(a as decimal(14,0))"
    score = F.expr(f"cast({scale} as decimal(9,0)) * {exact} * {exact} div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # All runs of words of the longer phrases, with the most occurrences of a phrase around each.
    spans = F.expr("flatten(transform(sequence(2, size(_w) - 1), m -> transform(sequence(1, size(_w) - m + 1), i -> array_join(slice(_w, i, m), ' '))))")
    around = longer.where("n_words >= 3").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("_around")).groupBy("lang", "phrase").agg(F.max("_around").alias("_around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.expr(f"_around is null or 100 * _around < {covered_percent} * a"))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # A language may hold most phrases: first among a share of them, then among the winners.
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("_r") <= top).drop("_r")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
