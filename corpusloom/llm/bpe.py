"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Blocks of texts are split into pre-tokens; a block keeps, per text, the
   numbers of its pre-tokens in order of position, and its distinct words.
2. The distinct words of all blocks are shuffled by word hash.  Each distinct
   word is in one place only and is encoded there once.
3. The ids are joined back by block and every text is put together again by
   position.

A frequent word costs one entry per block, never one per occurrence, so no
word is hot; blocks and word groups are bounded by their parameters.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import file_bytes, id_and_text, release_memory, shared_folder
from corpusloom.llm.pretoken import RANK_LIMIT, Splitter, by_chars, from_planes, gather, in_slices, join_ranks, planes, split_ranks
from corpusloom.session import ship_code

SEQUENCES = -1


@dataclass(frozen=True)
class Ranks:
    """A vocabulary of ranked byte strings (bounded by the size check of its file) and the split pattern."""

    data: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Ranks:
        return cls(file_bytes(path), pattern)

    def table(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.data.splitlines() if line.strip())}

    def encoder(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.table(), special_tokens={})

    def token_bytes(self) -> list[bytes]:
        table = self.table()
        out = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            out[rank] = token
        return out


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return planes(lengths, 4) + b"".join(words)


def _unpack_words(data: bytes, count: int) -> list[bytes]:
    ends = 4 * count + np.cumsum(from_planes(data[:4 * count], count, 4).astype(np.int64))
    starts = np.concatenate([[4 * count], ends[:-1]])
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def split_blocks(rows: DataFrame, pattern: str, parts: int, block_chars: int) -> DataFrame:
    """Blocks as rows (block, part, n, ids, payload): one of sequences (part -1) and one per non-empty word group."""
    id_type = dict(rows.dtypes)["_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3).compress
        base = TaskContext.get().partitionId() << 32
        made = 0

        def finish(splitter: Splitter, ids: list, numbers: list[np.ndarray], per_text: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            block = base + made
            made += 1
            flat, per_text = np.concatenate(numbers), np.concatenate(per_text)
            words = np.array([w.encode() for w in splitter.numbers], object)
            uses = np.bincount(flat, minlength=len(words))
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words = words[order]
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.uint32, len(words))
            sequence = planes(per_text, 4) + planes(part, 2) + (split_ranks(rank[flat]) if len(words) <= RANK_LIMIT else planes(rank[flat], 4))
            out = [(SEQUENCES, len(words), press(sequence))]
            by_part = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by_part])) + 1
            for group in np.split(by_part, cuts) if len(words) else []:
                out.append((int(part[group[0]]), len(group), press(_pack_words(words[group].tolist()))))
            carried = [pa.concat_arrays(ids)] + [None] * (len(out) - 1)
            return pa.RecordBatch.from_arrays([
                pa.array([block] * len(out), pa.int64()), pa.array([p for p, _, _ in out], pa.int32()), pa.array([n for _, n, _ in out], pa.int32()),
                pa.array([c.to_pylist() if c is not None else None for c in carried], pa.list_(carried[0].type)),
                pa.array([d for _, _, d in out], pa.binary()),
            ], ["block", "part", "n", "ids", "payload"])

        splitter, ids, numbers, per_text, size = Splitter(pattern), [], [], [], 0
        for batch in batches:
            at = 0
            for texts in by_chars(batch.column("_text"), min(block_chars, 4_000_000)):
                flat, lengths = splitter.split(texts)
                ids.append(batch.column("_id").slice(at, len(texts)))
                numbers.append(flat), per_text.append(lengths)
                at += len(texts)
                size += texts.nbytes
                if size >= block_chars or len(splitter.numbers) >= RANK_LIMIT // 2:
                    yield finish(splitter, ids, numbers, per_text)
                    release_memory()
                    splitter, ids, numbers, per_text, size = Splitter(pattern), [], [], [], 0
        if ids:
            yield finish(splitter, ids, numbers, per_text)

    return rows.mapInArrow(run, f"block long, part int, n int, ids array<{id_type}>, payload binary")


def encode_words(groups: DataFrame, ranks: Ranks, cache_words: int = 2_000_000) -> DataFrame:
    """Word groups with their words replaced by ids; equal words are in one partition and encoded once there."""
    shared = groups.sparkSession.sparkContext.broadcast(ranks)
    spread = groups.repartition("part").select("block", "part", "n", "payload")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press, unpress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        encode = None
        known: dict[bytes, bytes] = {}
        for batch in batches:
            if encode is None:
                # One match of the pattern at a time: the word goes to the merges as it is.
                encode = shared.value.encoder()._encode_single_piece
            payloads = []
            for count, payload in zip(batch.column("n").to_pylist(), batch.column("payload"), strict=True):
                packed = []
                for word in _unpack_words(unpress(payload.as_py()), count):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= cache_words:  # memory bound; words seen again are encoded again, to the same ids
                            known.clear()
                        ids = known[word] = np.array(encode(word), np.uint32).tobytes()
                    packed.append(ids)
                lengths = np.fromiter((len(p) // 4 for p in packed), np.uint32, len(packed))
                payloads.append(press(planes(lengths, 4) + planes(np.frombuffer(b"".join(packed), np.uint32), 4)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("part"), batch.column("n"), pa.array(payloads, pa.binary())], ["block", "part", "n", "payload"])

    return spread.mapInArrow(run, "block long, part int, n int, payload binary")


def assemble(sequences: DataFrame, encoded: DataFrame, slice_words: int = 150_000) -> DataFrame:
    """Rows (_id, ids): the sequences of a block with the ids of its words, in order of position.

    ``sequences`` is bucketed by block, so only the word groups are shuffled here.
    """
    id_type = dict(sequences.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    groups = encoded.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", F.col("n").alias("count"), F.col("payload").alias("packed")))).alias("groups"))
    rows = sequences.join(groups, "block", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress

        def texts(n_words: int, ids: pa.Array, data: bytes, groups: list[dict]) -> Iterator:
            raw = unpress(data)
            count = len(ids)
            per_text = from_planes(raw[:4 * count], count, 4).astype(np.int64)
            at = 4 * count
            part = from_planes(raw[at:at + 2 * n_words], n_words, 2)
            at += 2 * n_words
            total = int(per_text.sum())
            flat = join_ranks(raw[at:], total) if n_words <= RANK_LIMIT else from_planes(raw[at:], total, 4)
            lengths, values = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
            for group in groups:
                n, g = group["count"], unpress(group["packed"])
                lengths.append(from_planes(g[:4 * n], n, 4))
                values.append(from_planes(g[4 * n:], (len(g) - 4 * n) // 4, 4))
            grouped, table = np.concatenate(lengths).astype(np.int64), np.concatenate(values).astype(np.int32)
            if len(grouped) != n_words:
                raise RuntimeError(f"block with {n_words} words met the ids of {len(grouped)}")
            by_part = np.argsort(part, kind="stable")
            word_len, word_at = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
            word_len[by_part], word_at[by_part] = grouped, np.cumsum(grouped) - grouped
            ends = np.cumsum(per_text)
            for a, b in in_slices(ends, slice_words):
                picks = flat[int(ends[a - 1]) if a else 0:int(ends[b - 1])]
                tokens = gather(table, word_at, word_len, picks)
                # Ids of a text: sums of the lengths of its words.
                running = np.concatenate([[0], np.cumsum(word_len[picks])])
                cuts = np.concatenate([[0], np.cumsum(per_text[a:b])])
                column = pa.ListArray.from_arrays(pa.array(running[cuts].astype(np.int32)), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), column], ["_id", "ids"])

        for batch in batches:
            for k in range(batch.num_rows):
                yield from texts(
                    batch.column("n")[k].as_py(), batch.column("ids")[k].values, batch.column("payload")[k].as_py(), batch.column("groups")[k].as_py() or [])

    return rows.select("n", "ids", "payload", "groups").mapInArrow(run, f"_id {id_type}, ids array<int>")


def bucketed_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes the blocks once to the shared folder, bucketed by block; returns (sequences, word groups).

    The join that puts texts together then needs no shuffle of the sequences.
    The table is an unmanaged one: dropping its entry leaves its files, and the
    owner of the checkpoint folder clears those.
    """
    spark = blocks.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = blocks.withColumn("kind", F.when(F.col("part") == SEQUENCES, F.lit("sequence")).otherwise(F.lit("words")))
    kinds.write.partitionBy("kind").bucketBy(buckets, "block").option("path", shared_folder(spark, "bpe-blocks")).saveAsTable(name)
    table = spark.table(name)
    return table.where("kind = 'sequence'").drop("kind", "part"), table.where("kind = 'words'").drop("kind", "ids")


def encode(
    docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_chars: int = 12_000_000,
) -> DataFrame:
    """One row per input row: ``id_col`` and ``ids`` (array of int), special tokens never used.

    Null and empty texts give an empty array; repeated rows each get a row; an
    empty table gives none.  ``block_chars`` bounds the bytes of a block's texts
    (one longer text is a block of its own), ``parts`` is the number of word
    groups (default: four per shuffle partition, at most 4096): a task holds
    the distinct words of its groups, so raise both together with the data.
    """
    ship_code()
    spark = docs.sparkSession
    parts = parts or max(8, min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sequences, words = bucketed_blocks(split_blocks(id_and_text(docs, id_col, text_col), ranks.pattern, parts, block_chars))
    return assemble(sequences, encode_words(words, ranks)).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, ranks: Ranks, id_col: str = "doc_id") -> DataFrame:
    """Adds ``bytes`` to rows of (id, ids): the map-side join of the ids with the token-byte table, by position.

    The table has one entry per vocabulary entry and is bounded by the size
    check of its file, so it is broadcast.  Null ids give null bytes.
    """
    ship_code()
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    types = dict(encoded.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        look = shared.value.token_bytes().__getitem__
        for batch in batches:
            column = batch.column("ids")
            flat, ends = column.flatten().to_numpy(), np.cumsum(np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)).tolist()
            data = [b"".join(map(look, flat[a:b].tolist())) for a, b in zip([0, *ends], ends, strict=False)]
            if column.null_count:
                data = [d if ok else None for d, ok in zip(data, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), column, pa.array(data, pa.binary())], [id_col, "ids", "bytes"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {types[id_col]}, ids array<int>, bytes binary")
