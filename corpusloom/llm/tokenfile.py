"""Token-id files: a concatenated id array with Elias-Fano document boundaries.

A folder holds segments in ascending document order.  ``segment-N.ids`` is the
raw little-endian id array; ``segment-N.idx`` holds two Elias-Fano sequences,
the document ids (as gaps from the first) and the end offsets of the documents,
each with select samples, so the place of any document is found in near-minimal
space without a table of 64-bit offsets.  ``manifest`` (Parquet) names the
segments with their counts and is written last.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import id_and_text
from corpusloom.llm.hf import Encoder, Vocabulary
from corpusloom.session import ship_code

MAGIC = b"EFTOKEN1"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of n integers below ``universe`` in about n * (2 + log2(universe / n)) bits.

    Low bits are stored as they are; high parts in unary in a bit array, with
    the position of every ``SAMPLE``-th one kept for select.
    """

    HEADER = "<QQBQQ"

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        shift = np.uint64(low_bits)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        bits[ones] = 1
        low = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        return cls(n, universe, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4" if not n or ones[-1] < 1 << 32 else "<u8"))

    def dump(self) -> bytes:
        wide = self.samples.dtype.itemsize
        head = struct.pack(self.HEADER, self.n, self.universe, self.low_bits | (0x80 if wide == 8 else 0), len(self.low), len(self.high))
        return head + struct.pack("<Q", len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, flags, n_low, n_high = struct.unpack_from(cls.HEADER, data, at)
        at += struct.calcsize(cls.HEADER)
        (n_samples,) = struct.unpack_from("<Q", data, at)
        at += 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        kind = np.dtype("<u8" if flags & 0x80 else "<u4")
        samples = np.frombuffer(data, kind, n_samples, at + n_low + n_high)
        return cls(n, universe, flags & 0x7F, low, high, samples), at + n_low + n_high + n_samples * kind.itemsize

    def _low(self, i: int) -> int:
        out = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, whole bytes by their number of ones, then bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = position >> 3
        bits = int(self.high[byte]) >> (position & 7) << (position & 7)
        while left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        position = byte * 8 + (bits & -bits).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= low[:, k].astype(np.uint64) << np.uint64(k)
        return out


def open_folder(folder: str):
    """(file system, path) of a folder given as URI or local path, on driver and executors alike."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _put(files, path: str, data_or_move: bytes | str) -> None:
    """Files appear under their name whole: written aside, then moved."""
    if isinstance(data_or_move, str):
        files.move(data_or_move, path)
        return
    aside = f"{path}.part"
    with files.open_output_stream(aside) as out:
        out.write(data_or_move)
    files.move(aside, path)


def write(docs: DataFrame, folder: str, vocabulary: Vocabulary, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes all texts and writes them in ascending order of the (integer) id; returns the manifest.

    Null and empty texts hold only the end id (nothing without one).  Null ids
    come first and are kept as such; rows with equal ids stand together,
    ordered by a hash of their text, also where one id has very many rows.  A
    lost task writes its segment anew under the same name.  An empty table
    gives an empty manifest.
    """
    ship_code()
    spark = docs.sparkSession
    width = vocabulary.id_width()
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = id_and_text(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files, root = open_folder(folder)
    files.create_dir(f"{root}/data", recursive=True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        segment, attempt = context.partitionId(), context.taskAttemptId()
        files, root = open_folder(folder)
        name = f"{root}/data/segment-{segment:07d}"
        ids, lengths, nulls, out, encoder = [], [], 0, None, None
        for batch in batches:
            if out is None:
                encoder = Encoder(shared.value, width)
                out = files.open_output_stream(f"{name}.ids.{attempt}", buffer_size=1 << 20)
            column = batch.column("_id")
            nulls += column.null_count
            ids.append(column.drop_null().to_numpy(zero_copy_only=False))
            for flat, per_text in encoder.encode(batch.column("_text")):
                if end_id is not None:
                    flat, per_text = np.insert(flat, np.cumsum(per_text), end_id), per_text + 1
                out.write(flat.tobytes())
                lengths.append(per_text)
        if out is None:
            return
        out.close()
        known = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        first = int(known[0]) if len(known) else 0
        ends = np.cumsum(np.concatenate(lengths))
        head = MAGIC + struct.pack("<BQqQ", width, nulls, first, int(ends[-1]))
        gaps = EliasFano.build(known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)).dump()
        _put(files, f"{name}.idx", head + gaps + EliasFano.build(ends).dump())
        _put(files, f"{name}.ids", f"{name}.ids.{attempt}")
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1])], pa.int64())],
                                         ["segment", "n_docs", "n_tokens"])

    rows.mapInArrow(run, "segment int, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with their first document number and id offset over the whole folder (one row per file)."""
    ship_code()
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("segment int, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    return rows.select("*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(a) for n, a in (("n_docs", "first_doc"), ("n_tokens", "first_id"))])


class Segment:
    """Random access to the documents of one segment through its select structures."""

    def __init__(self, folder: str, segment: int):
        self.files, root = open_folder(folder)
        self.name = f"{root}/data/segment-{segment:07d}"
        with self.files.open_input_stream(f"{self.name}.idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{self.name}.idx is no index of token ids")
        self.width, self.nulls, self.first, self.n_tokens = struct.unpack_from("<BQqQ", data, 8)
        at = 8 + struct.calcsize("<BQqQ")
        self.gaps, at = EliasFano.load(data, at)
        self.ends, _ = EliasFano.load(data, at)

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.gaps.select(i - self.nulls)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        with self.files.open_input_file(f"{self.name}.ids") as f:
            return np.frombuffer(f.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + g for g in self.gaps.values().tolist()]


def read(spark: SparkSession, folder: str, slice_tokens: int = 4_000_000) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32 bit)."""
    ship_code()
    segments = manifest(spark, folder)
    files = max(1, spark.read.parquet(f"{folder}/manifest").count())
    segments = segments.repartition(files)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                part = Segment(folder, row["segment"])
                doc_ids, ends = part.doc_ids(), part.ends.values().astype(np.int64)
                with part.files.open_input_file(f"{part.name}.ids") as f:
                    at = 0
                    while at < len(ends):
                        base = int(ends[at - 1]) if at else 0
                        to = max(at + 1, int(np.searchsorted(ends, base + slice_tokens, side="right")))
                        ids = np.frombuffer(f.read_at((int(ends[to - 1]) - base) * part.width, base * part.width), f"<u{part.width}").astype("<u4").tobytes()
                        cuts = [0, *(ends[at:to] - base).tolist()]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids[at:to], pa.int64()), pa.array([row["first_id"] + base + c for c in cuts[:-1]], pa.int64()),
                            pa.array([ids[4 * a:4 * b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        ], ["doc_id", "start", "ids"])
                        at = to

    return segments.mapInArrow(run, "doc_id long, start long, ids binary")
