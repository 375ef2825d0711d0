"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces longer than half a sequence open a sequence each; what is left free in a
sequence is a gap.  A round range-sorts the waiting pieces and the open gaps by
size, and every range is swept from large to small: a piece takes the smallest
gap that holds it (its successor), the longest piece first where several want
one gap, and what remains of the gap goes back into the sweep.  Gaps that a
range could not use are handed down, by rank, to the nearest ranges with
waiting pieces.  Where no gap is left above, the largest waiting pieces open as
many new sequences as the waiting volume needs beyond the gaps.  Then the next
round sorts again; the last one has few enough rows for a single range,
where the sweep is plain best fit and opens what it still needs.

Rows hold piece numbers and lengths only; no text or ids are shuffled.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise
from corpusloom.llm.hf import Encoder, Vocabulary
from corpusloom.session import ship_code

GAP, PIECE = 0, 1


def cut(
    docs: DataFrame, vocabulary: Vocabulary, end_id: int | None, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: _id, piece, start, length, ids_crc32 (and ids).

    Only documents of more than ``capacity`` ids are cut, into pieces of that
    length; the last one may be shorter.  A null or empty text holds only the
    end id; without an end id it has no piece.
    """
    ship_code()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = dict(rows.dtypes)["_id"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value, 4)
            owner, piece, start, length, crc, ids, k = [], [], [], [], [], [], 0
            for flat, per_text in encoder.encode(batch.column("_text")):
                if end_id is not None:
                    flat, per_text = np.insert(flat, np.cumsum(per_text), end_id), per_text + 1
                data, at = memoryview(flat.tobytes()), 0
                for n in per_text.tolist():
                    for number, first in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - first)
                        part = data[4 * (at + first):4 * (at + first + size)]
                        owner.append(k), piece.append(number), start.append(first), length.append(size), crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(bytes(part))
                    at += n
                    k += 1
            columns = [batch.column("_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.binary())] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return rows.mapInArrow(run, f"_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def sweep(kinds: list[int], numbers: list[int], lengths: list[int], capacity: int, opening: bool):
    """One range, sorted from large to small with gaps before pieces of their size (gaps handed down stand lower).

    Returns placements (piece, sequence, offset, length), gaps left (sequence,
    free; ascending) and pieces left (number, length; descending).
    """
    placed, waiting = [], []
    free: list[tuple[int, int]] = []  # (free length, sequence), ascending: its successor search is a bisection
    for kind, number, length in zip(kinds, numbers, lengths, strict=True):
        if kind == GAP:
            bisect.insort(free, (length, number))
            continue
        k = bisect.bisect_left(free, (length, -1))
        if k < len(free):
            room, sequence = free.pop(k)
            placed.append((number, sequence, capacity - room, length))
            if room > length:
                bisect.insort(free, (room - length, sequence))
        elif opening:
            placed.append((number, number, 0, length))
            if capacity > length:
                bisect.insort(free, (capacity - length, number))
        else:
            waiting.append((number, length))
    return placed, [(s, f) for f, s in free], waiting


def _round(state: DataFrame, capacity: int, ranges: int, opening: bool) -> DataFrame:
    """Range-sort and sweep; rows (kind, number, length, sequence, offset, part, rank).

    A placed piece has a sequence; open gaps and waiting pieces carry their
    rank within their range (``part``), counted from the largest on.
    """
    # A size with very many rows is spread over ranges by hash; within a range its gaps come first.
    size, spread = F.col("key").desc(), F.xxhash64("number", "kind")
    rows = state.repartitionByRange(ranges, size, spread).sortWithinPartitions(size, "kind", spread)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        column = lambda name: [v for b in got for v in b.column(name).to_pylist()]
        placed, gaps, waiting = sweep(column("kind"), column("number"), column("length"), capacity, opening)
        gaps.reverse()
        n, g, w = len(placed), len(gaps), len(waiting)
        yield pa.RecordBatch.from_arrays([
            pa.array([PIECE] * n + [GAP] * g + [PIECE] * w, pa.int32()),
            pa.array([p[0] for p in placed] + [s for s, _ in gaps] + [p for p, _ in waiting], pa.int64()),
            pa.array([p[3] for p in placed] + [f for _, f in gaps] + [x for _, x in waiting], pa.int64()),
            pa.array([p[1] for p in placed] + [None] * (g + w), pa.int64()),
            pa.array([p[2] for p in placed] + [None] * (g + w), pa.int64()),
            pa.array([part] * (n + g + w), pa.int32()), pa.array([0] * n + list(range(g)) + list(range(w)), pa.int64()),
        ], ["kind", "number", "length", "sequence", "offset", "part", "rank"])

    return rows.mapInArrow(run, "kind int, number long, length long, sequence long, offset long, part int, rank long")


def hand_down(ranges: list[tuple[int, int, int, int, int, int, int]], capacity: int, stuck: bool = False):
    """What happens to unused gaps and to pieces without any: two small tables.

    ``ranges`` has one entry per range, from the largest sizes on: (part, gaps
    left, their free length, pieces left, their length, their largest, their
    least).  Waiting pieces are given the nearest unused gaps above them, as a
    stack does, as many as hold their volume; the gaps are spread over the
    sizes of the range.  Of the pieces for which none are left the largest open
    new sequences: as many as the volume of all waiting pieces needs beyond the
    gaps there are, so that no sequence is opened too early (``stuck``, after a
    round that placed nothing: a quarter of the volume at least).  Returns
    [(part, first gap rank, end, its key, last key)] and [(part, number of its
    largest pieces that open)].
    """
    stack: list[list] = []
    handed, without = [], []
    for part, gaps, free, pieces, volume, head, tail in ranges:
        need = pieces
        while need > 0 and stack:
            source = stack[-1]
            holds = max(1, int(source[3] * pieces / volume))  # pieces that one of these gaps takes, on average
            take = min(-(-need // holds), source[2] - source[1])
            served = max(0, need - take * holds)
            at = [head - (head - tail) * (pieces - n) / pieces for n in (need, served)]
            handed.append((source[0], source[2] - take, source[2], *at))
            source[2] -= take
            need -= take * holds
            if source[1] == source[2]:
                stack.pop()
        if need > 0:
            without.append((part, need, volume * need / pieces))
        if gaps:
            stack.append([part, 0, gaps, free / gaps])
    waiting = sum(r[4] for r in ranges)
    short = waiting - sum(r[2] for r in ranges)
    if stuck:
        short = max(short, waiting / 4)
        without = [(r[0], r[3], r[4]) for r in ranges if r[3]]
    elif short <= 0 and not handed:
        short = sum(v for _, _, v in without)
    budget = max(0, math.ceil(short / capacity))
    opened = []
    for part, need, _ in without:
        take = min(need, budget)
        budget -= take
        if take:
            opened.append((part, take))
    return handed, opened


def pack(
    pieces: DataFrame, capacity: int, number_col: str = "number", length_col: str = "length", range_rows: int = 250_000, rounds: int = 40,
) -> DataFrame:
    """Rows (number, sequence, offset, length): places of pieces of 1 to ``capacity`` ids, gapless within a sequence.

    ``pieces`` must be materialised (it is read once per phase).  A range holds
    about ``range_rows`` rows; rounds go on until all that waits fits one range
    (after ``rounds`` of them every range opens what it needs).  No piece is
    ever left out.
    """
    ship_code()
    spark = pieces.sparkSession
    rows = pieces.select(F.col(number_col).alias("number"), F.col(length_col).cast("long").alias("length"))
    half = capacity // 2
    first = rows.where(F.col("length") > half).select("number", F.col("number").alias("sequence"), F.lit(0).cast("long").alias("offset"), "length")
    done = [first]
    gaps = first.where(F.col("length") < capacity).select(F.lit(GAP).alias("kind"), F.col("sequence").alias("number"), (F.lit(capacity) - F.col("length")).alias("length"))
    state = gaps.unionByName(rows.where(F.col("length") <= half).select(F.lit(PIECE).alias("kind"), "number", "length")).withColumn("key", F.col("length"))
    size = rows.where(F.col("length") < capacity).count()
    for step in range(rounds + 1):
        ranges = -(-size // range_rows)
        opening = ranges <= 1 or step == rounds
        result = materialise(_round(state, capacity, max(1, ranges), opening), "packing-round")
        placed = F.col("sequence").isNotNull()
        done.append(result.where(placed).select("number", "sequence", "offset", "length"))
        if opening:
            break
        left = result.where(~placed).drop("sequence", "offset")
        waits, free = F.col("kind") == PIECE, F.col("kind") == GAP
        # One row per range: bounded by the number of partitions.
        per_range = left.groupBy("part").agg(
            F.count_if(free).alias("gaps"), F.sum(F.when(free, F.col("length")).otherwise(0)).alias("free"), F.count_if(waits).alias("pieces"),
            F.sum(F.when(waits, F.col("length")).otherwise(0)).alias("volume"), F.max(F.when(waits, F.col("length")).otherwise(0)).alias("head"),
            F.min(F.when(waits, F.col("length"))).alias("least"),
        ).orderBy("part").collect()
        settled = result.where(placed).limit(1).count()
        size = sum(r["pieces"] for r in per_range)
        if not size:
            break
        least = min(r["least"] for r in per_range if r["least"] is not None)
        handed, opened = hand_down(
            [(r["part"], r["gaps"], r["free"], r["pieces"], r["volume"], r["head"], r["least"] or 0) for r in per_range], capacity, stuck=not settled)
        size += sum(r["gaps"] for r in per_range)
        given = F.broadcast(spark.createDataFrame(handed, "part int, a long, b long, top double, low double"))
        starts = F.broadcast(spark.createDataFrame(opened, "part int, take long"))
        left = left.alias("l").join(given.alias("g"), (F.col("l.part") == F.col("g.part")) & (F.col("l.kind") == GAP) & F.col("l.rank").between(F.col("g.a"), F.col("g.b") - 1), "left")
        left = left.join(starts.alias("o"), (F.col("l.part") == F.col("o.part")) & (F.col("l.kind") == PIECE) & (F.col("l.rank") < F.col("o.take")), "left")
        to = F.floor(F.col("g.top") - (F.col("g.top") - F.col("g.low")) * (F.col("l.rank") - F.col("g.a")) / (F.col("g.b") - F.col("g.a")))
        left = left.select("l.kind", "l.number", "l.length", F.coalesce(F.least(to, "l.length"), "l.length").alias("key"), F.col("o.take").isNotNull().alias("opens"))
        done.append(left.where("opens").select("number", F.col("number").alias("sequence"), F.lit(0).cast("long").alias("offset"), "length"))
        free_now = F.when(F.col("opens"), F.lit(capacity) - F.col("length")).otherwise(F.col("length"))
        state = left.select(
            F.when(F.col("opens"), F.lit(GAP)).otherwise(F.col("kind")).alias("kind"), "number", free_now.alias("length"),
            F.when(F.col("opens"), free_now).otherwise(F.col("key")).alias("key"),
        ).where((F.col("kind") == PIECE) | (F.col("length") >= least))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(
    docs: DataFrame, vocabulary: Vocabulary, end_id: int | None = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each for itself; an empty table gives no rows.
    """
    made = materialise(cut(docs, vocabulary, end_id, capacity, id_col, text_col).withColumn("number", F.monotonically_increasing_id()), "packing-pieces")
    places = pack(made, capacity).select("number", F.col("sequence").alias("sequence_id"), "offset")
    return made.join(places, "number").select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
