"""Removes repeated byte strings by a sampled, range-partitioned suffix sort.

A string of ``length`` bytes that occurs twice is found from one suffix inside it.
Which one, its bytes alone decide: of its runs of ``SEED`` bytes the one with the
least hash (the first of equals), so both occurrences choose the same place.
About one byte in 85 starts such a suffix; only those whose seed occurs elsewhere
too go on, with ``length`` bytes to the right and ``length - SEED`` to the left.

Sampled splitters deal the suffixes to buckets by their leading bytes (equal
leading bytes may be split over buckets, so a passage that very many texts share
does not meet in one task).  A bucket sorts them by multikey quicksort, to the
right and, within equal seeds, to the left; a string that begins t bytes before its suffix
is repeated if another suffix of the bucket agrees in t bytes to the left and the
rest to the right, which the common prefixes of neighbours in both orders say exactly.
Strings that could also begin with the leading bytes of a neighbouring bucket are
compared across boundaries: each bucket sends one 128-bit hash for every such string
(one for all its equal ones), and those met twice are repeated.

Copies of a whole text are one text before all that.  Matches lie inside one text.

Rules: texts are taken as their UTF-8 bytes; a null text is empty; repeated rows are texts of their own
(each repeats the others); ids may be null or repeated; other columns are left behind; texts
shorter than ``length`` bytes stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, materialise, release_memory
from corpusloom.llm.dartminhash import mix
from corpusloom.session import ship_code

LENGTH = 200
SEED = 32
LEADING = 64               # bytes by which suffixes are dealt
BUCKET_SUFFIXES = 40_000   # suffixes of a bucket on average
CHUNK = 1 << 20            # bytes hashed at a time
U64 = np.uint64
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))
_PLACE = U64((1 << 24) - 1)


def _seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from each position on (doubling: 2m bytes from two runs of m)."""
    h, m, power = raw.astype(U64) + U64(1), 1, BASES[0]
    while m < SEED:
        h = h[:-m] * power + h[m:]
        m, power = 2 * m, power * power
    return mix(h)


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[:len(x) - (width - m)], x[width - m:]) if width > m else x


def suffix_places(raw: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes chosen for the strings that start where ``valid`` says, and their seeds' hashes; fewer than 2**24 bytes."""
    with np.errstate(over="ignore"):
        h = _seed_hashes(raw)
    best = _window_minima((h & ~_PLACE) | np.arange(len(h), dtype=U64), length - SEED + 1)[valid[:len(raw) - length + 1]]
    place = (best & _PLACE).astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
    return place, h[place]


def _sampled(texts: DataFrame, length: int) -> DataFrame:
    """(kh, k1, k2, pos) of the chosen suffixes of ``texts`` (k1, k2, text as bytes, at least ``length`` of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def chosen(parts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
            stops = np.cumsum([len(p[3]) for p in parts])
            starts = stops - np.array([len(p[3]) for p in parts])
            valid = np.ones(len(raw), bool)
            for e in stops:
                valid[max(0, e - length + 1):e] = False
            place, kh = suffix_places(raw, valid, length)
            of = np.searchsorted(stops, place, side="right")
            one = lambda i: np.array([p[i] for p in parts], np.int64)
            return pa.RecordBatch.from_pydict({"kh": pa.array(kh.view(np.int64)), "k1": one(0)[of], "k2": one(1)[of], "pos": place - starts[of] + one(2)[of]})

        waiting, held = [], 0
        for batch in batches:
            for k1, k2, text in zip(*(c for c in (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data = text.as_buffer().to_pybytes()
                # Long texts in pieces that share all but one byte of a string.
                for at in range(0, len(data) - length + 1, CHUNK):
                    piece = data[at:at + CHUNK + length - 1]
                    waiting.append((k1, k2, at, piece))
                    held += len(piece)
                    if held >= CHUNK:
                        yield chosen(waiting)
                        waiting, held = [], 0
        if waiting:
            yield chosen(waiting)

    return texts.mapInArrow(run, "kh long, k1 long, k2 long, pos long")


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, alone, pos, ahead, back, lead): bytes from each candidate place on, and those before it read backwards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("k1", "k2", "alone")]
            for i in range(len(batch)):
                data = batch.column("text")[i].as_buffer().to_pybytes()
                all_places = batch.column("places")[i].values.to_numpy()
                for at in range(0, len(all_places), 10_000):
                    places = all_places[at:at + 10_000]
                    ahead = [data[p:p + length] for p in places.tolist()]
                    n = len(places)
                    yield pa.RecordBatch.from_pydict({
                        "k1": pa.array(np.full(n, keys[0][i])), "k2": pa.array(np.full(n, keys[1][i])), "alone": pa.array([keys[2][i]] * n, pa.bool_()), "pos": pa.array(places),
                        "ahead": ahead, "back": [data[max(0, p - length + SEED):p][::-1] for p in places.tolist()], "lead": [a[:LEADING] for a in ahead]})

    return texts.mapInArrow(run, "k1 long, k2 long, alone boolean, pos long, ahead binary, back binary, lead binary")


def _matrix(cells: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each cell in a row of ``width``, filled with zeros; their number."""
    cells = cells.combine_chunks()
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]
    raw = np.frombuffer(cells.buffers()[2], np.uint8) if cells.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(cells), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = raw[offsets[0]:offsets[-1]]
    return out, sizes


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as 8-byte words that compare as the bytes do."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    return padded.view(">u8").astype(U64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of an (n, d) array, by multikey quicksort with whole words as characters.

    Every open segment is cut by its own pivot (median of three) into the rows below, equal and above
    in the word looked at; the equal ones go on with the next word.  All open segments are cut in the same pass.
    """
    n, d = words.shape
    order = np.arange(n)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        open_ = (size > 1) & (depth < d)
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order
        seg = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(seg)) + np.repeat(start - (np.cumsum(size) - size), size)
        rows = order[place]
        w = words[rows, depth[seg]]
        base = np.cumsum(size) - size
        a, b, c = w[base], w[base + size // 2], w[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        side = seg * 3 + (w >= pivot) + (w > pivot)
        order[place] = rows[np.argsort(side, kind="stable")]
        sizes = np.bincount(side, minlength=3 * len(start)).reshape(-1, 3)
        before = np.cumsum(sizes, axis=1) - sizes
        start, size = (start[:, None] + before).ravel(), sizes.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row and the one before it in ``order`` (first: 0)."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 20_000):
        stop = min(at + 20_000, len(order))
        differs = rows[order[at:stop]] != rows[order[at - 1:stop - 1]]
        out[at:stop] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def _string_hashes(back: np.ndarray, ahead: np.ndarray, length: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(t, two hashes of the string that begins t bytes before each place, and of t) for every t.

    A string lies around several places of its text, but equal strings share the place that they chose, at the same t.
    """
    before, both = back.shape[1], np.concatenate([back[:, ::-1], ahead], axis=1)
    with np.errstate(over="ignore"):
        tables = []
        for base in BASES:
            p = np.zeros((both.shape[1] + 1, len(both)), U64)
            for i in range(both.shape[1]):
                p[i + 1] = p[i] * base + both[:, i].astype(U64) + U64(1)
            tables.append((p, U64(pow(int(base), length, 1 << 64))))
        for t in range(before + 1):
            yield t, [mix(p[before - t + length] - p[before - t] * power + U64(t)) for p, power in tables]


FOUND = "k1 long, k2 long, a long, b long, w1 long, w2 long, n int"


def repeated_in_bucket(table: pa.Table, length: int, alone_in_table: bool) -> Iterator[pa.RecordBatch]:
    """Spans (k1, k2, a, b) of strings of the bucket that occur in it twice; rows with w1, w2 are strings to be compared across boundaries."""
    n, reach = len(table), length - SEED
    k1, k2, pos = (table.column(c).to_numpy() for c in ("k1", "k2", "pos"))
    report = table.column("alone").to_numpy()
    ahead, n_ahead = _matrix(table.column("ahead"), length)
    back, n_back = _matrix(table.column("back"), reach)
    order = multikey_quicksort(_words(ahead))
    common = _common(ahead, order)
    group = np.zeros(n, np.int64)
    group[order] = np.cumsum(common < SEED)
    order_back = multikey_quicksort(np.concatenate([group[:, None].astype(U64), _words(back)], axis=1))
    common_back = np.where(np.concatenate(([False], group[order_back[1:]] == group[order_back[:-1]])), _common(back, order_back), -1)

    def furthest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[order] = np.maximum(common, np.append(common[1:], 0))
        return out

    # A string beginning t bytes before its place needs t equal bytes on the one side and length - t on the other.
    most = np.minimum(np.minimum(furthest(order_back, common_back), n_back), reach)
    least = np.maximum(length - np.minimum(furthest(order, common), n_ahead), 0)
    edge = np.zeros(n, np.int64)
    if not alone_in_table:
        # Bytes that a suffix shares with the first or the last leading bytes of the bucket.
        lead = ahead[:, :LEADING]
        for other in (order[0], order[-1]):
            differs = lead != lead[other]
            edge = np.maximum(edge, np.where(differs.any(axis=1), differs.argmax(axis=1), LEADING))
    crossing = np.flatnonzero(edge >= SEED)
    hashes = _string_hashes(back[crossing], ahead[crossing], length) if len(crossing) else None
    repeated = np.zeros((reach + 2, n), np.int8)
    for t in range(reach + 1):
        fits = (n_ahead >= length - t) & (n_back >= t)
        active = np.flatnonzero((least <= t) & (t <= most) & fits)
        if hashes is not None:
            _, (w1, w2) = next(hashes)
            can = np.flatnonzero(fits[crossing] & (np.minimum(length - t, LEADING) <= edge[crossing]))
        else:
            can = np.zeros(0, np.int64)
        twice = np.zeros(n, bool)
        if len(active):
            right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
            right[order], left[order_back] = np.cumsum(common < length - t), np.cumsum(common_back < t)
            key = right[active] * (n + 1) + left[active]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            twice[active[by[1:][same]]] = True
            twice[active[by[:-1][same]]] = True
            repeated[t] = twice & report
        if len(can):
            mine = crossing[can]
            pair = np.stack([w1[can], w2[can]])
            # Equal strings of the bucket cross as one row that counts as two.
            several = np.flatnonzero(twice[mine])
            if len(several):
                _, first = np.unique(pair[:, several], axis=1, return_index=True)
                several = several[first]
            single = np.flatnonzero(~twice[mine])
            pick = np.concatenate([several, single])
            item = mine[pick]
            yield pa.RecordBatch.from_pydict({
                "k1": k1[item], "k2": k2[item], "a": pos[item] - t, "b": pos[item] - t + length,
                "w1": pair[0][pick].view(np.int64), "w2": pair[1][pick].view(np.int64), "n": np.repeat(np.array([2, 1], np.int32), [len(several), len(single)])})
    # Runs of t: strings that begin at neighbouring bytes are one span.
    for at in range(0, n, 5000):
        part = np.diff(np.pad(repeated[:, at:at + 5000], ((1, 0), (0, 0))), axis=0)
        item, t_first = np.nonzero((part == 1).T)
        _, t_stop = np.nonzero((part == -1).T)
        if len(item):
            item = item + at
            nothing = pa.nulls(len(item), pa.int64())
            yield pa.RecordBatch.from_pydict({"k1": k1[item], "k2": k2[item], "a": pos[item] - t_stop + 1, "b": pos[item] - t_first + length, "w1": nothing, "w2": nothing, "n": pa.nulls(len(item), pa.int32())})


def _bucket_spans(contexts: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield from repeated_in_bucket(pa.Table.from_batches(held), length, buckets == 1)
        release_memory()

    dealt = contexts.repartitionByRange(buckets, "lead", F.xxhash64("k1", "k2", "pos")).drop("lead")
    return dealt.mapInArrow(run, FOUND)


def _cut(texts: DataFrame, keep_text: bool) -> DataFrame:
    """Merges the spans of each text and takes them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for i in range(len(batch)):
                data = batch.column("text")[i].as_buffer().to_pybytes()
                spans = batch.column("spans")[i].values
                a, b = spans.field("a").to_numpy(), spans.field("b").to_numpy()
                by = np.argsort(a, kind="stable")
                a, b = a[by], np.maximum.accumulate(b[by])
                first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                starts, stops = a[first], b[np.append(first[1:], len(a)) - 1]
                bounds = [0, *np.stack([starts, stops], axis=1).ravel().tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(bounds[::2], bounds[1::2]))
                out = {"k1": batch.column("k1").slice(i, 1), "k2": batch.column("k2").slice(i, 1), "n_removed": pa.array([len(data) - len(kept)], pa.int64()),
                       "spans": pa.array([[{"start": x, "stop": y} for x, y in zip(starts.tolist(), stops.tolist())]], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                       "_sha": [hashlib.sha256(kept).hexdigest()]}
                yield pa.RecordBatch.from_pydict(out | ({"_kept": [kept]} if keep_text else {}))
            release_memory()

    return texts.mapInArrow(run, "k1 long, k2 long, n_removed long, spans array<struct<start:long,stop:long>>, _sha string" + (", _kept binary" if keep_text else ""))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket_suffixes: int = BUCKET_SUFFIXES, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) of every row; ``keep_text``: also kept, the bytes that stay.

    A byte goes if it lies in a string of ``length`` bytes (at least ``SEED`` + 1) that also begins anywhere else.
    spans: the maximal runs of such bytes, as (start, stop) in the text's bytes, stop exclusive.
    """
    ship_code()
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), data.alias("text")).select("_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    listed = materialise(rows.select("_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("_whole")), "repeat-rows")
    classes = listed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_rows"), F.max("n_bytes").alias("_size"))
    texts = rows.select("k1", "k2", "text").where(F.octet_length("text") >= length)

    places = materialise(_sampled(texts, length), "suffixes")
    at = F.xxhash64("k1", "k2", "pos")
    seeds = places.groupBy("kh").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo != _hi").select("kh", "_n")
    candidates = join_hot(places, materialise(seeds, "repeated-seeds"), ["kh"], "_n").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    whole = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count(F.lit(1)) == 1).alias("alone"))
    whole = materialise(whole.join(candidates, ["k1", "k2"]), "texts-with-candidates")

    n = whole.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    found = materialise(_bucket_spans(_contexts(whole, length), max(1, math.ceil(n / bucket_suffixes)), length), "bucket-spans")
    inside = found.where("w1 is null").select("k1", "k2", "a", "b")
    # A string meets here once per bucket at most.
    across = found.where("w1 is not null").withColumn("_n", F.sum("n").over(Window.partitionBy("w1", "w2"))).where("_n > 1 and n = 1").select("k1", "k2", "a", "b")
    spans = inside.unionByName(across).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = _cut(whole.where("alone").select("k1", "k2", "text").join(spans, ["k1", "k2"]), keep_text)

    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_size").alias("stop")))
    copies = (F.col("_rows") > 1) & (F.col("_size") >= length)
    known = materialise(classes.join(cut, ["k1", "k2"], "left").select(
        "k1", "k2", "_rows", F.when(copies, F.col("_size")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copies, gone).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>"))).alias("spans"),
        F.when(copies, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("_sha")).alias("_sha"),
        *([F.when(copies, F.lit("").cast("binary")).otherwise(F.col("_kept")).alias("_kept")] if keep_text else [])), "repeat-classes")
    out = join_hot(listed, known, ["k1", "k2"], "_rows")
    cols = [F.col("_id").alias(id_col), "n_bytes", "n_removed", "spans", F.coalesce("_sha", F.lower(F.hex("_whole"))).alias("kept_sha256")]
    if not keep_text:
        return out.select(*cols)
    # Texts that lose nothing are read from the input.
    untouched = rows.select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("_text"))
    return out.join(untouched, ["k1", "k2"]).select(*cols, F.coalesce("_kept", "_text").alias("kept"))
