"""Near-duplicates by DartMinHash signatures, banded joining and verified links.

Signature: for every element a Poisson process of darts falls on the quarter
plane weight x rank; which darts exist is decided by hashes of the element, the
weight cell and the rank cell alone, so equal elements of different texts see
the same darts.  A text keeps the darts below its elements' weights; each dart
belongs to one of t coordinates, and the earliest dart (least rank) per
coordinate is the signature.  Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.  The number of darts looked
at is about t * ln t per text however long it is.

Joining: equal texts are one node.  Nodes that share a band bucket are
candidates; each is compared with the node of its bucket that meets most others
and linked if their exact similarity reaches the threshold.  Where a bucket still holds several classes,
its nodes are measured against the centre of the largest one and linked to it
where near enough; pairs of different classes that by these measures could
still reach the threshold are compared too.  So the classes are those of all bucket pairs, while a bucket of
n alike texts costs about n comparisons instead of n * n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import forget_worker_caches, free_name, id_and_text, materialise
from corpusloom.session import ship_code

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
RANK_CELL = 0.5
SALTS = 16
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash of its lower-case form; filled on demand, bounded by its owner."""

    def __missing__(self, word: str) -> int:
        import hashlib

        value = self[word] = int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little")
        return value


def shingles(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of the whole text where it has fewer words, none without words)."""
    words = text.split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(hashes.__getitem__, words), U64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, U64)
    for k in range(min(size, len(h))):
        out = out * U64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(out)


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` items per row: (row of each item, number of the item in its row)."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


POISSON = np.cumsum([math.exp(-RANK_CELL) * RANK_CELL**k / math.factorial(k) for k in range(24)])


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) signatures of n weighted sets, given as rows (owner, element hash, weight > 0).

    A dart region is one unit of weight by ``RANK_CELL`` of rank of an element
    and holds Poisson(RANK_CELL) darts.  Sets with an empty coordinate look at
    twice the ranks again.  Rows of sets without elements are all ones.
    """
    out = np.full(n * t, np.iinfo(np.uint64).max, U64)
    total = np.bincount(owner, weight, n)
    todo = np.flatnonzero(total > 0)
    ranks = np.zeros(n)
    ranks[todo] = t * (math.log(t) + 3.0) / total[todo]
    while len(todo):
        live = np.zeros(n, bool)
        live[todo] = True
        pick = np.flatnonzero(live[owner])
        cells_w = np.ceil(weight[pick]).astype(np.int64)
        cells_r = np.ceil(ranks[owner[pick]] / RANK_CELL).astype(np.int64)
        row, number = _spread(cells_w * cells_r)
        r_of = number % cells_r[row]
        w_of = number // cells_r[row]
        src = pick[row]
        region = mix(element[src] + U64(0x9E3779B97F4A7C15) * (w_of.astype(U64) + U64(1)) ^ mix(r_of.astype(U64) + U64(0x632BE59BD9B4E019)))
        counts = np.searchsorted(POISSON, _uniform(region), side="right")
        hit = np.flatnonzero(counts)
        at, j = _spread(counts[hit])
        at = hit[at]
        dart = mix(region[at] + (j.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
        below = w_of[at] + _uniform(mix(dart ^ U64(0xA0761D6478BD642F))) < weight[src[at]]
        at, dart = at[below], dart[below]
        rank = (r_of[at] + _uniform(mix(dart ^ U64(0xE7037ED1A0B428DB)))) * RANK_CELL
        coordinate = mix(dart ^ U64(0x8EBC6AF09C88C6E3)) % U64(t)
        # Least rank first; the low bits tell darts of equal rank apart.
        value = np.minimum(rank * 2.0**20, 2.0**40 - 1).astype(U64) << U64(24) | dart & U64(0xFFFFFF)
        np.minimum.at(out, owner[src[at]] * t + coordinate.astype(np.int64), value)
        empty = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo[empty[todo]]
        ranks[todo] *= 2
    return out.reshape(n, t)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), U64)
    parts = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def sign(rows: DataFrame, counted: bool, bands: int, band_rows: int, group_chars: int = 2_000_000, cache_words: int = 500_000) -> DataFrame:
    """(_id, h, n, bands): text hash, weight of the shingle set and band hashes (none for a text without words)."""
    id_type = dict(rows.dtypes)["_id"]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        forget_worker_caches()
        hashes = WordHashes()

        def group(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
            if len(hashes) > cache_words:
                hashes.clear()
            owner, element, weight = [], [], []
            for k, text in enumerate(texts):
                e, c = np.unique(shingles(text, hashes), return_counts=True)
                owner.append(np.full(len(e), k)), element.append(e), weight.append(c.astype(np.float64) if counted else np.ones(len(e)))
            owner, element, weight = np.concatenate(owner), np.concatenate(element), np.concatenate(weight)
            n = np.bincount(owner, weight, len(texts))
            hashed = band_hashes(signatures(owner, element, weight, len(texts), bands * band_rows), bands, band_rows).view(np.int64)
            return pa.RecordBatch.from_arrays([
                ids, pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts], pa.binary()), pa.array(n, pa.float64()),
                pa.array([row if m else [] for row, m in zip(hashed, n, strict=True)], pa.list_(pa.int64())),
            ], ["_id", "h", "n", "bands"])

        for batch in batches:
            texts, at, size = [], 0, 0
            for k, text in enumerate(batch.column("_text")):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= group_chars:
                    yield group(texts, batch.column("_id").slice(at, len(texts)))
                    texts, at, size = [], k + 1, 0
            if texts:
                yield group(texts, batch.column("_id").slice(at, len(texts)))

    return rows.mapInArrow(run, f"_id {id_type}, h binary, n double, bands array<long>")


def _texts_once(rows: DataFrame) -> DataFrame:
    """(h, body): compressed texts, equal ones once per task."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        import zstandard

        forget_worker_caches()
        press = zstandard.ZstdCompressor(level=1).compress
        seen: set[bytes] = set()
        for batch in batches:
            h, body = [], []
            for text in batch.column("_text"):
                data = text.as_py().encode()
                key = hashlib.md5(data, usedforsecurity=False).digest()
                if key not in seen:
                    seen.add(key)
                    h.append(key), body.append(press(data))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(body, pa.binary())], ["h", "body"])

    return rows.select("_text").mapInArrow(run, "h binary, body binary")


def _salted(rows: DataFrame, keys: list[str], salt_by: str, whole: F.Column, part: F.Column, more_than: int = 0) -> DataFrame:
    """Adds an aggregate over ``keys`` to each row; a key with very many rows is spread over ``SALTS`` groups.

    ``part`` aggregates rows within a group (as ``_m``), ``whole`` those ``_m``
    over the groups of a key.  ``more_than``: only rows of keys with more rows than that.
    """
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_s").agg(part.alias("_m"), F.count(F.lit(1)).alias("_c"))
    out = parts.groupBy(*keys).agg(whole, F.sum("_c").alias("_n"), F.collect_set("_s").alias("_all"))  # at most SALTS entries
    out = out.where(F.col("_n") > more_than).drop("_n").withColumn("_s", F.explode("_all")).drop("_all")
    return salted.join(out, [*keys, "_s"]).drop("_s")


def _salted_min(rows: DataFrame, keys: list[str], value: str, out: str, salt_by: str, more_than: int = 0) -> DataFrame:
    return _salted(rows, keys, salt_by, F.min("_m").alias(out), F.min(value), more_than)


def _met(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (a, s, role, h, body): the texts of the pairs (a, b), ready to be streamed per group (a, s).

    A node's text goes to the groups that need it: once as the first text of a
    group (role 0), and once per pair as the second.  A group is streamed with
    one first text in memory, so hubs with many partners stay cheap.
    """
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    routes = pairs.select("a", "s").distinct().select(F.col("a").alias("h"), "a", "s", F.lit(0).alias("role")).unionByName(
        pairs.select(F.col("b").alias("h"), "a", "s", F.lit(1).alias("role")))
    return routes.join(bodies, "h").repartition("a", "s").sortWithinPartitions("a", "s", "role").select("a", "role", "h", "body")


def _streamed(batches: Iterator) -> Iterator:
    """(a, b, shingles of a, shingles of b) of every pair of ``_met``, batch by batch as lists."""
    import zstandard

    forget_worker_caches()
    unpress = zstandard.ZstdDecompressor().decompress
    hashes = WordHashes()
    first, first_key = None, None
    for batch in batches:
        found = []
        for a, role, h, body in zip(*[batch.column(c) for c in ("a", "role", "h", "body")], strict=True):
            a, h = a.as_py(), h.as_py()
            if len(hashes) > 500_000:
                hashes.clear()
            own = np.unique(shingles(unpress(body.as_py()).decode(), hashes), return_counts=True)
            if role.as_py() == 0:
                first, first_key = own, a
                continue
            if first_key != a:
                raise RuntimeError("a pair met no first text")
            found.append((a, h, first, own))
        yield found


def _verify(pairs: DataFrame, bodies: DataFrame, threshold: float, counted: bool) -> DataFrame:
    """Pairs (a, b) whose exact similarity reaches the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for found in _streamed(batches):
            links = [(a, b) for a, b, x, y in found if similarity(x, y, counted) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _met(pairs, bodies).mapInArrow(run, "a binary, b binary")


def _against_centre(pairs: DataFrame, bodies: DataFrame, counted: bool) -> DataFrame:
    """(c, h, common, extra, weight): weight that h shares with its centre c, and what h has beyond c."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for found in _streamed(batches):
            common, extra, weight = [], [], []
            for _, _, x, y in found:
                wx, wy = (x[1].astype(float), y[1].astype(float)) if counted else (np.ones(len(x[0])), np.ones(len(y[0])))
                beyond = wy.copy()
                _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
                beyond[j] -= np.minimum(wx[i], wy[j])
                common.append(float(wy.sum() - beyond.sum()))
                extra.append(y[0][beyond > 0].view(np.int64)), weight.append(beyond[beyond > 0])
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array(common, pa.float64()),
                pa.array(extra, pa.list_(pa.int64())), pa.array(weight, pa.list_(pa.float64())),
            ], ["c", "h", "common", "extra", "weight"])

    return _met(pairs, bodies).mapInArrow(run, "c binary, h binary, common double, extra array<long>, weight array<double>")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], counted: bool) -> float:
    """(Weighted) Jaccard similarity of two sorted shingle sets with counts; two empty sets are equal."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if counted:
        shared, total = float(np.minimum(x[1][i], y[1][j]).sum()), float(x[1].sum() + y[1].sum())
    else:
        shared, total = float(len(i)), float(len(x[0]) + len(y[0]))
    return shared / (total - shared) if total > shared else 1.0


def components(links: DataFrame) -> DataFrame:
    """(h, root): least node of each connected component of the links (a, b); alternating large and small stars."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = _salted_min(both, ["u"], "v", "m", "v").withColumn("m", F.least("m", "u"))
        large = seen.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = _salted_min(large, ["u"], "v", "m", "v")
        edges = materialise(
            down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "star-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("h"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("h"), F.col("v").alias("root")).distinct())
        mark = now


def _mixed(buckets: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Bucket rows (band, bh, h, n, root, main) of buckets with several classes; main = (size, root, centre, n_centre) of the largest."""
    of_class = members.join(roots, "h", "left").select("h", "n", "rank", F.coalesce("root", "h").alias("root"))
    whole = of_class.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rank", "h", "n")).alias("first")).select(
        "root", "size", F.col("first.h").alias("centre"), F.col("first.n").alias("n_centre"))
    placed = buckets.join(roots, "h", "left").select("band", "bh", "h", "n", F.coalesce("root", "h").alias("root"))
    sizes = placed.groupBy("band", "bh", "root").agg(F.count(F.lit(1)).alias("c")).join(whole, "root")
    mixed = sizes.groupBy("band", "bh").agg(F.max(F.struct("size", "root", "centre", "n_centre")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    return materialise(placed.join(mixed, ["band", "bh"]), "dart-mixed")


def _classes(rows: DataFrame, threshold: float, counted: bool, bands: int, band_rows: int) -> tuple[DataFrame, DataFrame]:
    """(signed rows (_id, h), nodes (h, root, n_links)) of rows (_id, _text)."""
    signed = materialise(sign(rows, counted, bands, band_rows), "dart-signatures")
    nodes = signed.groupBy("h").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    cells = nodes.select("h", "n", F.posexplode("bands").alias("band", "bh"))
    shared = materialise(_salted(cells, ["band", "bh"], "h", F.sum("_m").alias("size"), F.count(F.lit(1)), more_than=1), "dart-cells")
    # The node that meets most others over all bands leads its buckets: among copies edited here and there, that is
    # the one nearest to all of them.
    rank = shared.groupBy("h").agg((-F.sum("size")).alias("rank"))
    ranked = shared.drop("size").join(rank, "h").withColumn("x", F.struct("rank", "h", "n"))
    buckets = materialise(_salted_min(ranked, ["band", "bh"], "x", "rep", "h").select("band", "bh", "h", "n", "rank", "rep"), "dart-buckets")
    close = lambda n, m: F.least(n, m) >= threshold * F.greatest(n, m)  # noqa: E731  sizes bound the similarity
    tried = materialise(
        buckets.where((F.col("h") != F.col("rep.h")) & close(F.col("n"), F.col("rep.n"))).select(F.col("rep.h").alias("a"), F.col("h").alias("b")).distinct(), "dart-pairs")
    members = materialise(buckets.select("h", "n", "rank").distinct(), "dart-members")
    bodies = materialise(_texts_once(rows).join(members.select("h"), "h", "left_semi").dropDuplicates(["h"]), "dart-texts")
    links = materialise(_verify(tried, bodies, threshold, counted), "dart-links")
    roots = materialise(_leaders(links, members), "dart-leaders")
    # Buckets that still hold several classes: their nodes are measured against the centre of the largest class they meet,
    # which links more of them.
    left = _mixed(buckets, members, roots)
    by_centre = materialise(
        left.groupBy("h").agg(F.max("main").alias("m"), F.first("n").alias("n")).select(
            F.col("m.centre").alias("c"), F.col("m.n_centre").alias("n_c"), F.col("m.root").alias("of"), "h", "n"), "dart-centres")
    measured = materialise(_against_centre(by_centre.select(F.col("c").alias("a"), F.col("h").alias("b")), bodies, counted), "dart-measured")
    known = measured.select("c", "h", "common").join(by_centre, ["c", "h"])
    is_near = F.col("common") >= threshold * (F.col("n") + F.col("n_c") - F.col("common")) - 1e-9
    known = materialise(known.withColumn("near", is_near).drop("n_c"), "dart-known")
    near = known.where("near AND c != h").select(F.col("c").alias("a"), F.col("h").alias("b"))
    links = materialise(links.unionByName(near).distinct(), "dart-links")
    left = left.join(known.where("near").select("h", "of"), "h", "left").withColumn("root", F.coalesce("of", "root")).drop("of")
    # What a node has beyond its centre counts where another node measured there has it as well.  Two nodes share no more
    # than the lesser of what each shares with the centre, and the lesser of what each has beyond.
    beyond = measured.select("c", "h", F.explode(F.arrays_zip("extra", "weight")).alias("x")).select("c", "h", F.col("x.extra").alias("e"), F.col("x.weight").alias("w"))
    more_than_one = _salted_min(beyond, ["c", "e"], "h", "_first", "h", more_than=1).groupBy("c", "h").agg(F.sum("w").alias("beyond"))
    bound = known.drop("of", "near").join(more_than_one, ["c", "h"], "left").withColumn("beyond", F.coalesce("beyond", F.lit(0.0)))
    bound = bound.join(bound.groupBy("c").agg(F.min("n").alias("least")), "c")
    share = threshold / (1 + threshold)  # common weight that a pair needs, of the sum of both
    fits = F.col("common") + F.col("beyond") >= share * (F.col("n") + F.greatest("least", F.col("n") * threshold)) - 1e-9
    # Nodes in buckets with nodes of another centre cannot be judged by theirs alone.
    foreign = left.select("band", "bh", "h").join(by_centre.select("h", "c"), "h").groupBy("band", "bh").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    free = left.join(foreign.select("band", "bh"), ["band", "bh"], "left_semi").select("h").distinct()
    alive = bound.where(fits).select("h").unionByName(free).distinct().join(bound, "h")
    left = left.drop("n").withColumn("main", F.col("main.root")).join(alive.select("h", "c", "common", "beyond", "n"), "h")
    # Every node carries its buckets (one per band at most): a pair is taken in the first bucket that both share.
    left = materialise(left.join(left.groupBy("h").agg(F.collect_set(F.struct("band", "bh")).alias("seen")), "h"), "dart-alive")
    one = lambda side: [F.col(k).alias(f"{k}_{side}") for k in ("h", "n", "root", "c", "common", "beyond", "seen")]
    x = left.where("root != main").select("band", "bh", *one("x"))
    y = left.select("band", "bh", *one("y"), (F.col("root") != F.col("main")).alias("other"))
    lesser = F.least("common_x", "common_y") + F.least("beyond_x", "beyond_y")
    possible = (F.col("c_x") != F.col("c_y")) | (lesser >= share * (F.col("n_x") + F.col("n_y")) - 1e-9)
    meet = x.join(y, (x["band"] == y["band"]) & (x["bh"] == y["bh"]) & (F.col("root_x") != F.col("root_y")) & (~F.col("other") | (F.col("h_x") < F.col("h_y")))
                  & close(F.col("n_x"), F.col("n_y")) & possible & (F.array_min(F.array_intersect("seen_x", "seen_y"))["band"] == x["band"]))
    rest = meet.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()
    done = tried.unionByName(by_centre.select(F.col("c").alias("a"), F.col("h").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(_verify(materialise(rest.join(done, ["a", "b"], "left_anti"), "dart-pairs"), bodies, threshold, counted), "dart-links")
    every = links.unionByName(more)
    roots = _contracted(every, roots)
    degree = every.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    nodes = signed.select("h").distinct().join(roots, "h", "left").join(degree, "h", "left")
    return signed.select("_id", "h"), nodes.select("h", F.coalesce("root", "h").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _leaders(links: DataFrame, members: DataFrame) -> DataFrame:
    """(h, root) of linked nodes: where the way from each node to its best-ranked partner ends after up to eight steps.

    Nodes with one root are connected; connected nodes mostly have one root.
    """
    up = links.join(members.select(F.col("h").alias("a"), "rank"), "a").groupBy("b").agg(F.min(F.struct("rank", "a")).alias("m")).select(F.col("b").alias("h"), F.col("m.a").alias("root"))
    for _ in range(3):
        further = up.select(F.col("h").alias("root"), F.col("root").alias("next"))
        up = up.join(further, "root", "left").select("h", F.coalesce("next", "root").alias("root"))
    return up


def _contracted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, root) of all linked nodes: components of the links, found over the roots that are known already."""
    of = lambda side: roots.select(F.col("h").alias(side), F.col("root").alias(f"r_{side}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    rest = materialise(pairs.where("a != b").distinct(), "star-rest")
    known = roots.unionByName(links.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(roots, "h", "left_anti").select("h", F.col("h").alias("root")))
    if not rest.take(1):
        return known
    merged = components(rest).select(F.col("h").alias("root"), F.col("root").alias("top"))
    return known.join(merged, "root", "left").select("h", F.coalesce("top", "root").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counted: bool = False,
    bands: int = BANDS, band_rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, ``class_id`` (least id of its class), ``class_rows``, ``n_links``.

    Texts belong to one class when a chain of links joins them: equal texts, or
    sets of five-word shingles (lower-case words) with a Jaccard similarity of
    at least ``threshold`` (``counted``: weighted by how often a shingle
    occurs).  ``n_links`` counts the links of a text to different texts that
    were needed to join the class.  Null and empty texts are equal texts and
    form one class; repeated rows share a class; texts of fewer than five words
    are one shingle; null ids are ignored in the least id.  A pair at the
    threshold 0.8 shares a bucket with probability 0.9996.  An empty table
    gives no rows.
    """
    ship_code()
    signed, nodes = _classes(id_and_text(docs, id_col, text_col), threshold, counted, bands, band_rows)
    # Copies meet in partial sums per text before they are counted per class.
    per_node = signed.groupBy("h").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("c")).join(nodes, "h")
    whole = per_node.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("c").alias("class_rows"))
    table = per_node.join(whole, "root").select("h", "class_id", "class_rows", "n_links")
    # A text with very many copies is spread over salts.
    wide = table.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in range(8)])))
    spread = signed.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(8)).cast("int"))
    return spread.join(wide, ["h", "_s"]).select(F.col("_id").alias(id_col), "class_id", "class_rows", "n_links")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counted: bool = False,
    bands: int = BANDS, band_rows: int = ROWS,
) -> DataFrame:
    """The input with one row of each class of ``near_duplicates``: that of its least id (a null id only without any other).

    Of rows equal in id and text one stays.
    """
    ship_code()
    signed, nodes = _classes(id_and_text(docs, id_col, text_col), threshold, counted, bands, band_rows)
    low = signed.groupBy("h").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id")).alias("low")).join(nodes, "h")
    key = free_name(docs, "_h")
    first = low.groupBy("root").agg(F.min(F.struct("low", "h")).alias("f")).select(F.col("f.low._id").alias("_id"), F.col("f.h").alias("_hash"))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    kept = keyed.alias("d").join(first.alias("f"), (F.col(f"d.{key}") == F.col("f._hash")) & F.col(f"d.{id_col}").eqNullSafe(F.col("f._id")), "left_semi")
    return kept.dropDuplicates([id_col, key]).select(*docs.columns)
