"""Tokenizer corpus and vocabulary statistics.

Corpus statistics are aggregations (partial aggregation before the shuffle);
only the small tables that follow them (distinct characters, word counts,
merge list) are ever ordered globally.  BPE merges are an iterative
algorithm: each pass counts adjacent pairs, and a bounded table of word pieces
gives all merges down to a count, with a reliable checkpoint every few passes.
"""

from __future__ import annotations

import heapq
from array import array

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import nonempty
from ..functions.text import WS_CLASS_JAVA
from ..session import cut_lineage, ship_code

# Split a string into code points: a boundary after every char that is not a
# high surrogate (Java regexes work on UTF-16 units).
CODE_POINT_SPLIT = r"(?<=[^\x{D800}-\x{DBFF}])"


def chars(c) -> Column:
    """Code points of a string as an array."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, CODE_POINT_SPLIT), lambda x: F.length(x) > 0)


def tokenizer_lines(df: DataFrame, text_col: str = "text", order_by: str = "id",
                    max_lines: int | None = None) -> DataFrame:
    """Non-empty texts, newline -> space; all of them, or the first ``max_lines`` in key order.

    The limit is the feature of writing a tokenizer corpus; the vocabulary
    statistics read every line.  Only keys are ranked for it.
    """
    lines = df.filter(nonempty(text_col)).select(order_by, F.translate(F.col(text_col), "\n", " ").alias("line"))
    from .split import limit_rows
    return limit_rows(lines, max_lines, order_by)


def word_frequency(lines: DataFrame, col: str = "line") -> DataFrame:
    """Whitespace-separated word counts of the corpus."""
    # one regex pass: split on runs of whitespace (same words as normalise-then-split)
    w = lines.select(F.explode(F.split(col, f"{WS_CLASS_JAVA}+")).alias("word")).filter(F.length("word") > 0)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def char_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    return lines.select(F.explode(chars(col)).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def char_coverage(lines: DataFrame, coverage: float = K.CHARACTER_COVERAGE, col: str = "line") -> DataFrame:
    """The smallest set of most frequent characters (ties: smaller char first) whose
    counts reach ``coverage`` of all characters.  Integer comparison, no float rounding."""
    cc = char_counts(lines, col)
    scale = 1_000_000
    num = int(round(coverage * scale))
    w = Window.orderBy(F.col("n").desc(), F.col("ch").asc())
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    cum_before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = cc.withColumn("total", total).withColumn("before", F.coalesce(cum_before, F.lit(0)))
    r = r.withColumn("rank", F.row_number().over(w).cast("long"))
    return r.filter(F.col("before") * scale < F.col("total") * num).select("ch", "n", "rank")


def _adjacent(sy: Column) -> Column:
    n = F.greatest(F.size(sy) - 1, F.lit(0))
    return F.arrays_zip(F.slice(sy, 1, n), F.slice(sy, 2, n))


def _rewrite(state: DataFrame, per_batch) -> DataFrame:
    """(sy, f): every word's symbols replaced by the symbol lists that ``per_batch`` gives; lists of one symbol are left out.

    ``per_batch`` gets the symbols of a batch of words as numbers, the number of the word of each, and the
    strings; it returns symbols, numbers of the new lists (ascending), the word of each list, and the strings.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column("sy")).to_numpy(zero_copy_only=False)
            coded = batch.column("sy").flatten().dictionary_encode()
            codes, of_list, of_word, names = per_batch(
                coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), coded.dictionary)
            length = np.bincount(of_list, minlength=len(of_word))
            used = length > 1
            offsets = np.concatenate(([0], np.cumsum(length[used])))
            sy = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(codes[used[of_list]])))
            yield pa.RecordBatch.from_arrays([sy, batch.column("f").take(pa.array(of_word[used]))], ["sy", "f"])

    ship_code()
    return state.mapInArrow(run, "sy array<string>, f long")


def _numbered(symbols: list[str], names):
    """For the strings ``names`` of a batch: their numbers where ``symbols`` come first, and all strings by number."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    known = pc.index_in(names, value_set=pa.array(symbols, pa.string())).to_numpy(zero_copy_only=False)
    number = np.where(np.isnan(known.astype(float)), len(symbols) + np.arange(len(names)), known).astype(np.int64)
    return number, pa.concat_arrays([pa.array(symbols, pa.string()), names])


def _pair_table(pairs: list[tuple[str, str]], more: list[str]):
    """(distinct symbols of the pairs and ``more``, sorted pair numbers, place in ``pairs`` of each); a pair is left << 31 | right."""
    import numpy as np

    place = {x: i for i, x in enumerate(dict.fromkeys([*(x for p in pairs for x in p), *more]))}
    keys = np.array([place[a] << 31 | place[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return place, keys[order], order


def _places(codes, of_word, keys, order, none: int):
    """Per symbol, the place of the pair that it makes with the next one of its word (``none``: no such pair)."""
    import numpy as np

    out = np.full(len(codes), none, np.int64)
    if len(codes) > 1 and len(keys):
        pair = codes[:-1] << 31 | codes[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = (keys[at] == pair) & (of_word[:-1] == of_word[1:])
        out[:-1][hit] = order[at[hit]]
    return out


def _cut_at_closed(opened: list[tuple[str, str]]):
    """Words as their runs of adjacent pairs in ``opened``."""
    place, keys, order = _pair_table(opened, [])
    symbols = list(place)

    def cut(codes, of_word, names):
        import numpy as np

        number, names = _numbered(symbols, names)
        codes = number[codes]
        ends = _places(codes, of_word, keys, order, len(keys)) == len(keys)
        of_list = np.cumsum(ends) - ends
        return codes, of_list, of_word[ends], names

    return cut


def _merge_in_order(merges: list[tuple[str, str]]):
    """Words after ``merges``, the first ones first, each from left to right."""
    place, keys, order = _pair_table(merges, [a + b for a, b in merges])
    symbols = list(place)
    made = [place[a + b] for a, b in merges]

    def merge(codes, of_word, names):
        import numpy as np

        words = int(of_word[-1]) + 1 if len(of_word) else 0
        number, names = _numbered(symbols, names)
        codes, result, none = number[codes], np.array(made, np.int64), len(merges)
        done: list[tuple] = []
        word = of_word
        while len(codes):
            rank = _places(codes, word, keys, order, none)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(word)))
            over = best == none
            done.append((codes[over], word[over]))
            codes, word, rank, best = codes[~over], word[~over], rank[~over], best[~over]
            if not len(codes):
                break
            # Of a run of one symbol every other place is merged, from the left.
            hit = rank == best
            at = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), at, 0))
            hit &= (at - run_start) % 2 == 0
            codes = np.where(hit, result[np.minimum(rank, none - 1)], codes)
            gone = np.concatenate(([False], hit[:-1]))
            codes, word = codes[~gone], word[~gone]
        if not done:
            return codes, of_word, np.arange(words), names
        codes, of_word = (np.concatenate(x) for x in zip(*done, strict=True))
        back = np.argsort(of_word, kind="stable")
        return codes[back], of_word[back], np.arange(words), names

    return merge


def _learn(rows: list[tuple[list[str], int]], least: int, k: int) -> list[tuple[str, str, int]]:
    """At most ``k`` merges of count ``least`` or more over weighted symbol lists, one after the other; counts kept by position."""
    sym: list[str | None] = []
    freq, before, after = array("q"), array("q"), array("q")
    count: dict[tuple[str, str], int] = {}
    places: dict[tuple[str, str], list[int]] = {}

    def add(i: int) -> None:
        pair = (sym[i], sym[after[i]])
        count[pair] = count.get(pair, 0) + freq[i]
        places.setdefault(pair, []).append(i)
        touched.add(pair)

    def drop(i: int) -> None:
        pair = (sym[i], sym[after[i]])
        count[pair] -= freq[i]
        touched.add(pair)

    touched: set[tuple[str, str]] = set()
    for word, f in rows:
        first = len(sym)
        sym.extend(word)
        freq.extend([f] * len(word))
        before.extend([-1, *range(first, len(sym) - 1)])
        after.extend([*range(first + 1, len(sym)), -1])
    for i in range(len(sym)):
        if after[i] >= 0:
            add(i)
    heap = [(-c, p) for p, c in count.items() if c >= least]
    heapq.heapify(heap)
    merges: list[tuple[str, str, int]] = []
    while heap and len(merges) < k:
        c, pair = heapq.heappop(heap)
        if count.get(pair) != -c:
            continue  # out of date: its present count has an entry of its own
        a, b = pair
        merges.append((a, b, -c))
        touched.clear()
        for i in sorted(places.pop(pair)):
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            if before[i] >= 0:
                drop(before[i])
            drop(i)
            if after[j] >= 0:
                drop(j)
            sym[i], sym[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                add(i)
            if before[i] >= 0:
                add(before[i])
        for p in touched:
            if count[p] >= least:
                heapq.heappush(heap, (-count[p], p))
            elif not count[p]:
                del count[p]
                places.pop(p, None)
    return merges


def bpe_merges(words: DataFrame, k: int = K.VOCAB_SIZE, word_col: str = "word", freq_col: str = "n",
               checkpoint_every: int = 5, top_pairs: int = 20_000, max_symbols: int = 1_000_000) -> DataFrame:
    """Up to k rounds of byte-pair merging on a word-frequency table; fewer only when no pair is left.

    Each round takes the most frequent adjacent pair of symbols weighted by word
    frequency (ties: smallest pair), and merges it left to right in every word.
    Returns (rank, left, right, count).

    Many rounds share one pass.  A merge never gives a boundary between symbols
    a higher pair count than it had, so while pairs of count t or more are left,
    no pair of a lower count is merged: words fall apart at those boundaries,
    and the distinct pieces hold all that the rounds down to count t depend on.
    A pass counts all pairs, takes t from the ``top_pairs`` most frequent ones,
    learns those rounds on the driver from at most ``max_symbols`` symbols of
    distinct pieces, and applies them to the words.  With more pieces t is
    raised, and the pieces fall apart further (a pair closed at t is closed at
    every higher t, so the words need not be cut again); where ties leave no
    such t, the pass makes one round.

    The words after a pass and the pieces are kept while they are read, so each
    is made once; every ``checkpoint_every`` passes cut the lineage.
    """
    spark = words.sparkSession
    state = words.groupBy(F.col(word_col).alias("w")).agg(F.sum(freq_col).cast("long").alias("f"))
    state = cut_lineage(state.select(chars("w").alias("sy"), "f").filter(F.size("sy") > 1))
    merges: list[tuple[str, str, int]] = []
    passes, kept = 0, None
    while len(merges) < k:
        pairs = state.select(F.explode(_adjacent(F.col("sy"))).alias("p"), "f")
        cnt = pairs.groupBy(F.col("p")["0"].alias("a"), F.col("p")["1"].alias("b")).agg(F.sum("f").alias("c"))
        top = cnt.orderBy(F.col("c").desc(), F.col("a"), F.col("b")).limit(top_pairs + 1).collect()
        if not top:
            break
        learned, whole = [(top[0]["a"], top[0]["b"], int(top[0]["c"]))], False
        size, uncut, held = top_pairs, state, []
        while size:
            whole = len(top) <= size
            opened = top if whole else [r for r in top[:size] if r["c"] > top[size]["c"]]
            if opened:
                cut = _cut_at_closed([(r["a"], r["b"]) for r in opened])
                pieces = uncut = _rewrite(uncut, cut).groupBy("sy").agg(F.sum("f").cast("long").alias("f")).persist()
                held.append(pieces)
                if (pieces.agg(F.sum(F.size("sy"))).first()[0] or 0) <= max_symbols:
                    rows = [(r["sy"], r["f"]) for r in pieces.collect()]
                    learned = _learn(rows, 1 if whole else int(opened[-1]["c"]), k - len(merges))
                    break
            size, whole = size // 4, False
        for pieces in held:
            pieces.unpersist()
        merges += learned
        if whole or len(merges) >= k:
            break
        merged = _rewrite(state, _merge_in_order([(a, b) for a, b, _ in learned]))
        passes += 1
        if passes % checkpoint_every == 0:
            merged = cut_lineage(merged)
        else:
            merged = merged.persist()
            merged.count()
        if kept is not None:
            kept.unpersist()
        state, kept = merged, None if passes % checkpoint_every == 0 else merged
    if kept is not None:
        kept.unpersist()
    return spark.createDataFrame([(r, *m) for r, m in enumerate(merges, 1)], "rank long, left string, right string, count long")


def vocab_table(coverage_chars: DataFrame, merges: DataFrame, size: int = K.VOCAB_SIZE) -> DataFrame:
    """Ids: specials 0..3, then covered characters by rank, then merges in order as far as ``size`` ids go."""
    spark = coverage_chars.sparkSession
    specials = spark.createDataFrame([(i, t, "special") for i, t in enumerate(K.SPECIAL_TOKENS)],
                                     "id long, piece string, kind string")
    nspec = len(K.SPECIAL_TOKENS)
    ch = coverage_chars.select((F.col("rank") + nspec - 1).cast("long").alias("id"), F.col("ch").alias("piece"),
                               F.lit("char").alias("kind"))
    nch = coverage_chars.count()
    mg = merges.filter(F.col("rank") <= size - nspec - nch).select((F.col("rank") + nspec + nch - 1).cast("long").alias("id"),
                       F.concat("left", "right").alias("piece"), F.lit("merge").alias("kind"))
    return specials.unionByName(ch).unionByName(mg)
