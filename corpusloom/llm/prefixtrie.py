"""Prefix trie of conversations with subtree totals by centroid decomposition.

Turns are ordered by a range sort whose partitions are numbered, so positions
and prefix hashes are running values of a partition plus what the partitions
before it hold of the same conversation: a conversation of any length is spread
over tasks.  A node is a distinct sequence of turns, found by grouping 128-bit
prefix hashes (partial aggregates: a beginning that a third of all conversations
share costs one row a task).

Subtree totals come from the centroid decomposition of the parent-edge forest.
A component's centroid is its deepest node that has at least half of the
component's weight below it.  Its total within the component is its value for
good, and is added to all nodes on the path from it up to the component's top;
without the centroid the component falls into the subtrees of its children and
the rest above, each of at most half the weight, which are split in the same way.
Components of more than ``task_turns`` turns are split by joins of whole tables, one round per
level (weight: turns below a node, known from the grouping), all others inside one task
each (weight: nodes).  So the number of rounds is the logarithm of the input over
``task_turns``, however deep the trie is, and no task holds more than ``task_turns`` nodes of a component.

Rules: rows without a conversation id belong to no conversation; a null role or text is
empty; turns come null first, equal turns by role and text; repeated rows are turns
of their own; other columns are left behind; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import join_hot, materialise
from corpusloom.session import broadcast_if_small, ship_code

TASK_TURNS = 200_000
NODE = ["q", "h1", "h2"]
HEAD_GROUP, HEAD_TURNS = 20, 4


# --- positions and prefix hashes over range-sorted partitions

def _runs(conv: np.ndarray, carry: int | None) -> tuple[np.ndarray, bool]:
    """First row of each run of equal conversations; whether the first run goes on from ``carry``."""
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    return first, carry is not None and len(conv) > 0 and int(conv[0]) == carry


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows sorted within range partitions -> (pid, conv_id, p, h1, h2, w), p counting a partition's rows of a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, carry, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first, goes_on = _runs(conv, carry)
            lengths = np.diff(np.append(first, len(conv)))
            p = np.arange(1, len(conv) + 1) - np.repeat(first, lengths)
            if goes_on:
                p[:lengths[0]] += before
            carry, before = int(conv[-1]), int(p[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), batch.column(0), pa.array(p, pa.int64()), *batch.columns[1:]],
                                             names=["pid", "conv_id", "p", "h1", "h2", "w"])

    return rows.mapInArrow(run, "pid int, conv_id long, p long, h1 long, h2 long, w long")


def _hashed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, q, g1, g2, w, len) sorted within range partitions -> with the running exclusive-or of g1 and g2 in the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, carry, left = TaskContext.get().partitionId(), None, (np.int64(0), np.int64(0))
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first, goes_on = _runs(conv, carry)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
            out = []
            for k, name in enumerate(("g1", "g2")):
                g = batch.column(name).to_numpy()
                total = np.bitwise_xor.accumulate(g)
                # What the rows before a run have added is taken off again.
                start = np.where(first > 0, total[first - 1], 0)
                if goes_on:
                    start[0] ^= left[k]
                out.append(total ^ start[of])
            carry, left = int(conv[-1]), (out[0][-1], out[1][-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), *batch.columns, pa.array(out[0]), pa.array(out[1])],
                                             names=["pid", *batch.schema.names, "l1", "l2"])

    return rows.mapInArrow(run, "pid int, conv_id long, q long, g1 long, g2 long, w long, len long, l1 long, l2 long")


def conversation_rows(df: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, w, len) of every turn: its place from 1, hashes of role and text, words of the text, turns of the conversation."""
    ship_code()
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"))
    # Equal turns may be many: the beginning of their texts takes part in the split, the whole text in the order.
    dealt = rows.repartitionByRange("conv_id", F.col("_turn").asc_nulls_first(), "_role", F.substring("_text", 1, 64))
    dealt = dealt.sortWithinPartitions("conv_id", F.col("_turn").asc_nulls_first(), "_role", "_text").select(
        "conv_id", F.xxhash64("_role", "_text").alias("h1"), F.xxhash64(F.lit(1), "_text", "_role").alias("h2"),
        F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    turns = materialise(_numbered(dealt), "turns")
    runs = turns.groupBy("conv_id", "pid").agg(F.max("p").alias("_n"))
    parts = Window.partitionBy("conv_id")
    runs = runs.select("conv_id", "pid", (F.sum("_n").over(parts.orderBy("pid")) - F.col("_n")).alias("_off"), F.sum("_n").over(parts).alias("len"))
    return turns.join(runs, ["conv_id", "pid"]).select("conv_id", (F.col("p") + F.col("_off")).alias("pos"), "h1", "h2", "w", "len", "pid")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, q, h1, h2, w, len) of the rebuilt conversations, and those without any turn as rows of len 0 and q 0.

    Conversation c begins with the first h = crc32(c) % 4 turns of conversation c - c % 20, as far as
    there are any, and goes on with its own turns after its first h.
    """
    turns = materialise(turns, "turns-placed")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD_TURNS))
    runs = turns.groupBy("conv_id", "pid").agg(F.max("len").alias("own"))
    all_convs = runs.groupBy("conv_id").agg(F.max("own").alias("own"))
    heads = turns.where((F.col("conv_id") % HEAD_GROUP == 0) & (F.col("pos") < HEAD_TURNS))
    lengths = heads.groupBy(F.col("conv_id").alias("_head")).agg(F.count(F.lit(1)).alias("_has"))
    convs = all_convs.withColumn("_h", h).withColumn("_head", F.col("conv_id") - F.col("conv_id") % HEAD_GROUP).join(lengths, "_head", "left")
    convs = convs.withColumn("_taken", F.least("_h", F.coalesce("_has", F.lit(0))))
    convs = materialise(convs.withColumn("len", F.col("_taken") + F.greatest(F.col("own") - F.col("_h"), F.lit(0))).drop("_has", "own"), "rebuilt")
    # Joined by conversation and partition: a very long conversation is in as many keys as partitions.
    per_run = runs.select("conv_id", "pid").join(convs, "conv_id")
    own = turns.drop("len").join(per_run, ["conv_id", "pid"]).where("pos > _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("q"), "h1", "h2", "w", "len")
    head = heads.select(F.col("conv_id").alias("_head"), "pos", "h1", "h2", "w").join(convs, "_head").where("pos <= _taken").select("conv_id", F.col("pos").alias("q"), "h1", "h2", "w", "len")
    none = convs.where("len = 0").select("conv_id", F.lit(0).cast("long").alias("q"), *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "w", "len")])
    return own.unionByName(head).unionByName(none)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, q, h1, h2, p1, p2, w, len): hashes of the first q and q - 1 turns; q = 0 only for conversations without turns."""
    ship_code()
    keyed = rows.select("conv_id", "q", F.xxhash64("q", "h1").alias("g1"), F.xxhash64("q", F.lit(2), "h2").alias("g2"), "w", "len").where("q > 0")
    hashed = materialise(_hashed(keyed.repartitionByRange("conv_id", "q").sortWithinPartitions("conv_id", "q")), "prefix-hashes")
    # A conversation in several partitions is the last one of some and the first of others: two of a partition at most.
    ends = hashed.groupBy("pid").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    several = ends.select(F.explode(F.array("lo", "hi")).alias("conv_id"), "pid").distinct().groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("conv_id")
    last = hashed.join(broadcast_if_small(several), "conv_id", "left_semi").groupBy("conv_id", "pid").agg(F.max_by("l1", "q").alias("e1"), F.max_by("l2", "q").alias("e2"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("conv_id", "pid", *[F.coalesce(F.bit_xor(f"e{k}").over(before), F.lit(0)).alias(f"o{k}") for k in (1, 2)])
    full = hashed.join(broadcast_if_small(offsets), ["conv_id", "pid"], "left")
    whole = lambda k: F.col(f"l{k}").bitwiseXOR(F.coalesce(F.col(f"o{k}"), F.lit(0)))
    out = full.select("conv_id", "q", whole(1).alias("h1"), whole(2).alias("h2"), whole(1).bitwiseXOR(F.col("g1")).alias("p1"), whole(2).bitwiseXOR(F.col("g2")).alias("p2"), "w", "len")
    zero = F.lit(0).cast("long")
    none = rows.where("q = 0").select("conv_id", "q", zero.alias("h1"), zero.alias("h2"), zero.alias("p1"), zero.alias("p2"), "w", "len")
    return out.unionByName(none)


# --- the forest and its decomposition

def forest(rows: DataFrame) -> DataFrame:
    """Nodes (q, h1, h2, p1, p2, conv_id, parent_conv_id, n_convs, n_children, w, weight) with a root of no turns.

    ``rows`` is what ``prefixes`` returns.  weight: turns below and at the node, over all conversations (one more per conversation at the root).
    """
    grouped = rows.where("q > 0").groupBy(*NODE).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("w").alias("w"), F.sum(F.col("len") - F.col("q") + 1).alias("weight"))
    ends = rows.where("q = len")
    zero = [F.lit(0).cast("long").alias(c) for c in ("q", "h1", "h2", "p1", "p2")]
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("n_convs > 0").select(
        *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("w"), "weight")
    nodes = materialise(grouped.unionByName(root), "trie-nodes")
    parent_of = [(F.col("q") - 1).alias("q"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    below = nodes.where("q > 0").groupBy(*parent_of).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    parents = nodes.where("n_children > 0").select(F.col("q").alias("_pq"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    inner = join_hot(nodes.where("q > 0").withColumn("_pq", F.col("q") - 1), parents, ["_pq", "p1", "p2"], "_rows").drop("_pq", "_rows")
    return inner.unionByName(nodes.where("q = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def centroid_totals(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (n, k) over a forest given by parent positions (-1: a top, parents before children).

    All components of a level are split at once.
    """
    n = len(parent)
    size = np.ones(n, np.int64)
    up = parent.tolist()
    sizes = size.tolist()
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            sizes[up[i]] += sizes[i]
    # Numbers in which every subtree is a run: a node's children take turns after it.
    enter, free, at = [0] * n, [0] * n, 0
    for i in range(n):
        if up[i] < 0:
            enter[i], at = at, at + sizes[i]
        else:
            enter[i] = free[up[i]]
            free[up[i]] += sizes[i]
        free[i] = enter[i] + 1
    enter, full, size = np.array(enter, np.int64), np.array(sizes, np.int64), np.array(sizes, np.int64)
    top = np.arange(n)
    for i in range(n):
        if up[i] >= 0:
            top[i] = top[up[i]]
    out = np.zeros_like(values)
    live = np.arange(n)
    centroid = np.full(n, -1)
    while len(live):
        of = top[live]
        heavy = live[2 * size[live] >= size[of]]
        # The least heavy one of each component is written last; heavy nodes lie on one path, so sizes differ.
        heavy = heavy[np.argsort(-size[heavy], kind="stable")]
        centroid[top[heavy]] = heavy
        c = centroid[of]
        below = (enter[live] >= enter[c]) & (enter[live] < enter[c] + full[c])
        centres = np.unique(c)
        total = np.zeros((n, values.shape[1]), values.dtype)
        np.add.at(total, c[below], values[live[below]])
        out[centres] += total[centres]
        path = ~below & (enter[live] < enter[c]) & (enter[c] < enter[live] + full[live])
        out[live[path]] += total[c[path]]
        size[live[path]] -= size[c[path]]
        # Children of centroids are the tops of the new components below.
        tops = live[np.isin(parent[live], centres)]
        key = top[tops] * n + enter[tops]
        order = np.argsort(key)
        under = below & (live != c)
        found = np.searchsorted(key[order], of[under] * n + enter[live[under]], side="right") - 1
        new_top = tops[order][found] if len(tops) else tops
        top[live[under]] = new_top
        live = live[live != c]
    return out


ROLLED = "q long, h1 long, h2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _task_totals(state: DataFrame) -> DataFrame:
    """Finishes components, each inside one task: adds its nodes' totals within the component to what they hold."""
    keys = ["c_q", "c_h1", "c_h2"]
    cols = [*keys, *NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "leaf", "saved", "add_leaf", "add_saved"]
    dealt = state.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "q")

    def finish(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in [*keys, *NODE, "p1", "p2", "leaf", "saved", "add_leaf", "add_saved"]}
        place, parent = {}, np.full(len(table), -1)
        rows = zip(*(col[c].tolist() for c in [*keys, *NODE, "p1", "p2"]))
        for i, (a, b, c, q, h1, h2, p1, p2) in enumerate(rows):
            place[q, h1, h2] = i
            if (q, h1, h2) != (a, b, c):
                parent[i] = place[q - 1, p1, p2]
        total = centroid_totals(parent, np.stack([col["leaf"], col["saved"]], axis=1))
        total += np.stack([col["add_leaf"], col["add_saved"]], axis=1)
        return pa.table({**{c: table.column(c) for c in [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]},
                         "n_leaves": pa.array(total[:, 0]), "saved_tokens": pa.array(total[:, 1])}).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows < 50_000:
                continue
            # All but the last component are whole.
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(len(table), bool)
            for c in keys:
                x = table.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            cut = np.flatnonzero(new)
            if len(cut):
                yield finish(table.slice(0, cut[-1]))
                table = table.slice(cut[-1])
            held, rows = table.to_batches(), len(table)
        if rows:
            yield finish(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, ROLLED)


def subtree_totals(nodes: DataFrame, rows: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """``nodes`` of ``forest`` with n_leaves and saved_tokens summed over their subtrees.

    saved_tokens: each node's (n_convs - 1) times the words of its last text.  ``rows`` is what ``prefixes`` returns (as a table: it is read in every round).
    """
    ship_code()
    zero = F.lit(0).cast("long")
    state = nodes.select(
        *NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("w")).alias("saved"), zero.alias("add_leaf"), zero.alias("add_saved"), *[zero.alias(f"c_{c}") for c in NODE])
    is_top = (F.col("q") == F.col("c_q")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))
    comp = ["c_q", "c_h1", "c_h2"]
    done: list[DataFrame] = []
    while True:
        state = materialise(state, "components")
        big = state.where(is_top & (F.col("weight") > task_turns)).select(*comp, F.col("weight").alias("_whole"))
        # A node on its own needs no splitting; so few components are above the bound that their list is small: whole weight / task_turns.
        big = materialise(big.join(state.groupBy(*comp).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), comp), "large-components")
        if big.isEmpty():
            break
        large = broadcast_if_small(big)
        inside = state.join(large, comp)
        centre = inside.where("2 * weight >= _whole").groupBy(*comp).agg(F.min(F.struct("weight", (-F.col("q")).alias("_q"), "h1", "h2", "conv_id")).alias("x"))
        centre = materialise(centre.select(*comp, (-F.col("x._q")).alias("z_q"), F.col("x.h1").alias("z_h1"), F.col("x.h2").alias("z_h2"), F.col("x.weight").alias("z_weight"), F.col("x.conv_id").alias("z_conv")), "centroids")
        centres = broadcast_if_small(centre)
        # Conversations that go on after a centroid: the node that follows is the top of the new component of all that they own below.
        beyond = rows.join(centres, (F.col("q") - 1 == F.col("z_q")) & (F.col("p1") == F.col("z_h1")) & (F.col("p2") == F.col("z_h2")))
        beyond = beyond.select("conv_id", *comp, *[F.col(c).alias(f"n_{c}") for c in NODE])
        at_centre = (F.col("q") == F.col("z_q")) & (F.col("h1") == F.col("z_h1")) & (F.col("h2") == F.col("z_h2"))
        # A child's members own nodes below it only if the child's own row says so: joined by the owner of the node.
        moved = materialise(inside.join(centres, comp).join(beyond, ["conv_id", *comp], "left")
                            .withColumn("_below", F.col("n_q").isNotNull() & (F.col("q") > F.col("z_q"))).withColumn("_centre", at_centre), "components-split")
        under = moved.where("_below or _centre").groupBy(*comp).agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
        totals = broadcast_if_small(materialise(centre.join(under, comp), "centroid-totals"))
        # Nodes above a centroid are the beginnings of any conversation through it.
        path = rows.join(totals.select("z_conv", "z_q", *comp, F.lit(True).alias("_path")), (F.col("conv_id") == F.col("z_conv")) & (F.col("q") < F.col("z_q")) & (F.col("q") >= F.col("c_q"))).select(*comp, *NODE, "_path")
        path = path.unionByName(totals.where("c_q = 0 and z_q > 0").select(*comp, *[zero.alias(c) for c in NODE], F.lit(True).alias("_path"))).distinct()
        done.append(moved.where("_centre").join(totals.select(*comp, "t_leaf", "t_saved"), comp).select(
            *NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("t_leaf") + F.col("add_leaf")).alias("n_leaves"), (F.col("t_saved") + F.col("add_saved")).alias("saved_tokens")))
        rest = moved.where("not _centre").join(totals.select(*comp, "t_leaf", "t_saved"), comp).join(path, [*comp, *NODE], "left")
        plus = lambda c, x: (F.col(c) + F.when(F.col("_path"), F.col(x)).otherwise(0)).alias(c)
        new = lambda c: F.when(F.col("_below"), F.col(f"n_{c}")).otherwise(F.col(f"c_{c}")).alias(f"c_{c}")
        split = rest.select(*NODE, "p1", "p2", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("weight") - F.when(F.col("_path"), F.col("z_weight")).otherwise(0)).alias("weight"),
                            "leaf", "saved", plus("add_leaf", "t_leaf"), plus("add_saved", "t_saved"), *[new(c) for c in NODE])
        state = state.join(large.select(*comp), comp, "left_anti").unionByName(split)
    out = _task_totals(state)
    for d in done:
        out = out.unionByName(d.select(*out.columns))
    return out


# --- digests of the members that end at a node

def end_digests(ends: DataFrame, keys: list[str], id_col: str = "conv_id") -> DataFrame:
    """SHA-256 of the ids per key, ascending and joined by commas.

    Ids are sorted by range, so that one key's ids are spread over tasks; what a partition holds of a
    key goes on as one piece, and the pieces of a key are hashed in order as they stream by.
    """
    ship_code()
    dealt = ends.select(*keys, id_col).repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col)
    n = len(keys)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy() for i in range(n)]
            new = np.zeros(len(batch), bool)
            new[0] = True
            for x in cols:
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            ids = batch.column(n)
            texts = ids.cast(pa.string()).to_pylist()
            stops = np.append(first[1:], len(batch))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in cols), ids.take(pa.array(first)), pa.array([",".join(texts[a:b]) for a, b in zip(first, stops)])],
                                             names=[*keys, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, sha = None, None
        for batch in batches:
            out = []
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate([*keys, "sha256"])})
        if now is not None:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip([*keys, "sha256"], (*now, sha.hexdigest()))})

    typed = ", ".join(f"{k} long" for k in keys)
    parts = dealt.mapInArrow(pieces, f"{typed}, first long, piece string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{typed}, sha256 string")


def prefix_trie(df: DataFrame, rebuild: bool = True, task_turns: int = TASK_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    ``df`` has conv_id, turn, role, text.  ``rebuild``: conversations take shared heads first (``with_shared_heads``),
    otherwise they are taken as they are.
    """
    ship_code()
    turns = conversation_rows(df)
    if rebuild:
        rebuilt = with_shared_heads(turns)
    else:
        rebuilt = turns.select("conv_id", F.col("pos").alias("q"), "h1", "h2", "w", "len")
    rows = materialise(prefixes(materialise(rebuilt, "turns-rebuilt")), "prefixes")
    nodes = subtree_totals(forest(rows), rows, task_turns)
    ends = end_digests(rows.where("q = len").select(*NODE, "conv_id"), NODE)
    return nodes.join(ends, NODE, "left").select(
        "conv_id", F.col("q").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
