"""A trie of conversation prefixes by distributed radix partitioning, most significant turn first.

Turns (role and text) are encoded as numbers of a dictionary, so a conversation
is a string of numbers. Equal conversations are one unit with a weight. Units
that share a prefix form a bucket, at first all of them. A round takes all
buckets of over ``local`` turns: it skips the turns that all units of a bucket
share, and splits it by the first turn that they don't, emitting the nodes
passed. Buckets that have become small are finished each in memory by multikey
quicksort, whose branches on equal turns emit the nodes; what a single unit has
left is a chain of nodes, which needs no bucket. Subtree sums then go back up
the rounds.

A node is known by its depth and its smallest member. Rows stay one a turn, so
no conversation, bucket or node with very many rows is gathered; the longest
work on one key is the hash of its members' ids, which streams.

Rounds grow with the branching levels inside buckets of over ``local`` turns,
not with depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, cut, kept, own, tidy

#: Turns that one task may hold of a bucket, the conversations that share a start, and the most turns shared, plus one.
LOCAL, FAMILY, STARTS = 1 << 18, 100, 6
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint"
NOTHING = hashlib.sha256(b"").hexdigest()


def zero() -> Column:
    return F.lit(0).cast("long")



def running(rows: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """rows with at (how many rows of the key come before, by order) and before (the sum of value over them).

    The whole table is cut into ranges of key and order, so a key with very
    many rows spans ranges; each range counts by itself and adds what its key
    has in earlier ranges.
    """
    ranged = kept(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("part", key).orderBy(*order)
    here = ranged.withColumn("at", F.row_number().over(w).cast("long") - 1).withColumn("before", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part", key).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    sums = sums.select("part", key, F.sum("_rows").over(earlier).alias("_rows"), F.sum("_sum").over(earlier).alias("_sum")).where("_rows is not null")
    out = here.join(sums, ["part", key], "left")
    return out.select(*rows.columns, (F.col("at") + F.coalesce("_rows", zero())).alias("at"), (F.col("before") + F.coalesce("_sum", zero())).alias("before"))


def encoded(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), id (of the dictionary of turns), n (code points of the text): one row for each turn.

    Turns are ordered by turn, null first; turns of equal number by a digest of
    role and text, so reruns agree. A null role or text is empty. Rows without
    a conv_id belong to no conversation and are left out.
    """
    said = own(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = as_text(F.col("role").cast("string")), as_text(F.col("text"))
    marked = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = said.select(F.col("conv_id").cast("long").alias("conv"), "turn", marked.alias("mark"), F.length(text).cast("long").alias("n"))
    placed = kept(running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("mark")], "n").select("conv", F.col("at").alias("pos"), "mark", "n"), "placed")
    dictionary = kept(placed.select("mark").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    return kept(placed.join(dictionary, "mark").select("conv", "pos", "id", "n"), "encoded")


def with_shared_starts(turns: DataFrame, family: int = FAMILY, starts: int = STARTS) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv, length) where each conversation c starts with the first h turns of c - c % family in place of its own.

    h is the crc32 of c in decimal, modulo starts. A conversation can end up without turns.
    """
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("m"))
    h = (F.crc32(F.col("conv").cast("string")) % starts).alias("h")
    convs = counts.select("conv", "m", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    bases = counts.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("m").alias("base_m"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("base_m", zero())))
    convs = kept(convs.select("conv", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("m") - F.col("h"), zero())).alias("length")), "conversations")
    rest = turns.join(convs.select("conv", "h", "shared"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "id", "n")
    first = turns.where((F.col("pos") < starts - 1) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    first = first.join(convs.select("conv", "base", "h"), "base").where("pos < h").select("conv", "pos", "id", "n")
    return kept(rest.unionByName(first), "rebuilt"), convs.select("conv", "length")


def units_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (unit, w, length): the smallest of equal conversations, and how many they are; and members (unit, conv).

    Conversations are equal if they are as long and two 64-bit hashes over their numbered turns agree.
    """
    a, b = F.xxhash64("pos", "id"), F.xxhash64("id", "pos", F.lit(11))
    prints = turns.groupBy("conv").agg(F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))
    signed = convs.join(prints, "conv", "left").select("conv", "length", F.coalesce("a", zero()).alias("a"), F.coalesce("b", zero()).alias("b"))
    classes = signed.groupBy("length", "a", "b").agg(F.min("conv").alias("unit"), F.count(F.lit(1)).alias("w"))
    members = signed.join(classes.select("length", "a", "b", "unit"), ["length", "a", "b"]).select("unit", "conv")
    return classes.select("unit", "w", "length"), members


def ends_of(members: DataFrame) -> DataFrame:
    """unit, ends_sha256: the hash of its members' ids, rising, comma-joined. Ranges pack ids into texts; the hash reads texts one by one."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, conv = (batch.column(c).to_numpy() for c in ("unit", "conv"))
            at = np.flatnonzero(np.diff(unit, prepend=unit[:1] - 1)) if len(unit) else unit
            texts = [",".join(map(str, x.tolist())) for x in np.split(conv, at[1:])] if len(unit) else []
            yield pa.RecordBatch.from_arrays([pa.array(unit[at], pa.int64()), pa.array(conv[at], pa.int64()), pa.array(texts, pa.string())], names=["unit", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            units, texts = [], []
            for unit, ids in zip(batch.column("unit").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if unit != now:
                    if sha is not None:
                        units.append(now)
                        texts.append(sha.hexdigest())
                    now, sha = unit, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(texts, pa.string())], names=["unit", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], names=["unit", "ends_sha256"])

    chunks = members.repartitionByRange("unit", "conv").sortWithinPartitions("unit", "conv").mapInArrow(packed, "unit bigint, first bigint, ids string")
    return chunks.repartition("unit").sortWithinPartitions("unit", "first").mapInArrow(hashed, "unit bigint, ends_sha256 string")


def quicksorted(unit: np.ndarray, w: np.ndarray, start: np.ndarray, ids: np.ndarray, n: np.ndarray, depth: int, conv: int) -> list[np.ndarray]:
    """The nodes below a bucket, and first the bucket's own (its saved_tokens without its own text), as the columns of NODES and whether ends is set.

    start: where each unit's turns from depth on begin in ids, and where the last ends.
    """
    length = np.diff(start)
    nodes = [[conv, depth, conv, int(w.sum()), 0, 0, 0, conv, False]]
    up = [-1]
    chains: list[tuple[int, int, int]] = []  # unit, turns from the bucket on, node above
    todo = [(np.arange(len(unit)), 0, 0)]
    while todo:
        group, d, node = todo.pop()
        over = length[group] == d
        if over.any():  # one unit at most: equal ones are one
            nodes[node][7:] = [int(unit[group[over]][0]), True]
            group = group[~over]
        if not len(group):
            continue
        turn = ids[start[group] + d]
        pivot = turn[len(turn) // 2]
        todo += [(other, d, node) for other in (group[turn > pivot], group[turn < pivot]) if len(other)]
        same = group[turn == pivot]
        nodes[node][4] += 1
        if len(same) == 1:
            chains.append((int(same[0]), d, node))
            continue
        weight = int(w[same].sum())
        nodes.append([int(unit[same].min()), depth + d + 1, nodes[node][0], weight, 0, 0, (weight - 1) * int(n[start[same[0]] + d]), conv, False])
        up.append(node)
        todo.append((same, d + 1, len(up) - 1))
    below: list[list] = [[] for _ in range(9)]
    for u, d, node in chains:
        k = int(length[u] - d)
        at = np.arange(k)
        saved = np.cumsum(n[start[u] + d : start[u + 1]][::-1])[::-1] * (w[u] - 1)
        nodes[node][5] += 1
        nodes[node][6] += int(saved[0])
        whole = np.full(k, unit[u])
        parts = (whole, depth + d + 1 + at, np.where(at == 0, nodes[node][0], unit[u]), np.full(k, w[u]), (at < k - 1).astype("int64"), np.ones(k, dtype="int64"), saved, whole, at == k - 1)
        for column, part in zip(below, parts, strict=True):
            column.append(part)
    for i in range(len(up) - 1, -1, -1):
        nodes[i][5] += nodes[i][4] == 0
        if i:
            nodes[up[i]][5] += nodes[i][5]
            nodes[up[i]][6] += nodes[i][6]
    return [np.concatenate([np.array(a), *b]) for a, b in zip(zip(*nodes, strict=True), below, strict=True)]


def finished(rows: DataFrame) -> DataFrame:
    """Nodes of NODES, with bucket (true for the bucket's own), of rows bucket_depth, bucket_conv, unit, w, pos, id, n: one for each turn left, or with null turns for a unit that ends at its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def bucket() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            col = lambda c: t.column(c).to_numpy()
            unit = col("unit")
            begins = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1))
            none = t.column("id").is_null().to_numpy()
            ids, n = (t.column(c).fill_null(0).to_numpy()[~none] for c in ("id", "n"))
            start = np.concatenate([np.cumsum(~none)[begins] - (~none)[begins], [len(ids)]])
            out = quicksorted(unit[begins], col("w")[begins], start, ids, n, *now)
            columns = [*map(pa.array, out[:7]), pa.array(out[7], mask=~out[8]), pa.array(np.arange(len(out[0])) == 0)]
            return pa.RecordBatch.from_arrays(columns, names=[*(x.split()[0] for x in NODES.split(", ")), "bucket"])

        for batch in batches:
            depth, conv = (batch.column(c).to_numpy() for c in ("bucket_depth", "bucket_conv"))
            edges = np.flatnonzero((np.diff(depth) != 0) | (np.diff(conv) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                key = (int(depth[a]), int(conv[a]))
                if held and key != now:
                    yield bucket()
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield bucket()

    dealt = rows.repartition("bucket_depth", "bucket_conv").sortWithinPartitions("bucket_depth", "bucket_conv", "unit", "pos")
    return dealt.mapInArrow(tidy(run), f"{NODES}, bucket boolean")


def _state(units: str, rest: str, local: int) -> Column:
    return F.when(F.col(units) == 1, "chain").when(F.col(rest) <= local, "local").otherwise("open")


def _total(saved: str = "saved") -> Column:
    return F.sum(saved).alias("saved")


def _chains(closed: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of what single units have left; those of weight 1 save nothing and need no running sum."""
    left = turns.join(closed.where("kind = 'chain'").select("unit", F.col("bucket.depth").alias("from")), "unit").where("pos >= from")
    left = left.select("unit", "w", "length", "pos", "n", "from")
    copies = running(left.where("w > 1"), "unit", [F.col("pos").desc()], "n").select(*left.columns, ((F.col("w") - 1) * (F.col("before") + F.col("n"))).alias("saved"))
    both = copies.unionByName(left.where("w = 1").withColumn("saved", zero()))
    last = F.col("pos") + 1 == F.col("length")
    return both.select(
        F.col("unit").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("unit").alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("unit")).alias("ends"), (F.col("pos") == F.col("from")).alias("first"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node of the trie.

    turns: conv, pos (from 0, without gaps), id, n; convs: conv, length, one row
    each. A conversation without turns is a member of the root alone. Without
    conversations there are no rows. local: the most turns of a bucket that one
    task finishes; it changes no result.
    """
    spark = turns.sparkSession
    units, members = units_of(turns, convs)
    units = kept(units, "units")
    ended = lambda depth: F.max(F.when(F.col("length") == depth, F.col("unit"))).alias("ends")
    root = units.agg(F.min("unit").alias("conv"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("u"), F.sum("length").alias("rest"), ended(F.lit(0)))
    root = cut(root.where("u > 0").select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(None).cast("struct<depth:bigint,conv:bigint>").alias("above"), F.lit(None).cast("long").alias("parent_conv"), "n_convs", zero().alias("n"), "ends", "u", _state("u", "rest", local).alias("kind")))
    seq = kept(turns.join(units, turns["conv"] == units["unit"]).select("unit", "w", "length", "pos", "id", "n"), "sequences")
    at_root = units.crossJoin(F.broadcast(root.select(F.struct("depth", "conv").alias("bucket"), "n_convs", "u", "kind")))  # one row
    tops, closed, paths, fails = [root], [at_root.where("kind != 'open'")], [], []
    open_ = at_root.where("kind = 'open'")
    while tops[-1].where("kind = 'open'").limit(1).count():
        left = seq.join(open_.select("unit", "bucket", "n_convs", "u"), "unit").where(F.col("pos") >= F.col("bucket.depth"))
        each = left.groupBy("bucket", "pos").agg(F.max("u").alias("u"), F.max("n_convs").alias("n_convs"), F.count(F.lit(1)).alias("k"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("n").alias("n"))
        each = kept(each.withColumn("alike", (F.col("k") == F.col("u")) & (F.col("low") == F.col("high"))), "positions")
        fail = cut(each.groupBy("bucket").agg(F.min(F.when(~F.col("alike"), F.col("pos"))).alias("fail")))
        split = open_.select("unit", "w", "length", "bucket").join(fail, "bucket")
        path_ends = split.where((F.col("length") == F.col("fail")) & (F.col("fail") > F.col("bucket.depth"))).select("bucket", F.col("unit").alias("ends"))
        paths.append(each.join(fail, "bucket").where("pos < fail").join(path_ends, "bucket", "left").select("bucket", "pos", "n_convs", "n", "fail", F.when(F.col("pos") + 1 == F.col("fail"), F.col("ends")).alias("ends")))
        step = split.join(seq.select("unit", "pos", "id", "n"), "unit").where("pos = fail")
        children = step.groupBy("bucket", "fail", "id").agg(F.min("unit").alias("conv"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("u"), F.sum(F.col("length") - F.col("fail") - 1).alias("rest"), F.max("n").alias("n"), ended(F.col("fail") + 1))
        children = kept(children.withColumn("kind", _state("u", "rest", local)), "children")
        below = F.struct((F.col("fail") + 1).alias("depth"), "conv")
        moved = step.select("unit", "w", "length", "bucket", "id").join(children.drop("ends", "n", "rest"), ["bucket", "id"])
        moved = kept(moved.select("unit", "w", "length", below.alias("bucket"), "n_convs", "u", "kind"), "moved")
        closed.append(moved.where("kind != 'open'"))
        fails.append(fail)
        tops.append(children.select((F.col("fail") + 1).alias("depth"), "conv", F.col("bucket").alias("above"), F.col("bucket.conv").alias("parent_conv"), "n_convs", "n", "ends", "u", "kind"))
        open_ = moved.where("kind = 'open'")
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    chains = kept(_chains(done, seq), "chains")
    small = done.where("kind = 'local'").select("unit", "w", "length", F.col("bucket.depth").alias("bucket_depth"), F.col("bucket.conv").alias("bucket_conv"))
    left = seq.select("unit", "pos", "id", "n").join(small, "unit").where("pos >= bucket_depth").drop("length")
    none = small.where("length = bucket_depth").select("unit", "w", "bucket_depth", "bucket_conv", *(F.lit(None).cast("long").alias(c) for c in ("pos", "id", "n")))
    local_nodes = kept(finished(left.unionByName(none)), "nodes")

    # Subtree sums of buckets: of closed ones from their nodes, of split ones from their children, last round first.
    summary = [F.struct("depth", "conv").alias("bucket"), "n_children", "n_leaves", "saved"]
    of_local = local_nodes.where("bucket").select(F.col("depth"), F.col("conv_id").alias("conv"), "n_children", "n_leaves", F.col("saved_tokens").alias("saved")).select(*summary)
    of_chain = chains.where("first").select((F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("conv"), F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved_tokens").alias("saved")).select(*summary)
    bare = done.where("kind = 'chain' and length = bucket.depth").select("bucket", zero().alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero().alias("saved"))
    known = of_local.unionByName(of_chain).unionByName(bare)
    out = [local_nodes.where("not bucket").drop("bucket"), chains.drop("first")]
    resolved, path_sums = known, []
    for r in range(len(tops) - 1, -1, -1):
        if r < len(fails):
            sums = above.groupBy("above").agg(F.count(F.lit(1)).alias("k"), F.sum("n_leaves").alias("n_leaves"), _total("saved_tokens"))
            on_path = paths[r].groupBy("bucket").agg(F.sum((F.col("n_convs") - 1) * F.col("n")).alias("passed"))
            sums = cut(sums.withColumnRenamed("above", "bucket").join(fails[r], "bucket").join(on_path, "bucket", "left"))
            path_sums.append(sums)
            straight = F.col("fail") == F.col("bucket.depth")
            resolved = known.unionByName(sums.select("bucket", F.when(straight, F.col("k")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + F.coalesce("passed", zero())).alias("saved")))
        nodes = tops[r].withColumn("bucket", F.struct("depth", "conv")).join(resolved, "bucket")
        above = nodes.withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * F.col("n"))
        above = kept(above.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "above"), "tops")
        out.append(above.drop("above"))
    for passed, sums in zip(paths, reversed(path_sums), strict=True):
        own_saved = passed.withColumn("own", (F.col("n_convs") - 1) * F.col("n"))
        suffix = running(own_saved, "bucket", [F.col("pos").desc()], "own").join(sums.select("bucket", "k", "n_leaves", "saved"), "bucket")
        last = F.col("pos") + 1 == F.col("fail")
        out.append(suffix.select(
            F.col("bucket.conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("bucket.conv").alias("parent_conv_id"), "n_convs", F.when(last, F.col("k")).otherwise(1).cast("long").alias("n_children"),
            "n_leaves", (F.col("saved") + F.col("before") + F.col("own")).alias("saved_tokens"), "ends",
        ))
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    hashes = ends_of(members)
    without = nodes.where("ends is null").drop("ends").withColumn("ends_sha256", F.lit(NOTHING))
    return without.unionByName(nodes.join(hashes, nodes["ends"] == hashes["unit"]).drop("ends", "unit"))


def conversation_trie(conversations: DataFrame, local: int = LOCAL, shared: bool = True) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text; other columns aren't read), see prefix_trie() and encoded().

    shared: conversations start with turns of the first of their hundred, see with_shared_starts(). An empty table gives no rows.
    """
    turns = encoded(conversations)
    if shared:
        return prefix_trie(*with_shared_starts(turns), local)
    return prefix_trie(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")), local)
