"""Near-copies by word shingles: MinHash bands for candidates, then the exact Jaccard similarity.

Fingerprints that differ in two bits are found exactly by their Golay keys, but
near-copies at a similarity of 0.8 differ in 3 to 11 bits (one in 300 of the
test tables' near-copies differs in two), so where near-copies are to be merged
the links of both are joined.

Texts with the same set of shingles are one node. A node has keys in 20 bands of
five least hashes, and a sketch of 400 bytes: one byte of the least hash in each
of 400 bins, zero where a bin is empty. Equal bytes, as a share of the bins that
either fills, estimate the similarity within 0.02, better for short texts.

Candidates come in two turns and are compared by their whole sets. First, within
a band's bucket, leaders are chosen one after another: the node most like the
bucket's commonest values takes what resembles it, and the rest go on, so a
bucket of n nodes gives fewer than n candidates. What these links join is one
group, and a large class of copies is then one group none of whose pairs are
made.

Second, what leaders have missed is found by prefixes. Shingles are ordered by
how many nodes hold them, rarest first. Two sets of similarity t must share
their first common shingle so early that what is left of either can still reach
the overlap that t asks for: of the smaller one at least 2t / (1 + t) is left.
So nodes of different groups meet under the shingles of their prefixes only,
and only where both have enough left. Pages of one template that are less alike
than t have rarer shingles of their own in front, more than a prefix holds, and
never meet: such a class costs its size. Larger buckets are led in parts in the
first turn and cut into blocks of two parts in the second, so that any two of
their nodes meet in some block. The bands alone decide which nodes take part:
those in a bucket that still holds several groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, cut, kept, own, tidy
from groundloom.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
BINS = 400
#: Least estimate at which two nodes are compared: four standard errors under the similarity.
RESEMBLES = 0.72
#: Nodes of one bucket that a task takes at a time (400 bytes each).
BUCKET = 8_000
#: Nodes whose ids may be sent to all executors (8 bytes each); more are shuffled.
FEW = 500_000
#: Sets held by a task at a time.
SLICE = 256


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    begins = [0, *stops[: n - 1].tolist()]
    ends = (stops[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(begins, ends, strict=True)], dtype=np.uint64))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, as 32 bits; empty bins take the next one's, marked by how far it is."""
    k = BANDS * ROWS
    if not len(hashes):
        return np.zeros(k, np.uint32)
    bins, value = (hashes % np.uint64(k)).astype(np.int64), (hashes // np.uint64(k)).astype(np.uint32)
    least = np.full(k, 1 << 32, dtype=np.int64)
    np.minimum.at(least, bins, value.astype(np.int64))
    full = np.flatnonzero(least < 1 << 32)
    at = np.arange(k)
    source = full[np.searchsorted(full, at) % len(full)]
    away = (source - at) % k
    return ((least[source] + away * 0x9E3779B1) & 0xFFFFFFFF).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each bin 1 to 255, from its least hash; 0 where it is empty."""
    bins, value = (hashes % np.uint64(BINS)).astype(np.int64), hashes // np.uint64(BINS)
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bins, value)
    out = np.zeros(BINS, np.uint8)
    out[bins] = 1 + least[bins] % np.uint64(255)
    return out


def resemblance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch with each of many; 0 where neither has a shingle."""
    blank = np.count_nonzero((many | one) == 0, axis=1)
    return (np.count_nonzero(many == one, axis=1) - blank) / np.maximum(BINS - blank, 1)


def described(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            nodes, sketches, keys = [], [], []
            for t in f["text"]:  # one set at a time
                hashes = shingle_set(t, width)
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
                sketches.append(sketch(hashes).tobytes())
                least = least_hashes(hashes).reshape(BANDS, ROWS)
                keys.append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) - (1 << 63) for i, band in enumerate(least)])
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "mark": f["mark"], "node": nodes, "sketch": sketches, "keys": keys})

    return run


def led(nodes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """(leader, follower) within one bucket. What is common is counted anew each time a fifth of the nodes has gone."""
    out, left, counted = [], np.arange(len(nodes)), None
    while len(left) > 1:
        if counted is None or len(left) <= 0.8 * counted:
            some, counted = sketches[left], len(left)
            common = np.array([np.bincount(c, minlength=256).argmax() for c in some.T], dtype=np.uint8)
            left = left[np.argsort(-(some == common).sum(axis=1), kind="stable")]
        leader, left = left[0], left[1:]
        near = resemblance(sketches[leader], sketches[left]) >= RESEMBLES
        out.append(np.stack([np.full(np.count_nonzero(near), nodes[leader]), nodes[left[near]]], axis=1))
        left = left[~near]
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def sketched(nodes: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    return led(nodes, np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1))


def crossed(similarity: float):
    """Makes the match of one shingle's bucket: nodes of different groups that may be similar, by where in each the shingle stands and how large each is."""

    def match(nodes: np.ndarray, groups: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        left = size - pos
        of, n = np.unique(groups, return_inverse=True, return_counts=True)[1:]
        largest = int(n.argmax())
        others = np.flatnonzero(of != largest)
        out = []
        for i in np.flatnonzero(left >= np.ceil(2 * similarity / (1 + similarity) * size - 1e-9)):  # as the smaller of two
            to = others if of[i] == largest else np.arange(len(nodes))
            to = to[(size[to] >= size[i]) & (of[to] != of[i])]
            enough = np.minimum(left[i], left[to]) >= np.ceil(similarity / (1 + similarity) * (size[i] + size[to]) - 1e-9)
            hit = to[enough]
            if len(hit):
                out.append(np.stack([np.full(len(hit), nodes[i]), nodes[hit]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)

    return match


def by_part(match, *columns: str):
    """a, b: what match gives for each bucket and part. frames come sorted by both; a part may go on in the next frame."""

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        key, part = f["bucket"].to_numpy(), f["part"].to_numpy()
        values = [f[c].to_numpy() for c in ("node", *columns)]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
        out = [match(*(v[at:stop] for v in values)) for at, stop in zip(edge[:-1], edge[1:], strict=True) if stop - at > 1]
        return pd.DataFrame(np.concatenate([np.empty((0, 2), dtype=np.int64), *out]), columns=["a", "b"]).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            same = ((f["bucket"] == f["bucket"].iloc[-1]) & (f["part"] == f["part"].iloc[-1])).to_numpy()
            last = int(np.argmax(same))
            if last == 0 and held and (held[-1]["bucket"].iloc[-1], held[-1]["part"].iloc[-1]) == (f["bucket"].iloc[-1], f["part"].iloc[-1]):
                held.append(f)
                continue
            if last or held:
                yield pairs(pd.concat([*held, f.iloc[:last]]))
            held = [f.iloc[last:]]
        if held:
            yield pairs(pd.concat(held))

    return run


def sets_of(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), SLICE):
                some = f.iloc[at : at + SLICE]
                yield pd.DataFrame({"node": some["node"], "hashes": [shingle_set(t, width).view(np.int64) for t in some["text"]]})

    return run


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """node, bucket (a shingle that others have too), pos (its place from 0, rarest first), size: the part of each set in which the first shingle shared with a similar set must stand."""
    size = F.size("hashes")
    each = sets.select("node", size.alias("size"), F.explode("hashes").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = each.join(counts, "bucket").groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "bucket"))).alias("s"))
    own_ = F.col("size") - F.size("s")
    most = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9).cast("int") + 1 - own_
    return found.where(most > 0).select("node", "size", own_.alias("own"), F.posexplode(F.slice("s", F.lit(1), most)).alias("i", "x")).select("node", F.col("x.bucket").alias("bucket"), (F.col("own") + F.col("i")).alias("pos"), "size")


def similar_texts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, node) for each row of docs, and links a, b that span the groups of nodes with at least that similarity.

    A null text counts as empty; texts without words are one node. mark is a
    hash of the text. Rows alike give the same node. Only doc_id and text are
    read; an empty table gives empty tables. A bucket of over ``bucket`` nodes is
    led in parts, then met in blocks of two parts.
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    found = kept(rows.mapInPandas(tidy(described(width)), "doc_id bigint, mark bigint, node bigint, sketch binary, keys array<bigint>"), "shingles")
    keys = found.select("node", F.explode("keys").alias("bucket")).distinct()
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = kept(keys.join(sizes, "bucket"), "bands")
    wanted = shared.select("node").distinct()
    nodes = found.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("sketch").alias("sketch"), F.min(F.struct("doc_id", "mark")).alias("one"))
    nodes = kept(nodes.select("node", "sketch", F.col("one.doc_id").alias("_id"), F.col("one.mark").alias("_mark")), "nodes")
    read = rows.join(nodes.drop("sketch"), rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["mark"] == F.col("_mark"))).select("node", "text")
    sets = kept(read.mapInPandas(tidy(sets_of(width)), "node bigint, hashes array<bigint>").dropDuplicates(["node"]), "sets")
    sketches = nodes.select("node", "sketch")

    def dealt(some: DataFrame) -> DataFrame:
        return some.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node")

    def pairs(tried: DataFrame) -> DataFrame:
        return tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()

    def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one, other = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("x", "p"), ("y", "q")))
        common = F.size(F.array_intersect("p", "q"))
        enough = common >= F.lit(similarity) * (F.size("p") + F.size("q") - common)
        return pairs.join(one, "x").join(other, "y").where(enough).select(F.col("x").alias("a"), F.col("y").alias("b"))

    parts = F.ceil(F.col("n") / bucket).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    followers = dealt(shared.select("node", "bucket", part.alias("part")).join(sketches, "node")).mapInPandas(tidy(by_part(sketched, "sketch")), "a bigint, b bigint")
    first = kept(pairs(followers), "led")
    links = kept(alike(first, sets), "links")

    groups = cut(components(links).withColumnRenamed("node", "of"))
    grouped = lambda some: some.join(groups, F.col("node") == F.col("of"), "left").select(*some.columns, F.coalesce("root", "node").alias("group"))
    # Only nodes of band buckets that still hold several groups can be similar to one of another group.
    banded = kept(grouped(shared.select("node", "bucket")), "groups")
    mixed = banded.groupBy("bucket").agg(F.min("group").alias("p"), F.max("group").alias("q")).where("p < q").select("bucket")
    open_ = banded.join(mixed, "bucket", "left_semi").select("node").distinct()
    prefixes = grouped(_prefixes(sets.join(open_, "node", "left_semi"), similarity)).select("node", "bucket", "pos", "size", "group")
    prefixes = kept(prefixes, "prefixes")
    several = prefixes.groupBy("bucket").agg(F.min("group").alias("p"), F.max("group").alias("q"), F.count(F.lit(1)).alias("n")).where("p < q").select("bucket", "n")
    # A bucket of k parts has a block for each two of them; a node is in the k blocks of its part.
    blocks = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.least(q, part).cast("long") * parts + F.greatest(q, part))).alias("part")
    met = dealt(prefixes.join(several, "bucket").select("node", "bucket", "group", "pos", "size", blocks)).mapInPandas(tidy(by_part(crossed(similarity), "group", "pos", "size")), "a bigint, b bigint")
    second = kept(pairs(met).join(first, ["x", "y"], "left_anti"), "met")
    few = kept(second.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "few")
    rest = sets.join(F.broadcast(few) if few.count() <= FEW else few, "node", "left_semi")
    links = links.unionByName(alike(second, rest))
    return found.select("doc_id", "mark", "node"), cut(links.distinct())
