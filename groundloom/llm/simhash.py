"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21. Two fingerprints
with at most two differing bits have an error-free segment, and at most two
errors in the one after it. The binary Golay code (23 bits, 12 of them free) is
perfect: each word lies within three bits of one codeword. A segment's keys are
the indices of the codewords of all words within one bit of it, one or six of
them. Two words with at most two differing bits have a common neighbour within
one bit, hence a common key. So each fingerprint gets, for each segment taken as
exact, that segment and the keys of the next: at most 18 keys of 34 bits, under
which every linked pair meets. Pairs are then verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, cut, own, tidy
from groundloom.llm.components import components
from groundloom.llm.shingles import SIMILARITY, similar_texts

SEED, WIDTH, MAX_BITS = 42, 3, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
#: Distinct fingerprints under one key that one task links by itself; larger buckets are split by midpoint.
BUCKET = 50_000
ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit SimHash of word shingles; 0 where there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        stops = np.cumsum([len(w) + 1 for w in words])
        begins = [0, *stops[: len(words) - width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(begins, (stops[width - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(width: int):
    """fingerprint() as a function of a text column, by Arrow batches."""
    return F.pandas_udf(lambda texts: pd.Series([fingerprint(t, width) for t in texts], dtype="int64"), "bigint")


def _syndrome(word: np.ndarray) -> np.ndarray:
    """The remainder by the generator polynomial, for words of 23 bits."""
    rest = word.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _errors() -> np.ndarray:
    """The error of weight at most three for each of the 2048 remainders."""
    bits = [1 << i for i in range(23)]
    words = [0, *bits]
    words += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    words += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    words = np.array(words, dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndrome(words)] = words
    return table


class Golay:
    def __init__(self):
        self.errors = _errors()
        every = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = _syndrome(every), _syndrome(every << 12 & 0x7FFFFF)

    def index(self, word: np.ndarray) -> np.ndarray:
        """The 12 free bits of the nearest codeword."""
        return (word ^ self.errors[self.low[word & 0xFFF] ^ self.high[word >> 12]]) >> 11

    def keys(self, word: np.ndarray) -> np.ndarray:
        """Rows of the indices within one bit, sorted, -1 for repeats."""
        flips = np.array([0, *(1 << i for i in range(23))], dtype=np.int64)
        found = np.sort(self.index(word[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return found


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """print, key: a row for each key of each fingerprint."""
    golay = Golay()
    for f in frames:
        prints = f["print"].to_numpy().view(np.uint64)
        parts = _segments(prints)
        for i in range(3):
            k = golay.keys(parts[(i + 1) % 3])
            row, col = np.nonzero(k >= 0)
            yield pd.DataFrame({"print": prints[row].view(np.int64), "key": (i << 34) | (parts[i][row] << 12) | k[row, col]})


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reached from each of n nodes over links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what lies within two bits among distinct prints: no more links than prints."""
    n = len(prints)
    if n <= 256:
        a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= MAX_BITS, 1))
    else:  # two prints within two bits have a common neighbour within one bit
        flips = np.concatenate([np.zeros(1, np.uint64), ONE << np.arange(64, dtype=np.uint64)])
        middle = (prints[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(middle, kind="stable")
        same = middle[order][1:] == middle[order][:-1]
        a, b = order[:-1][same] // 65, order[1:][same] // 65
    label = _labels(a, b, n)
    moved = np.nonzero(label != np.arange(n))[0]
    return prints[moved], prints[label[moved]]


def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: links within each bucket. frames come sorted by key; a bucket may go on in the next frame."""

    def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pd.DataFrame]:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edge)
        two = edge[:-1][sizes == 2]
        near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= MAX_BITS
        out = [(prints[two][near], prints[two + 1][near])]
        out += [forest(prints[at : at + n]) for at, n in zip(edge[:-1][sizes > 2], sizes[sizes > 2], strict=True)]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
        yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for f in frames:
        if not len(f):
            continue
        keys, prints = f["key"].to_numpy(), f["print"].to_numpy().view(np.uint64)
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[-1][0][-1] == keys[-1]:
            held.append((keys, prints))
            continue
        held.append((keys[:last], prints[:last]))
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = [(keys[last:], prints[last:])]
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def midpoints(prints: DataFrame) -> DataFrame:
    """a, b: links of prints through common neighbours within one bit, with sums only: for buckets of any size."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = prints.select("print", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("print")))).alias("middle"))
    least = near.groupBy("middle").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "b")
    return near.join(least, "middle").where(F.col("print") != F.col("b")).select(F.col("print").alias("a"), "b").distinct()


def print_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that span the components of distinct prints."""
    keys = prints.mapInPandas(tidy(keyed), "print bigint, key bigint")
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    usual = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "print")
    few = usual.mapInPandas(tidy(linked), "a bigint, b bigint")
    many = midpoints(keys.join(hot, "key", "left_semi").select("print").distinct())
    return few.unionByName(many)


def near_copies(docs: DataFrame, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, mark, print, root, component_id: one row for each row of docs.

    print is the signed fingerprint, mark a hash of the text, root the smallest
    print of the component, component_id its smallest doc_id. A null text counts
    as empty: print 0, linked like any other. Null ids are passed over in
    component_id unless there is no other. Repeated rows give repeated results;
    an empty table gives no rows; only doc_id and text are read. Exact copies
    share a print and are merged by a sum before any link is sought; a bucket of
    over ``bucket`` prints is linked through midpoints, so that nothing is lost
    and nothing is gathered.
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text")))
    rows = cut(rows.select("doc_id", F.xxhash64("text").alias("mark"), fingerprints(width)("text").alias("print")))
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(print_links(prints.select("print"), bucket))
    grouped = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(smallest, "root").select("print", "root", "component_id")
    return rows.join(of_print, "print").select("doc_id", "mark", "print", "root", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, similarity: float | None = SIMILARITY, **options) -> DataFrame:
    """docs with one row of each group of near-copies, that of the smallest doc_id; of rows alike, one.

    Documents are linked by their fingerprints and, unless similarity is None,
    by five-word shingles of at least that Jaccard similarity.
    """
    found = near_copies(docs, **options)
    if similarity is not None:
        found = _grouped_with_shingles(docs, found, similarity)
    return _first_of_groups(docs, found)


def _grouped_with_shingles(docs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """found with roots and components that shingle links join: groups of fingerprints and nodes of shingle sets are one graph."""
    nodes, links = similar_texts(docs, similarity=similarity)
    pairs = found.select("doc_id", "mark", "root").distinct()
    on = pairs["doc_id"].eqNullSafe(nodes["doc_id"]) & (pairs["mark"] == nodes["mark"])
    # A text is in one group of fingerprints and is one node: an edge between the two.
    held = pairs.join(nodes.distinct(), on).select(F.xxhash64(F.lit("print"), "root").alias("a"), F.xxhash64(F.lit("node"), "node").alias("b")).distinct()
    near = links.select(F.xxhash64(F.lit("node"), "a").alias("a"), F.xxhash64(F.lit("node"), "b").alias("b"))
    roots = components(held.unionByName(near))
    own_root = F.xxhash64(F.lit("print"), "root")
    known = found.withColumn("_n", own_root).join(roots.withColumnRenamed("root", "_r"), F.col("_n") == F.col("node"), "left")
    known = cut(known.select("doc_id", "mark", "print", F.coalesce("_r", "_n").alias("root")))
    least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "root").select("doc_id", "mark", "print", "root", "component_id")


def _first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k"))
    wanted = first.select(F.col("k.doc_id").alias("_id"), F.col("k.mark").alias("_mark"))
    kept = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(as_text(docs["text"])) == wanted["_mark"]), "left_semi")
    # Rows alike in id and text are rare; only they are dealt out again.
    alike = found.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    same = kept["doc_id"].eqNullSafe(alike["_id"]) & (F.xxhash64(as_text(kept["text"])) == alike["_mark"])
    return kept.join(alike, same, "left_anti").unionByName(kept.join(alike, same, "left_semi").dropDuplicates(["doc_id", "text"]))
