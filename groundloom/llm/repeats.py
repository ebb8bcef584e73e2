"""Suffix-array removal of long repeats, over a sparse, distributed suffix array.

A byte goes if a string of ``least`` (400) bytes that covers it starts anywhere
else too. Sorting every suffix of the corpus isn't needed: of each window of
least - GRAM + 1 places, the one whose GRAM-byte string has the smallest hash is
an anchor (the last of equal ones). Equal strings of ``least`` bytes hold the
same anchor at the same offset, so it is enough to compare what lies around
anchors with equal grams, up to least bytes to the right and least - GRAM to the
left.

Runs of many words that other documents have, which may be shorter than that, are
counted by words (passages).

1. Anchors are emitted with hashes of their gram and of what lies around them.
   A sum with map-side combine merges those alike: what lies around an anchor
   twice is a repeat as a whole, and one of them stands for all.
2. Of grams with several surroundings, those are fetched, and Spark sorts them
   by gram and right side: a suffix array of the anchors. A scan with a stack
   builds the tree of common-prefix intervals from the lengths of common
   prefixes. In each interval, left sides that differ are told apart by the
   longest left extension each member shares with another: extension and prefix
   of least bytes or more together are a repeat, for every member concerned.
3. The results go back to all anchors alike, and from there to the documents.

A gram with over ``group`` surroundings isn't scanned in one task: sides are cut
to what they share, by sums of hashes, so that what lies in one passage is
alike; then windows are counted by hash, to the same result.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, kept, own, tidy
from groundloom.llm.passages import WORDS, passages, runs

LEAST, GRAM = 400, 100
#: A passage has over PASSAGE_WORDS words, and so PASSAGE bytes or more.
PASSAGE_WORDS = WORDS - 1
PASSAGE = 2 * WORDS - 1
#: Surroundings of one gram that one task scans (700 bytes each).
GROUP = 20_000
#: Texts that a worker describes at a time.
SLICE = 1024
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Anchors:
    """Anchors of byte strings: places and gram hashes."""

    def __init__(self, least: int, gram: int):
        self.least, self.gram = least, gram
        self.up, self.down = _powers(BLOCK + least)
        self.low = np.uint64((1 << 21) - 1)

    def chosen(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window of least bytes, and the hashes of all grams."""
        n, g, w = len(data), self.gram, self.least - self.gram + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[g:] - sums[:-g]) * self.down[: n - g + 1]
        for shift in (32, 29):  # the hash by itself leaves its low bits weak
            h ^= h >> np.uint64(shift)
            h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least = (h & ~self.low) | (self.low - np.arange(len(h), dtype=np.uint64))
        size = 1
        while size < w:
            step = min(size, w - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        return (self.low - (least & self.low)).astype(np.int64), h

    def block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, h = self.chosen(data)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        return at, h[at]

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n < self.least:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        view = np.frombuffer(data, dtype=np.uint8)
        parts = []
        for begin in range(0, n - self.least + 1, BLOCK):
            at, h = self.block(view[begin : begin + BLOCK + self.least - 1])
            parts.append((at + begin, h))
        at, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = np.concatenate([[True], at[1:] != at[:-1]])
        return at[keep], h[keep]


FOUND = "doc_id bigint, mark bigint, at bigint, gram bigint, around bigint"


def anchors(least: int, gram: int):
    """FOUND: the anchors of strings of least bytes or more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, before = Anchors(least, gram), least - gram
        digest = xxhash.xxh3_64_intdigest
        for whole in frames:
            for begin in range(0, len(whole), SLICE):
                f = whole.iloc[begin : begin + SLICE]
                rows, ats, grams, around = [], [], [], []
                for i, text in enumerate(f["text"]):
                    data = text.encode()
                    at, h = find.of(data)
                    rows.append(np.full(len(at), i))
                    ats.append(at)
                    grams.append(h)
                    around += [digest(data[max(0, p - before) : p + least], min(p, before)) for p in at.tolist()]
                if not around:
                    continue
                i = np.concatenate(rows)
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].astype("Int64").to_numpy()[i] if f["doc_id"].isna().any() else f["doc_id"].to_numpy()[i].astype(np.int64),
                        "mark": f["mark"].to_numpy()[i],
                        "at": np.concatenate(ats),
                        "gram": np.concatenate(grams).view(np.int64),
                        "around": np.array(around, dtype=np.uint64).view(np.int64),
                    }
                )

    return run


def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts are compressed before they are shuffled."""
    tool = zstandard.ZstdCompressor(level=3)
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "mark": f["mark"], "text": [tool.compress(t.encode()) for t in f["text"]]})


def sides(least: int, gram: int):
    """gram, around, before (reversed), after: what lies around the wanted anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdDecompressor()
        for f in frames:
            out = []
            for text, wanted in zip(f["text"], f["wanted"], strict=True):
                data = tool.decompress(text)
                out += [(w["gram"], w["around"], data[max(0, w["at"] - least + gram) : w["at"]][::-1], data[w["at"] : w["at"] + least]) for w in wanted]
            yield pd.DataFrame(out, columns=["gram", "around", "before", "after"])

    return run


def _matrix(parts, width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width), sizes


def _common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each interval of a suffix array; lcp[i] is that of rows i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, 0]):
        begin = i
        while stack and stack[-1][0] > value:
            prefix, begin = stack.pop()
            yield prefix, begin, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, begin))


def _by_left(left: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of their left sides, the place of each row, and the common prefixes of neighbours in that order."""
    if (left != 0).all():
        order = np.lexsort((sizes, left.view(f"S{left.shape[1]}").ravel()))
    else:  # the padding byte occurs
        order = np.array(sorted(range(len(left)), key=lambda i: left[i, : sizes[i]].tobytes()))
    rank = np.empty(len(left), dtype=np.int64)
    rank[order] = np.arange(len(left))
    return order, rank, _common(left[order][1:], left[order][:-1], sizes[order][1:], sizes[order][:-1])


def repeats_of_group(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, least: int, gram: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, left extension, common prefix) of each maximal repeat around one gram; rows are sorted by right side.

    Inside each interval of the tree, the left sides make a tree of their own:
    its intervals are sets of rows that differ to the left of their extension.
    A set that agrees beyond the prefix belongs to a deeper interval.
    """
    lcp = _common(right[1:], right[:-1], n_right[1:], n_right[:-1])
    _, rank, near = _by_left(left, n_left)
    for prefix, first, last in intervals(lcp.tolist(), gram):
        rows = np.arange(first, last + 1)
        rows = rows[np.argsort(rank[rows])]
        at = rank[rows]
        gaps = [int(near[a:b].min()) for a, b in zip(at, at[1:], strict=False)]
        need = max(0, least - prefix)
        found = list(intervals(gaps, max(need, 1)))
        if need == 0 and min(gaps) == 0:
            found.append((0, 0, len(rows) - 1))
        for extension, i, j in found:
            some = np.sort(rows[i : j + 1])
            if lcp[some[0] : some[-1]].min() == prefix:
                yield some, extension, prefix


def reaches(lcp: list[int], rank: list[int], near: list[int], limits: tuple[int, ...], gram: int) -> list[tuple[list[int], list[int]]]:
    """For each limit, how far repeats of at least that many bytes reach to the left and right of each row.

    lcp: common prefixes of neighbours in the suffix array; rank: each row's
    place in the order of left sides; near: common prefixes of neighbours in
    that order. Intervals of the tree are joined from the longest prefix down,
    the smaller into the larger. A row's longest left extension within an
    interval is that of its neighbours by rank, so only rows that get a new
    neighbour are looked at: n log n in all, whatever the shape of the tree.
    """
    n = len(rank)
    table = [near]
    while 1 << len(table) <= len(near):
        half = 1 << (len(table) - 1)
        table.append([min(x, y) for x, y in zip(table[-1], table[-1][half:], strict=False)])

    def extension(a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return min(table[k][a], table[k][b - (1 << k)])

    row_of = [0] * n
    for row, r in enumerate(rank):
        row_of[r] = row
    out = [([0] * n, [0] * n) for _ in limits]
    inside = [[r] for r in rank]
    for prefix, i in sorted(((v, i) for i, v in enumerate(lcp) if v >= gram), reverse=True):
        small, large = sorted((inside[i], inside[i + 1]), key=len)
        for r in small:
            at = bisect.bisect(large, r)
            for other in large[max(at - 1, 0) : at + 1]:
                left = extension(min(r, other), max(r, other))
                for (to_left, to_right), limit in zip(out, limits, strict=True):
                    if left + prefix >= limit:
                        for k in (row_of[r], row_of[other]):
                            to_left[k], to_right[k] = max(to_left[k], left), max(to_right[k], prefix)
            large.insert(at, r)
        for r in small:
            inside[row_of[r]] = large
    return out


def scan_group(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, limits: tuple[int, ...], gram: int) -> list[tuple[list[int], list[int]]]:
    """reaches() of the rows of one gram, which are sorted by right side."""
    lcp = _common(right[1:], right[:-1], n_right[1:], n_right[:-1])
    _, rank, near = _by_left(left, n_left)
    return reaches(lcp.tolist(), rank.tolist(), near.tolist(), limits, gram)


def scan(least: int, gram: int):
    """gram, around, l, r: frames come sorted by gram and right side; a gram may go on in the next frame."""

    def groups(f: pd.DataFrame) -> pd.DataFrame:
        key = f["gram"].to_numpy()
        left, n_left = _matrix(f["before"], least - gram)
        right, n_right = _matrix(f["after"], least)
        reach = np.zeros((2, len(f)), dtype=np.int64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(edge)
        a = edge[:-1][sizes == 2]
        b = a + 1
        two_r = _common(right[a], right[b], n_right[a], n_right[b])
        two_l = _common(left[a], left[b], n_left[a], n_left[b])
        good = (two_l + two_r >= least) & (two_r >= gram)
        for side in (a[good], b[good]):
            reach[0, side], reach[1, side] = two_l[good], two_r[good]
        for at, n in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            s = slice(at, at + n)
            reach[:, s] = scan_group(left[s], n_left[s], right[s], n_right[s], (least,), gram)[0]
        hit = reach[1] > 0
        return pd.DataFrame({"gram": key[hit], "around": f["around"].to_numpy()[hit], "l": reach[0, hit], "r": reach[1, hit]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            key = f["gram"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last == 0 and held and held[-1]["gram"].iloc[-1] == key[-1]:
                held.append(f)
                continue
            held.append(f.iloc[:last])
            yield groups(pd.concat(held))
            held = [f.iloc[last:]]
        if held:
            yield groups(pd.concat(held))

    return run


def name_repeats(least: int, gram: int):
    """gram, around, l, r, group: the maximal repeats around each gram, one group at a time."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("after", key=lambda c: c.map(bytes))
        left, n_left = _matrix(f["before"], least - gram)
        right, n_right = _matrix(f["after"], least)
        around, out = f["around"].to_numpy(), []
        name = lambda i, l, r: xxhash.xxh3_64_intdigest(left[i, :l][::-1].tobytes() + right[i, :r].tobytes()) - (1 << 63)  # noqa: E731, E741
        for rows, l, r in repeats_of_group(left, n_left, right, n_right, least, gram):  # noqa: E741
            out += [(f["gram"].iloc[0], around[k], l, r, name(rows[0], l, r)) for k in rows]
        # What lies around an anchor twice or more is a repeat as a whole.
        for k in np.flatnonzero(f["n"].to_numpy() > 1):
            out.append((f["gram"].iloc[0], around[k], n_left[k], n_right[k], name(k, n_left[k], n_right[k])))
        return pd.DataFrame(out, columns=["gram", "around", "l", "r", "group"]).astype("int64")

    return run


def tried(step: int, most: int):
    """gram, around, right, size, hash: the next longer sides of each row, in steps, up to where a longer step left off."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for f in frames:
            out = []
            for g, around, before, after, l, r in f[["gram", "around", "before", "after", "l", "r"]].itertuples(index=False):  # noqa: E741
                for right, side, base in ((False, before, l), (True, after, r)):
                    out += [(g, around, right, n, digest(side[:n]) - (1 << 63)) for n in range(base + step, min(len(side), base + most) + 1, step)]
            yield pd.DataFrame(out, columns=["gram", "around", "right", "size", "hash"])

    return run


def counted_sides(step: int, most: int, gram: int):
    """gram, right, size, hash, met: how many of some rows have each side, from the shortest to the longest that is tried."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for f in frames:
            f = f[["gram", "before", "after", "l", "r"]]
            for at in range(0, len(f), SLICE // 4):
                met = Counter()
                for g, before, after, l, r in f.iloc[at : at + SLICE // 4].itertuples(index=False):  # noqa: E741
                    for right, side, least, base in ((False, before, 0, l), (True, after, gram, r)):
                        met.update((g, right, n, digest(side[:n]) - (1 << 63)) for n in range(least + step, min(len(side), base + most) + 1, step))
                yield pd.DataFrame([(*k, n) for k, n in met.items()], columns=["gram", "right", "size", "hash", "met"])

    return run


def alike_sides(hot: DataFrame, gram: int) -> DataFrame:
    """gram, around, n, before, after, alike: sides cut to what any other row of the gram shares; alike names what is left.

    The longest shared length of each side is searched by sums of hashes, in
    steps of 64, 8 and 1 bytes: a longer side is shared only if a shorter one
    is. Rows that lie in one passage are then alike, however many they are.
    """
    several = F.col("n") > 1  # alike as a whole
    hot = hot.withColumns({"l": F.when(several, F.length("before")).otherwise(0), "r": F.when(several, F.length("after")).otherwise(gram)})
    before = 512
    for step in (64, 8, 1):
        key = ["gram", "right", "size", "hash"]
        each = hot.mapInPandas(tried(step, before - 1), "gram bigint, around bigint, right boolean, size int, hash bigint")
        met = hot.mapInPandas(counted_sides(step, before - 1, gram), "gram bigint, right boolean, size int, hash bigint, met bigint")
        twice, before = met.groupBy(*key).agg(F.sum("met").alias("met")).where("met > 1").select(*key), step
        longest = each.join(twice, key).groupBy("gram", "around").agg(F.max(F.when(~F.col("right"), F.col("size"))).alias("l2"), F.max(F.when(F.col("right"), F.col("size"))).alias("r2"))
        hot = hot.join(longest, ["gram", "around"], "left").select("gram", "around", "n", "before", "after", F.coalesce("l2", "l").alias("l"), F.coalesce("r2", "r").alias("r"))
        hot = kept(hot, "hot")
    left, right = F.substring("before", F.lit(1), F.col("l")), F.substring("after", F.lit(1), F.col("r"))
    return hot.select("gram", "around", "n", left.alias("before"), right.alias("after")).withColumn("alike", F.xxhash64("before", "after"))


def windows(sizes: tuple[int, ...], gram: int):
    """gram, alike, n, size, back, window: a hash for each window of size bytes that starts back bytes before the gram and has it as its anchor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors_of = {size: Anchors(size, gram) for size in sizes}
        for f in frames:
            for g, alike, n, before, after in f[["gram", "alike", "n", "before", "after"]].itertuples(index=False):
                whole, at = before[::-1] + after, len(before)
                for size in sizes:
                    if len(whole) < size:
                        continue
                    backs = (at - np.flatnonzero(anchors_of[size].chosen(np.frombuffer(whole, dtype=np.uint8))[0] == at)).tolist()
                    hashes = [xxhash.xxh3_64_intdigest(whole[at - k : at - k + size]) for k in backs]
                    yield pd.DataFrame({"gram": g, "alike": alike, "n": n, "size": size, "back": backs, "window": np.array(hashes, dtype=np.uint64).view(np.int64)})

    return run


def repeated_windows(cut_sides: DataFrame, sizes: tuple[int, ...], gram: int) -> DataFrame:
    """gram, alike, size, back, window: the windows of alike_sides() that occur twice or more."""
    shared = F.length("before") + F.length("after") >= min(sizes)
    each = cut_sides.where(shared).groupBy("gram", "alike").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("after").alias("after"))
    # Few bytes but much work, so partitions stay as many as they are.
    each = each.repartition(int(cut_sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), "alike").mapInPandas(windows(sizes, gram), WINDOWS)
    key = ["gram", "size", "back", "window"]
    twice = each.groupBy(*key).agg(F.sum("n").alias("all")).where(F.col("all") > 1).select(*key)
    return each.join(twice, key).select("alike", *key)


WINDOWS = "gram bigint, alike bigint, n bigint, size bigint, back bigint, window bigint"


def find_repeats(rows: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, mark, spans: byte ranges that repeats cover, not merged. rows: doc_id, mark, text."""
    spark = rows.sparkSession
    found = kept(rows.mapInPandas(tidy(anchors(least, gram)), FOUND), "anchors")
    one = F.min(F.struct("doc_id", "mark", "at")).alias("one")
    alike = found.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), one)
    kinds = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where(F.col("all") > 1)
    shared = kept(alike.join(kinds.select("gram", "kinds"), "gram").select("gram", "around", "n", "one.*", "kinds"), "shared")
    wanted_of = lambda some: shared.where(some).groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("of")).agg(F.collect_list(F.struct("gram", "around", "at")).alias("wanted"))
    texts = rows.mapInPandas(tidy(packed), "doc_id bigint, mark bigint, text binary")
    on = texts["doc_id"].eqNullSafe(F.col("id")) & (texts["mark"] == F.col("of"))
    # Rows alike in id and text would give the same surroundings again.
    lying = lambda wanted: texts.join(wanted, on).select("text", "wanted").mapInPandas(sides(least, gram), SIDES)
    reach = "gram bigint, around bigint, l bigint, r bigint"
    if shared.where(F.col("kinds") > group).head(1):
        lies = kept(lying(wanted_of(F.col("kinds") > 1)), "sides")
        grams = shared.where(F.col("kinds") > group).select("gram").distinct()
        few = lies.join(grams, "gram", "left_anti")
        hot = alike_sides(lies.join(grams, "gram", "left_semi").dropDuplicates(["gram", "around"]).withColumn("n", F.lit(1).cast("long")), gram)
        met = repeated_windows(hot, (least,), gram)
        of = lambda x, name: F.max(x).cast("long").alias(name)
        counted = met.groupBy("gram", "alike").agg(of(F.col("back"), "l"), of(least - F.col("back"), "r"))
        counted = hot.select("gram", "around", "alike").join(counted, ["gram", "alike"]).drop("alike")
    else:
        few, counted = lying(wanted_of(F.col("kinds") > 1)), spark.createDataFrame([], reach)
    scanned = few.repartition("gram").sortWithinPartitions("gram", "after").mapInPandas(tidy(scan(least, gram)), reach)
    all_of_it = {"l": least - gram, "r": least}
    whole = shared.where("n > 1").select("gram", "around", *(F.lit(n).cast("long").alias(c) for c, n in all_of_it.items()))
    farthest = scanned.unionByName(counted).unionByName(whole).groupBy("gram", "around").agg(*(F.max(c).alias(c) for c in all_of_it))
    # Written, so that the join's sides are plain shuffles and an anchor that very many documents share can be split.
    back = found.join(kept(farthest, "reaches"), ["gram", "around"])
    edges = {"begin": F.greatest(F.col("at") - F.col("l"), F.lit(0)), "stop": F.col("at") + F.col("r")}
    return back.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(*(c.cast("int").alias(k) for k, c in edges.items()))).alias("spans"))


SIDES = "gram bigint, around bigint, before binary, after binary"


def repeat_groups(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """group, doc_id, begin, stop (bytes): every occurrence of every maximal repeat of at least least bytes.

    A repeat is followed for least bytes to the right and least - gram to the
    left of an anchor; a longer one is a chain of overlapping groups. Around a
    gram with over ``group`` surroundings, repeats are reported as strings of exactly least bytes, so that no task gathers them. A
    report: removal needs no names of groups and uses find_repeats().
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    found = kept(rows.mapInPandas(tidy(anchors(least, gram)), FOUND), "anchors")
    one = F.min(F.struct("doc_id", "mark", "at")).alias("one")
    alike = kept(found.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), one), "alike")
    shared = alike.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > 1)
    wanted = alike.join(shared, "gram", "left_semi").select("gram", "around", "one.*").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("gram", "around", "at")).alias("wanted"))
    texts = rows.mapInPandas(tidy(packed), "doc_id bigint, mark bigint, text binary")
    on = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["mark"] == wanted["mark"])
    lying = texts.join(wanted, on).select("text", "wanted").mapInPandas(sides(least, gram), SIDES).dropDuplicates(["gram", "around"])
    lying = kept(lying.join(alike.select("gram", "around", "n"), ["gram", "around"]), "sides")
    hot = shared.where(F.col("kinds") > group).select("gram")
    named = lying.join(hot, "gram", "left_anti").groupBy("gram").applyInPandas(name_repeats(least, gram), "gram bigint, around bigint, l bigint, r bigint, group bigint")
    many = lying.join(hot, "gram", "left_semi")
    cut_sides = alike_sides(many, gram)
    pieces = cut_sides.join(repeated_windows(cut_sides, (least,), gram), ["gram", "alike"]).select("gram", "around", F.col("back").alias("l"), (least - F.col("back")).alias("r"), F.col("window").alias("group"))
    met = found.join(kept(named.unionByName(pieces), "named"), ["gram", "around"])
    return met.select("group", "doc_id", (F.col("at") - F.col("l")).alias("begin"), (F.col("at") + F.col("r")).alias("stop")).distinct()


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges that touch or overlap, joined, in order."""
    out: list[list[int]] = []
    for begin, stop in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([begin, stop])
    return out


def left_over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tool = zstandard.ZstdDecompressor()
    for f in frames:
        out = []
        for doc_id, text, spans, begins, several in zip(f["doc_id"].astype("Int64"), f["text"], f["spans"], f["begins"], f["several"], strict=True):
            data = tool.decompress(text)
            spans = spans if spans is not None else ()
            gone = merged([(s["begin"], min(s["stop"], len(data))) for s in spans if s["stop"] > s["begin"]])
            edges = [0, *(x for m in gone for x in m), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            n_passages = int(len(data.split()) >= WORDS) if several is True else runs(begins if begins is not None else (), WORDS)
            out.append((doc_id, len(data), [{"begin": a, "stop": b} for a, b in gone], rest, n_passages))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept", "n_passages"]).astype({"doc_id": "Int64"})


def drop_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans, kept, n_passages: one row for each row of docs.

    spans are the removed runs of bytes, in order; kept is what is left, as
    binary, since a run may begin or end within a character. n_passages counts
    the runs of words that strings of over PASSAGE_WORDS words cover which
    another document has too, A-Z lower-cased and whatever white space lies
    between words: such runs are reported, and bytes removed only by least. A null text counts as empty. Texts shorter
    than least are kept whole. Rows alike are documents of their own: each
    repeats the other. An empty table gives no rows; only doc_id and text are
    read; a null doc_id is a value like any other.
    """
    rows = own(docs, "doc_id", "text").withColumn("text", as_text(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    spans = find_repeats(rows, least, gram, group)
    texts = rows.mapInPandas(tidy(packed), "doc_id bigint, mark bigint, text binary")
    long = F.octet_length("text") >= PASSAGE
    met = passages(rows.where(long), texts)
    of_rows = rows.where(long).select("doc_id", "mark").distinct().join(met, "mark").select("doc_id", "mark", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "begins", "several")
    known = spans.withColumns({c: F.lit(None).cast(of_rows.schema[c].dataType) for c in ("begins", "several")}).unionByName(of_rows)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    known = known.groupBy("doc_id", "mark").agg(*map(first, ("spans", "begins", "several")))
    on = texts["doc_id"].eqNullSafe(known["doc_id"]) & (texts["mark"] == known["mark"])
    both = texts.join(known, on, "left").select(texts["doc_id"], "text", "spans", "begins", "several")
    return both.mapInPandas(tidy(left_over), "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,stop:bigint>>, kept binary, n_passages bigint")


def digest(left: DataFrame) -> DataFrame:
    removed = (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed")
    return left.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages")
