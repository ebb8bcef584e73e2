"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales. Each gets an orientation from the centroid
of its patch, and a descriptor of 256 brightness tests turned by it, so that
turning, cropping and changes of brightness leave it nearly as it was. The
descriptor is cut into four words of 64 bits, each a key of a Hamming table:
descriptors with at most three differing bits share a key. Corners of two images
under one key are a match, and a pair of images is a copy where enough matches
agree on one turn, scale and shift. Every pair is judged: images are dealt to
blocks, and a task matches two blocks, a bounded number of matches at a time; the
pairs with enough matches are judged together. Links are counted and united where
they are found, so that one row an image leaves a task, however many links it has.
Matches are quadratic in the images, as keys of plain corners are common, but
memory and rows aren't. Classes are the connected components of
such pairs. Images alike byte by byte are one image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from groundloom.llm.common import cut, kept, tidy
from groundloom.llm.components import components

SCALES, RADIUS, BITS, WORDS = (1.0, 2**-0.5, 0.5), 7, 256, 4
SHARPNESS, VOTES, BATCH = 0.02, 6, 64
POINTS = "image bigint, n bigint, spots binary, keys binary"
TURNS = 1024
#: Corners of a block of images; matches that a task judges, and that it counts, at once; pairs of images that it counts them for.
BLOCK, MATCHES, COUNTED, PAIRS = 1 << 19, 1 << 17, 1 << 17, 1 << 20
#: So many blocks are made of fewer corners too, if each gets 1 / PARTS**2 of a block, that the pairs of a large group are judged in several tasks.
PARTS = 4


def tests() -> np.ndarray:
    """The pairs of points compared, within the radius: drawn once from a fixed seed."""
    draw = np.random.default_rng(7).normal(0, RADIUS / 2, (8 * BITS, 2, 2))
    inside = (np.hypot(draw[..., 0], draw[..., 1]) <= RADIUS).all(axis=1)
    return draw[inside][:BITS]


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, for a stack of images."""
    n, h, w = images.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    rows = images[:, y0] * (1 - fy) + images[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _box(a: np.ndarray, r: int = 1) -> np.ndarray:
    """Means over squares of side 2 r + 1, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = sum(np.take(p, range(i, i + n), axis=axis) for i in range(2 * r + 1)) / (2 * r + 1)
    return a


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """image, row, column of local maxima of the Harris measure, away from the border."""
    edge = RADIUS + 2
    if min(images.shape[1:]) <= 2 * edge:
        none = np.empty(0, dtype=int)
        return none, none, none
    dy, dx = np.gradient(images, axis=(1, 2))
    xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
    sharp = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = sharp[:, edge:-edge, edge:-edge]
    most = inner.max(axis=(1, 2), keepdims=True)
    peak = (inner > SHARPNESS * most) & (inner > 1e-3)
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            if (a, b) != (0, 0):
                near = sharp[:, edge + a : sharp.shape[1] - edge + a, edge + b : sharp.shape[2] - edge + b]
                peak &= (inner > near) if (a, b) > (0, 0) else (inner >= near)
    i, y, x = np.nonzero(peak)
    return i, y + edge, x + edge


def spot(x: np.ndarray, y: np.ndarray, scale: int, angle: np.ndarray) -> np.ndarray:
    """A corner as one number: place in quarter pixels (20 bits each), scale and angle."""
    quarter = lambda v: np.rint(4 * v).astype(np.int64)
    return quarter(x) | quarter(y) << 20 | scale << 40 | (np.rint(angle * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS) << 44


def unpacked(spots: np.ndarray) -> tuple[np.ndarray, ...]:
    x, y = (spots & 0xFFFFF) / 4, (spots >> 20 & 0xFFFFF) / 4
    return x, y, np.array(SCALES)[spots >> 40 & 0xF], (spots >> 44) * (2 * np.pi / TURNS)


def described(images: np.ndarray, pairs: np.ndarray) -> Iterator[tuple]:
    """(image, spot, words) arrays for each scale, in the coordinates of the full size."""
    n, h, w = images.shape
    side = np.arange(-RADIUS, RADIUS + 1)
    disk = (side[:, None] ** 2 + side[None, :] ** 2 <= RADIUS**2).astype(float)
    for scale in SCALES:
        sh, sw = round(h * scale), round(w * scale)
        smooth = _box(images if scale == 1 else resized(images, sh, sw))
        i, y, x = corners(smooth)
        if not len(i):
            continue
        patch = smooth[i[:, None, None], y[:, None, None] + side[None, :, None], x[:, None, None] + side[None, None, :]] * disk
        angle = np.arctan2((patch * side[None, :, None]).sum(axis=(1, 2)), (patch * side[None, None, :]).sum(axis=(1, 2)))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(pairs[None, ..., 0] * cos - pairs[None, ..., 1] * sin).astype(int) + x[:, None, None]
        py = np.rint(pairs[None, ..., 0] * sin + pairs[None, ..., 1] * cos).astype(int) + y[:, None, None]
        light = smooth[i[:, None, None], py, px]
        bits = np.packbits(light[..., 0] < light[..., 1], axis=1, bitorder="little")
        yield i, spot((x + 0.5) / scale, (y + 0.5) / scale, SCALES.index(scale), angle), bits.view("<u8")


def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row an image: its corners, and the WORDS keys of each."""
    pairs = tests()
    for f in frames:
        for (h, w), part in f.groupby(["height", "width"]):
            for at in range(0, len(part), BATCH):
                some = part.iloc[at : at + BATCH]
                stack = np.stack([np.frombuffer(p, dtype=np.uint8).reshape(h, w) for p in some["pixels"]]).astype(float)
                found = list(described(stack, pairs))
                if not found:
                    continue
                i, spots, words = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(i, kind="stable")
                i, spots, keys = i[order], spots[order], words[order] ^ SALT[None, :]  # a word meets only words of its place
                which, begin = np.unique(i, return_index=True)
                stop = [*begin[1:], len(i)]
                out = [(len(spots[a:b]), spots[a:b].tobytes(), keys[a:b].tobytes()) for a, b in zip(begin, stop, strict=True)]
                yield pd.DataFrame(out, columns=["n", "spots", "keys"]).assign(image=some["image"].to_numpy()[which])[["image", "n", "spots", "keys"]]


SALT = np.random.default_rng(11).integers(0, 1 << 63, WORDS, dtype=np.uint64)


def agreement(pair: np.ndarray, p: np.ndarray, q: np.ndarray, votes: int) -> np.ndarray:
    """The pairs where one turn, scale and shift takes votes corners or more, four pixels apart, from p to q. pair, p, q: one match each, in any order."""
    good = [np.empty(0, dtype=np.int64)]
    _, pair_no = np.unique(pair, return_inverse=True)
    for half in (0.0, 0.5):  # two grids, so that what agrees isn't cut by an edge of both
        turn = (np.floor(((q >> 44) - (p >> 44)) * (2 * np.pi / TURNS) / (np.pi / 8) + half) % 16).astype(np.int64)
        grow = STEPS[half][p >> 40 & 0xF, q >> 40 & 0xF]
        cell = (pair_no * 16 + turn) * 16 + grow
        # Few matches agree on turn and scale by chance, so that the others are hardly looked at.
        some = np.flatnonzero(np.bincount(cell)[cell] >= votes)
        if not len(some):
            continue
        px, py, ps, pa = unpacked(p[some])
        qx, qy, qs, qa = unpacked(q[some])
        cos, sin = np.cos(qa - pa) * (ps / qs), np.sin(qa - pa) * (ps / qs)
        dx, dy = (np.floor(d / 12 + half).astype(np.int64) for d in (qx - (px * cos - py * sin), qy - (px * sin + py * cos)))
        of = numbered(cell[some], dx, dy)
        often = np.flatnonzero(np.bincount(of)[of] >= votes)
        of, place = of[often], ((px[often] // 4).astype(np.int64) << 18 | (py[often] // 4).astype(np.int64))
        once = distinct(of << 36 | place) >> 36  # each place of a cell once
        enough = np.bincount(once, minlength=int(of.max(initial=-1)) + 1) >= votes
        good.append(pair[some[often[enough[of]]]])
    return distinct(np.concatenate(good))


def distinct(values: np.ndarray) -> np.ndarray:
    """In order; sorted integers are faster here than np.unique, which hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row."""
    out = columns[0]
    for c in columns[1:]:
        c = c - c.min(initial=0)
        wide = int(c.max(initial=0)) + 1
        if int(out.max(initial=0)) >= (1 << 62) // wide:
            out = np.unique(out, return_inverse=True)[1]
        out = out * wide + c
    return np.unique(out, return_inverse=True)[1]


#: By grid: the step, of half octaves, between the scales of two corners; one found at a smaller scale is larger.
STEPS = {half: (np.floor(np.log2(np.divide.outer(SCALES, SCALES)) / 0.5 + half) + 8).astype(np.int64) for half in (0.0, 0.5)}


def entries(block: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """index of the image, spot, key: one for each word of each corner of a block's images, by key and image."""
    n = block["n"].to_numpy()
    spots, keys = (np.frombuffer(b"".join(block[c]), dtype=np.int64) for c in ("spots", "keys"))
    i, spots = np.repeat(np.arange(len(n)), n * WORDS), np.repeat(spots, WORDS)
    order = np.lexsort((i, keys))
    return i[order], spots[order], keys[order]


def linked(left: pd.DataFrame, right: pd.DataFrame | None, votes: int) -> Iterator[tuple[int, int]]:
    """The pairs of images of two blocks, or of one (right: None), with enough agreeing matches."""
    ids, others = (f["image"].to_numpy() for f in (left, left if right is None else right))
    for a, b in met(left, right, votes):
        for u, v in zip(ids[a].tolist(), others[b].tolist(), strict=True):
            yield max(u, v), min(u, v)


def tied(left: pd.DataFrame, right: pd.DataFrame | None, votes: int) -> pd.DataFrame:
    """image, n_links, least: of each image linked in two blocks, or in one, the number of these links, and the smallest image they reach."""
    ids = np.concatenate([f["image"].to_numpy() for f in (left, right) if f is not None])
    order = np.argsort(ids)
    rank, shift = np.argsort(order), 0 if right is None else len(left)
    n_links, least = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for a, b in met(left, right, votes):
        a, b = rank[a], rank[b + shift]
        n_links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        least = united(least, a, b)
    some = np.flatnonzero(n_links)
    return pd.DataFrame({"image": ids[order][some], "n_links": n_links[some], "least": ids[order][least[some]]})


def united(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each number reaches, after a and b are joined pair by pair. least: the same before."""
    least = least.copy()
    while True:
        a, b = least[a], least[b]
        apart = a != b
        if not apart.any():
            return least
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]


def met(left: pd.DataFrame, right: pd.DataFrame | None, votes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked images of two blocks, or of one, each pair once, as numbers of rows of left and of right. Some images of left at a time meet all of right."""
    same, right = right is None, left if right is None else right
    ids, others = left["image"].to_numpy(), right["image"].to_numpy()
    i, p, key = entries(left)
    j, q, ordered = (i, p, key) if same else entries(right)
    low, high = (np.searchsorted(ordered, key, side) for side in ("left", "right"))
    if same:  # each pair of images once: the entries of the key's later images
        ends = np.flatnonzero(np.concatenate([(key[1:] != key[:-1]) | (i[1:] != i[:-1]), [True]])) + 1
        low = ends[np.searchsorted(ends, np.arange(len(key)), "right")]
    n = high - low
    order = np.argsort(i, kind="stable")
    order = order[n[order] > 0]
    i, p, low, n = i[order], p[order], low[order], n[order]
    total, first = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(i, np.arange(len(ids) + 1))
    held: list[tuple[np.ndarray, ...]] = []
    at = 0

    def judged() -> tuple[np.ndarray, np.ndarray]:
        pair, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        return np.divmod(agreement(pair, x, y, votes), len(others))

    while at < len(ids):
        to = int(np.searchsorted(total[first], total[first[at]] + COUNTED, "right")) - 1
        to = max(at + 1, min(to, at + PAIRS // len(others)))
        a, b = first[at], first[to]
        two = np.arange(total[a], total[b]) + np.repeat(low[a:b] - total[a:b], n[a:b])
        pair = j[two] + np.repeat((i[a:b] - at) * len(others), n[a:b])
        common = np.bincount(pair, minlength=(to - at) * len(others)) >= votes
        if common.any():
            hit = np.flatnonzero(common[pair])
            x, y, pair = np.repeat(p[a:b], n[a:b])[hit], q[two[hit]], pair[hit]
            swap = ids[at + pair // len(others)] > others[pair % len(others)]
            held.append((pair + at * len(others), np.where(swap, y, x), np.where(swap, x, y)))
            if sum(len(h[0]) for h in held) > MATCHES:
                yield judged()
        at = to
    if held:
        yield judged()


def blocks(images: DataFrame, block: int) -> GroupedData:
    """The corners of images, by pairs of blocks (_i, _j); _m: the block of a row. images: image, height, width, pixels (8 bits a pixel, row by row)."""
    found = images.mapInPandas(tidy(points), POINTS).groupBy("image").agg(*(F.first(c).alias(c) for c in ("n", "spots", "keys")))  # repeated images once
    found = kept(found, "corners")
    size = found.agg(F.sum("n")).first()[0] or 1
    n = max(-(-size // block), min(PARTS, -(-size * PARTS**2 // block)))
    mine, other = F.pmod(F.xxhash64("image"), F.lit(n)).cast("int"), F.col("_o")
    dealt = found.withColumn("_m", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"_i": F.least("_m", other), "_j": F.greatest("_m", other)})
    return dealt.select("_i", "_j", "_m", "image", "n", "spots", "keys").repartition(2 * n * (n + 1), "_i", "_j").groupBy("_i", "_j")


def sides(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None] | None:
    """The blocks of a task; of one block, the second is None. None where one of two is empty, so that nothing meets."""
    i, j = f["_i"].iloc[0], f["_j"].iloc[0]
    left, right = f[f["_m"] == i], None if i == j else f[f["_m"] == j]
    return None if left.empty or (right is not None and right.empty) else (left, right)


def image_links(images: DataFrame, votes: int = VOTES, block: int = BLOCK) -> DataFrame:
    """a, b (b < a): all linked images, whose number grows with the square of a class. images: as in blocks.

    Each pair of blocks is one task; block: the corners of one, more or less.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        pairs = linked(*both, votes) if (both := sides(f)) else iter(())
        return pd.DataFrame(sorted(tidy(lambda x: x)(pairs)), columns=["a", "b"], dtype="int64")

    return blocks(images, block).applyInPandas(run, "a bigint, b bigint")


def image_ties(images: DataFrame, votes: int = VOTES, block: int = BLOCK) -> DataFrame:
    """image, n_links, least: at most one row for each image and pair of blocks, of all its links there; least: the smallest image they reach there.

    The links of an image are the sum of its rows, and the classes of links those of (image, least).
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: np.empty(0, dtype=np.int64) for c in ("image", "n_links", "least")})
        (out,) = tidy(iter)([tied(*both, votes) if (both := sides(f)) else none])
        return out

    return blocks(images, block).applyInPandas(run, "image bigint, n_links bigint, least bigint")


def image_copies(images: DataFrame, votes: int = VOTES) -> DataFrame:
    """image_id, n_links, class_id: one row for each row of images (image_id, height, width, pixels).

    class_id is the smallest image_id of the class, n_links the number of other
    distinct images an image is linked with. A null or ill-sized image, or one
    without corners, is a class of its own with its exact copies. Null ids are
    passed over in class_id. Repeated rows give repeated results; an empty table
    gives no rows; other columns are not read.
    """
    good = F.coalesce(F.length("pixels") == F.col("height") * F.col("width"), F.lit(False))
    rows = images.select("image_id", F.xxhash64("height", "width", "pixels").alias("image"), "height", "width", F.when(good, F.col("pixels")).alias("pixels"))
    ids = rows.groupBy("image").agg(F.min("image_id").alias("least"))
    ties = cut(image_ties(rows.where(F.col("pixels").isNotNull()), votes))  # copies of one image give the same corners again
    degree = ties.groupBy("image").agg(F.sum("n_links").alias("n_links"))
    roots = components(ties.select(F.col("image").alias("a"), F.col("least").alias("b")))
    grouped = ids.join(roots, ids["image"] == roots["node"], "left").select("image", "least", F.coalesce("root", "image").alias("root"))
    of_root = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    of_image = grouped.join(of_root, "root").join(degree, "image", "left").select("image", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return rows.select("image_id", "image").join(of_image, "image").select("image_id", "n_links", "class_id")


def from_vectors(vector: Column, side: int = 8, size: int = 64) -> Column:
    """A picture of a vector of side x side values: each value a smooth patch, least to greatest as black to white."""

    @F.pandas_udf("binary")
    def draw(vectors: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        good = [i for i, v in enumerate(vectors) if v is not None and len(v) == side * side and not any(x is None or x != x for x in v)]
        for at in range(0, len(good), BATCH):
            some = good[at : at + BATCH]
            stack = np.stack([np.asarray(vectors.iloc[i], dtype=float).reshape(side, side) for i in some])
            low, high = stack.min(axis=(1, 2), keepdims=True), stack.max(axis=(1, 2), keepdims=True)
            shade = (stack - low) / np.where(high > low, high - low, 1)
            for i, p in zip(some, np.rint(255 * resized(shade, size, size)).astype(np.uint8), strict=True):
                out[i] = p.tobytes()
        return pd.Series(out, dtype=object)

    return draw(vector)
