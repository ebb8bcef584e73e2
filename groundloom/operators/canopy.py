"""Canopy heights over triangulated ground, and the tree masks made of them.

Windows are groups of a fixed size (one validation box with its buffer), so a
window fits a task; windows are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.operators.raster import TREE_HEIGHT, components_of, without_small

#: The tallest plausible canopy, the side of the minimum filter without ground (both metres), the fewest ground cells that are triangulated.
HIGHEST, FILTER, FEWEST = 100.0, 10.0, 4


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (indices, counterclockwise) of distinct points with whole coordinates; none if all lie on a line.

    Points join from left to right: each sees a stretch of the hull, which
    becomes triangles with it, and edges are flipped until no circle through a
    triangle holds another point. Whole numbers make all tests exact.
    """
    order = np.lexsort((points[:, 1], points[:, 0])).tolist()
    xy = [tuple(p) for p in points.tolist()]

    def turn(a: int, b: int, c: int) -> int:
        (ax, ay), (bx, by), (cx, cy) = xy[a], xy[b], xy[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def in_circle(a: int, b: int, c: int, d: int) -> bool:
        dx, dy = xy[d]
        (ax, ay), (bx, by), (cx, cy) = ((xy[i][0] - dx, xy[i][1] - dy) for i in (a, b, c))
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return ax * (by * cc - bb * cy) - ay * (bx * cc - bb * cx) + aa * (bx * cy - by * cx) > 0

    first = next((k for k in range(2, len(order)) if turn(order[0], order[1], order[k])), None)
    if first is None:
        return np.zeros((0, 3), dtype=int)
    apex: dict[tuple[int, int], int] = {}  # of each directed edge: what lies to its left

    def add(a: int, b: int, c: int) -> None:
        apex[a, b], apex[b, c], apex[c, a] = c, a, b

    def settle(edges: list[tuple[int, int]]) -> None:
        while edges:
            a, b = edges.pop()
            c, d = apex.get((a, b)), apex.get((b, a))
            if c is not None and d is not None and in_circle(a, b, c, d):
                del apex[a, b], apex[b, a]
                add(a, d, c)
                add(d, b, c)
                edges += [(a, d), (d, b), (b, c), (c, a)]

    line, tip = order[:first], order[first]
    if turn(line[0], line[1], tip) < 0:
        line = line[::-1]
    for a, b in zip(line, line[1:], strict=False):
        add(a, b, tip)
    settle([(b, tip) for b in line[1:-1]])
    ring = [*line, tip]
    after = dict(zip(ring, [*ring[1:], ring[0]], strict=True))
    before = {b: a for a, b in after.items()}
    last = tip
    for p in order[first + 1 :]:
        low = high = last
        fresh = []
        while turn(high, after[high], p) < 0:
            add(after[high], high, p)
            fresh.append((after[high], high))
            high = after[high]
        while turn(before[low], low, p) < 0:
            add(low, before[low], p)
            fresh.append((low, before[low]))
            low = before[low]
        after[low], before[p], after[p], before[high] = p, low, high, p
        settle(fresh)
        last = p
    return np.array([(a, b, c) for (a, b), c in apex.items() if a < b and a < c], dtype=int).reshape(-1, 3)


def ground_surface(ground: np.ndarray) -> np.ndarray:
    """A grid of ground heights (nan where unknown), filled: linear over the triangulation of known cells, the median outside their hull.

    Up to three known cells give their median everywhere, as do cells on one
    line; none gives 0. Cells in the midst of known ones bound no gap and are
    left out of the triangulation: whole squares between known cells are
    Delaunay as they are.
    """
    known = ~np.isnan(ground)
    if not known.any():
        return np.zeros(ground.shape)
    out = np.where(known, ground, np.median(ground[known]))
    if known.sum() < FEWEST or known.all():
        return out if known.sum() >= FEWEST else np.full(ground.shape, np.median(ground[known]))
    square = known[:-1, :-1] & known[1:, :-1] & known[:-1, 1:] & known[1:, 1:]
    p = np.pad(square, 1)
    edge = known & ~(p[:-1, :-1] & p[1:, :-1] & p[:-1, 1:] & p[1:, 1:])
    at = np.argwhere(edge)
    z = ground[edge]
    for t in delaunay(at):
        (r0, c0), (r1, c1), (r2, c2) = at[t].tolist()
        top, left = min(r0, r1, r2), min(c0, c1, c2)
        bottom, right = max(r0, r1, r2), max(c0, c1, c2)
        if bottom - top < 2 and right - left < 2:
            continue
        r, c = np.ogrid[top : bottom + 1, left : right + 1]
        area = (r1 - r0) * (c2 - c0) - (c1 - c0) * (r2 - r0)
        u = ((r1 - r) * (c2 - c) - (c1 - c) * (r2 - r)) / area
        v = ((r2 - r) * (c0 - c) - (c2 - c) * (r0 - r)) / area
        inside = (u >= 0) & (v >= 0) & (u + v <= 1) & ~known[top : bottom + 1, left : right + 1]
        out[top : bottom + 1, left : right + 1][inside] = (u * z[t[0]] + v * z[t[1]] + (1 - u - v) * z[t[2]])[inside]
    return out


def lowest_around(top: np.ndarray, size: int) -> np.ndarray:
    """The least of the square of so many cells around each; no-data counts as the window's least, edges end the square."""
    known = ~np.isnan(top)
    out = np.where(known, top, np.min(top[known], initial=np.inf) if known.any() else 0.0)
    for axis in (0, 1):
        wide = np.pad(out, [(size // 2,) * 2 if k == axis else (0, 0) for k in (0, 1)], constant_values=np.inf)
        out = np.lib.stride_tricks.sliding_window_view(wide, size, axis).min(-1)
    return out


def canopy(top: np.ndarray, ground: np.ndarray, resolution: float = 1.0, buffer_px: int = 0) -> np.ndarray:
    """Heights above ground, held to 0 to 100 m, without the buffer; nan where there is no return.

    Without any ground cell the terrain is a minimum filter of about 10 m, of an odd number of cells.
    """
    floor = ground_surface(ground) if (~np.isnan(ground)).any() else lowest_around(top, max(3, int(FILTER / resolution)) | 1)
    high = np.clip(top - floor, 0, HIGHEST)
    return high[buffer_px : high.shape[0] - buffer_px, buffer_px : high.shape[1] - buffer_px]


def voted(tree: np.ndarray, nodata: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts without data of at most so many cells become tree if half or more of their known neighbours are; a part without known neighbours stays."""
    label = components_of(nodata)
    size = np.bincount(label.ravel(), minlength=label.max() + 1)
    p = np.pad(label, 1)
    sides = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    at = np.where(nodata, 0, sides).reshape(4, -1)
    pairs = np.unique(np.stack([at.ravel(), np.tile(np.arange(nodata.size), 4)])[:, at.ravel() > 0], axis=1)  # a neighbour counts once a part
    n = np.bincount(pairs[0], minlength=len(size))
    trees = np.bincount(pairs[0], weights=tree.ravel()[pairs[1]], minlength=len(size))
    settled = (size <= most) & (n > 0)
    settled[0] = False
    hit = settled[label]
    return np.where(hit, (2 * trees >= n)[label], tree), nodata & ~hit


def tree_mask(high: np.ndarray, most: int, buildings: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """tree, nodata: from 3 m, holes and specks of at most so many cells closed both ways, small gaps voted, buildings taken out."""
    nodata = np.isnan(high)
    tree = np.nan_to_num(high) >= TREE_HEIGHT
    if most > 0:
        tree, nodata = voted(without_small(tree, most), nodata, most)
    if buildings is not None:
        tree = tree & ~buildings
    return tree & ~nodata, nodata


def canopy_masks(cells: DataFrame, key: str, height: int, width: int, resolution: float = 1.0, buffer_px: int = 0, largest_hole_m2: float = 10.0) -> DataFrame:
    """key, row, col, height_m, is_tree, is_nodata: one row for each cell of each window, without its buffer.

    cells: key, row, col, top, ground, and building (boolean) if footprints are
    known; a cell without a row has no return. height and width count the
    buffer. A window whose key is null is left out.
    """
    holes = int(largest_hole_m2 / resolution**2)
    burned = "building" in cells.columns

    def run(f: pd.DataFrame) -> pd.DataFrame:
        def grid(name: str) -> np.ndarray:
            out = np.full((height, width), np.nan)
            out[f["row"], f["col"]] = f[name].astype("float64")
            return out

        high = canopy(grid("top"), grid("ground"), resolution, buffer_px)
        roofs = None
        if burned:
            roofs = (grid("building") == 1)[buffer_px : height - buffer_px, buffer_px : width - buffer_px]
        tree, nodata = tree_mask(high, holes, roofs)
        r, c = np.indices(high.shape)
        return pd.DataFrame({key: f[key].iloc[0], "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "height_m": high.ravel(), "is_tree": tree.ravel(), "is_nodata": nodata.ravel()})

    kind = cells.schema[key].dataType.simpleString()
    names = [key, "row", "col", "top", "ground", *(["building"] if burned else [])]
    out = cells.where(F.col(key).isNotNull()).select(*names).groupBy(key).applyInPandas(run, f"{key} {kind}, row int, col int, height_m double, is_tree boolean, is_nodata boolean")
    return out.withColumn("height_m", F.nanvl("height_m", F.lit(None).cast("double")))
