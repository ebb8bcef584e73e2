"""Windows of rasters kept as flat arrays: cutting, thinning, resampling, merging, masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.functions.binning import NODATA, TREE
from groundloom.operators import polygons
from groundloom.operators.raster import TREE_HEIGHT
from groundloom.operators.spatial import cells_of


def _each(height: int, width: int, at) -> Column:
    """A flat array of at(row, col) over a grid, row by row."""
    n = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.transform(n, lambda i: at(F.floor(i / width).cast("int"), (i % width).cast("int")))


def cut(values: Column, width: int, row: int, col: int, h: int, w: int) -> Column:
    """A window inside the raster, by slices of its rows."""
    return F.flatten(F.transform(F.sequence(F.lit(row), F.lit(row + h - 1)), lambda r: F.slice(values, r * width + col + 1, F.lit(w))))


def boundless(values: Column, height: int, width: int, row: int, col: int, h: int, w: int, fill) -> Column:
    """A window that may reach over the edges, filled there."""

    def at(r: Column, c: Column) -> Column:
        y, x = r + row, c + col
        return F.when((y >= 0) & (y < height) & (x >= 0) & (x < width), F.get(values, y * width + x)).otherwise(F.lit(fill))

    return _each(h, w, at)


def centre(values: Column, height: int, width: int, size: int) -> Column:
    return cut(values, width, (height - size) // 2, (width - size) // 2, size, size)


def without_halo(values: Column, height: int, width: int, halo: int) -> Column:
    return cut(values, width, halo, halo, height - 2 * halo, width - 2 * halo)


def with_halo(tiles: DataFrame, x: str, y: str, values: str, height: int, width: int, halo: int, fill) -> DataFrame:
    """x, y, values: each tile with so many pixels of its eight neighbours around it, fill where there is none.

    tiles: column x and row y of the mosaic (unique; rows count downwards) and
    their pixels. Each tile sends its neighbours the strips that they need, no
    whole tiles; a tile gets nine pieces at most. halo is at most a tile's side.
    """
    span = lambda side, n: (0, n) if side == 0 else (n - halo, halo) if side < 0 else (0, halo)
    pieces = []
    for i in (-1, 0, 1):  # the piece's place, seen from the tile that gets it
        for j in (-1, 0, 1):
            (row, h), (col, w) = span(j, height), span(i, width)
            pieces.append(F.struct((F.col(x) - i).alias(x), (F.col(y) - j).alias(y), F.lit(3 * j + i).alias("side"), cut(F.col(values), width, row, col, h, w).alias("piece")))
    sent = tiles.select(F.explode(F.array(*pieces)).alias("_p")).select("_p.*")
    sides = sent.join(tiles.select(x, y), [x, y], "left_semi").groupBy(x, y).agg(F.map_from_entries(F.collect_list(F.struct("side", "piece"))).alias("_m"))

    def at(r: Column, c: Column) -> Column:
        y_, x_ = r - halo, c - halo
        side = lambda v, n: F.when(v < 0, -1).when(v >= n, 1).otherwise(0)
        j, i = side(y_, height), side(x_, width)
        inner = lambda v, n, s: F.when(s < 0, v + halo).when(s > 0, v - n).otherwise(v)
        w = F.when(i == 0, width).otherwise(halo)
        return F.coalesce(F.get(F.try_element_at(F.col("_m"), 3 * j + i), (inner(y_, height, j) * w + inner(x_, width, i)).cast("int")), F.lit(fill))

    return sides.select(x, y, _each(height + 2 * halo, width + 2 * halo, at).alias(values))


def thinned(values: Column, height: int, width: int, most: int) -> Column:
    """Every n-th pixel, so that the longer side has at most so many."""
    n = -(-max(height, width) // most)
    return _each(-(-height // n), -(-width // n), lambda r, c: F.get(values, r * n * width + c * n))


def nearest(values: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """The pixel under each new pixel's centre."""
    row = lambda r: F.floor((r + 0.5) * height / new_height).cast("int")
    col = lambda c: F.floor((c + 0.5) * width / new_width).cast("int")
    return _each(new_height, new_width, lambda r, c: F.get(values, row(r) * width + col(c)))


def null_nodata(values: Column, nodata) -> Column:
    return F.transform(values, lambda v: F.nullif(v, F.lit(nodata)))


def display_class(values: Column, kind: str, nodata) -> Column:
    """Tree or not by height or by share (50 %), no-data kept as null."""
    edge = {"height": TREE_HEIGHT, "cover": 50.0}[kind]
    return F.transform(values, lambda v: F.when(v != nodata, (v >= edge).cast("int")))


def merge_pieces(pieces: DataFrame, key: str, rank: str, values: str, nodata: int = NODATA) -> DataFrame:
    """One array a key: the first piece by rank, then later ones where there is no data yet.

    A key's pieces are the rasters that cover one box, a handful.
    """
    ordered = F.array_sort(F.collect_list(F.struct(rank, values)))
    arrays = F.transform(ordered, lambda s: s[values])
    fill = F.aggregate(F.slice(F.col("_all"), 2, F.size("_all")), F.get("_all", F.lit(0)), lambda acc, p: F.zip_with(acc, p, lambda a, b: F.when(a == nodata, b).otherwise(a)))
    return pieces.groupBy(key).agg(arrays.alias("_all")).select(key, fill.alias(values))


def surface_difference(pairs: DataFrame, key: str, top_size: tuple[int, int], ground_size: tuple[int, int], nodata: float = -9999.0) -> DataFrame:
    """key, values: top minus ground, ground drawn bilinearly on top's grid; no-data of either stays no-data."""
    (h, w), (gh, gw) = top_size, ground_size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = np.clip((np.arange(h) + 0.5) * gh / h - 0.5, 0, gh - 1)[:, None]
        x = np.clip((np.arange(w) + 0.5) * gw / w - 0.5, 0, gw - 1)[None, :]
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, gh - 1), np.minimum(x0 + 1, gw - 1)
        for f in frames:
            out = []
            for top, ground in zip(f["top"], f["ground"], strict=True):
                t, g = (np.where(np.asarray(a, dtype=float) == nodata, np.nan, np.asarray(a, dtype=float)) for a in (top, ground))
                t, g = t.reshape(h, w), g.reshape(gh, gw)
                low = g[y0, x0] * (1 - (x - x0)) + g[y0, x1] * (x - x0)
                high = g[y1, x0] * (1 - (x - x0)) + g[y1, x1] * (x - x0)
                out.append(np.nan_to_num(t - (low * (1 - (y - y0)) + high * (y - y0)), nan=nodata).ravel())
            yield pd.DataFrame({key: f[key], "values": out})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "top", "ground").mapInPandas(run, f"{key} {kind}, values array<double>")


def land_masks(tiles: DataFrame, units: DataFrame, key: str, height: int, width: int, pixel: float, block: float) -> DataFrame:
    """key, status, n_land: outside, inside or partial by the pixel centres strictly inside any unit.

    tiles: key (unique) and the upper left corner (left, top); units: a key
    ``unit`` and rings, see polygons. Only tiles near a side of a unit are
    spread to pixels; of the others one centre tells. A centre in two units
    counts once.
    """
    x1, y0 = F.col("left") + width * pixel, F.col("top") - height * pixel
    boxed = tiles.select(key, "left", "top", F.explode(cells_of(F.col("left"), y0, x1, F.col("top"), block)).alias("_c")).select(key, F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"))
    border = polygons.covering(units, "unit", block).where("not inner").select("cx", "cy").distinct()
    near = boxed.join(border, ["cx", "cy"], "left_semi").select(key).distinct().withColumn("_near", F.lit(True))
    some = tiles.select(key, "left", "top").join(near, key, "left")
    n = F.when(F.col("_near"), F.sequence(F.lit(0), F.lit(height * width - 1))).otherwise(F.array(F.lit(0)))
    centres = some.select(key, "left", "top", F.coalesce("_near", F.lit(False)).alias("_near"), F.explode(n).alias("i"))
    x = F.col("left") + (F.col("i") % width + 0.5) * pixel
    y = F.col("top") - (F.floor(F.col("i") / width) + 0.5) * pixel
    held = polygons.points_in_polygons(centres.select(key, "i", "_near", x.alias("x"), y.alias("y")), units, "unit", block).select(key, "i", "_near").distinct()
    counts = held.groupBy(key).agg(F.sum(F.when(F.col("_near"), 1).otherwise(height * width)).alias("n_land"))
    out = tiles.select(key).join(counts, key, "left").withColumn("n_land", F.coalesce("n_land", F.lit(0).cast("long")))
    status = F.when(F.col("n_land") == 0, "outside").when(F.col("n_land") == height * width, "inside").otherwise("partial")
    return out.select(key, status.alias("status"), "n_land")


def stripe_counts(placed: DataFrame, cell: str, stripe: str, values: str) -> DataFrame:
    """Covered and tree pixels by cell and stripe; a tile with another code is left out and counted."""
    bad = F.exists(values, lambda v: ~v.isin(0, TREE, NODATA))
    n = lambda test: F.sum(F.when(~F.col("_bad"), F.size(F.filter(values, test))).otherwise(0)).cast("long")
    return placed.withColumn("_bad", bad).groupBy(cell, stripe).agg(n(lambda v: v != NODATA).alias("covered"), n(lambda v: v == TREE).alias("tree"), F.count_if("_bad").alias("n_skipped"))


def usable_patches(patches: DataFrame, values: str, min_cover: float, max_nodata: float) -> DataFrame:
    """patches with cover and no-data share, kept within the limits; a patch without valid pixels goes."""
    n, none = F.size(values), F.size(F.filter(values, lambda v: v == NODATA))
    tree = F.size(F.filter(values, lambda v: (v != NODATA) & (v != 0)))
    out = patches.withColumn("tree_cover_pct", F.try_divide(100.0 * tree, n - none)).withColumn("nodata_share", none / n)
    return out.where((F.col("tree_cover_pct") >= min_cover) & (F.col("nodata_share") <= max_nodata))
