"""Rasters as arrays (row by row) or as rows of pixels: zonal sums, majority, mosaics, surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.functions.binning import NODATA, TREE

#: Fixed value: metres from which vegetation counts as tree.
TREE_HEIGHT = 3.0


def zonal(values: Column, kind: str, nodata: float | None = None) -> Column:
    """Cover of an array of heights or of percentages, without no-data; no valid pixel gives null."""
    ok = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.lit(True) if nodata is None else v != nodata))
    total = lambda f: F.aggregate(ok, F.lit(0.0), lambda acc, v: acc + f(v))
    if kind == "height":
        top = total(lambda v: F.when(v >= TREE_HEIGHT, 100.0).otherwise(0.0))
    elif kind == "cover":
        top = total(lambda v: v.cast("double"))
    else:
        raise ValueError(f"unknown kind {kind}")
    return top / F.nullif(F.size(ok), F.lit(0))


def pooled_cover(rasters: DataFrame, key: str, values: str, nodata: float, most: float = 100.0) -> DataFrame:
    """key, cover: the mean over all rasters of a key, without no-data, nulls and values above most; 0.0 where nothing is left."""
    ok = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v != nodata) & (v <= most))
    each = rasters.select(key, ok.alias("_ok")).select(key, F.size("_ok").alias("_n"), F.aggregate("_ok", F.lit(0.0), lambda acc, v: acc + v).alias("_s"))
    sums = each.groupBy(key).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return sums.select(key, F.coalesce(F.try_divide("_s", "_n"), F.lit(0.0)).alias("cover"))


def class_shares(rasters: DataFrame, key: str, values: str, urban: list[int], nodata: int) -> DataFrame:
    """key, modal_class (of ties the smallest), urban_share: over all valid pixels of a key; null without any."""
    pixels_ = rasters.select(key, F.explode(values).alias("_v")).where(F.col("_v").isNotNull() & (F.col("_v") != nodata))
    n = pixels_.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = n.groupBy(key).agg(F.max(F.struct("_n", (-F.col("_v")).alias("_v"))).alias("_m"), (F.sum(F.when(F.col("_v").isin(urban), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("urban_share"))
    return rasters.select(key).distinct().join(found.select(key, (-F.col("_m._v")).alias("modal_class"), "urban_share"), key, "left")


def tile_statistics(tiles: DataFrame, pixel_m2: float, values: str = "values", land: str | None = None) -> DataFrame:
    """Areas and cover of each tile: land leaves out no-data and what the mask puts outside; no land gives 0 %.

    A code other than 0, 1 and no-data makes an error row.
    """
    v = F.col(values)
    inside = F.filter(v, lambda x: x != NODATA) if land is None else F.transform(F.filter(F.arrays_zip(v.alias("v"), F.col(land).alias("m")), lambda z: (z["v"] != NODATA) & z["m"]), lambda z: z["v"])
    odd = F.exists(v, lambda x: ~x.isin(0, TREE, NODATA))
    n = tiles.withColumn("_in", inside).withColumn("error", F.when(odd, F.lit("unexpected class code")))
    n = n.withColumn("_land", F.size("_in")).withColumn("_tree", F.size(F.filter("_in", lambda x: x == TREE)))
    ok = F.col("error").isNull()
    ha = lambda c: F.when(ok, c * F.lit(pixel_m2 / 10_000))
    return n.select(
        *(c for c in tiles.columns if c not in (values, land)), ha(F.size(v)).alias("tile_area_ha"), ha(F.col("_land")).alias("land_area_ha"), ha(F.col("_tree")).alias("tree_area_ha"),
        F.when(ok, F.coalesce(F.try_divide(100.0 * F.col("_tree"), F.col("_land")), F.lit(0.0))).alias("tree_cover_pct"), "error",
    )


def pixels(tiles: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """One row a pixel: key, row, col, value."""
    long = tiles.select(key, F.posexplode(values).alias("_i", "value"))
    return long.select(key, F.floor(F.col("_i") / width).cast("int").alias("row"), (F.col("_i") % width).cast("int").alias("col"), "value")


def majority(long: DataFrame, key: str, factor: int, height: int, width: int) -> DataFrame:
    """The commonest value of each full block, the smallest of ties; partial blocks at the far edges go."""
    full = long.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return full.groupBy(key, block("row"), block("col")).agg(F.mode("value", True).alias("value"))


def grid_extremes(points: DataFrame, x0: float, y0: float, size: float, nx: int, ny: int) -> DataFrame:
    """Top of all points and of ground (class 2) by cell; indices are cut towards 0 and held to the grid."""
    at = lambda c, start, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(c) - start) / size).cast("int")))
    return points.groupBy(at("y", y0, ny).alias("row"), at("x", x0, nx).alias("col")).agg(F.max("z").alias("top"), F.min(F.when(F.col("classification") == 2, F.col("z"))).alias("ground"))


def pooled_logits(long: DataFrame, key: str) -> DataFrame:
    """Mean of two logits by pixel, their class (ties: 0) and 1 - the larger softmax."""
    mean = long.groupBy(key, "row", "col").agg(F.avg("l0").alias("l0"), F.avg("l1").alias("l1"))
    gap = F.abs(F.col("l1") - F.col("l0"))
    return mean.select(key, "row", "col", F.when(F.col("l1") > F.col("l0"), 1).otherwise(0).alias("label"), (1 - 1 / (1 + F.exp(-gap))).alias("uncertainty"))


def dense(table: DataFrame, height: int, width: int, value: str) -> DataFrame:
    """A row for each cell of the grid, null where the table has none; cells outside it are dropped."""
    spark = table.sparkSession
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return grid.join(table.select("row", "col", value), ["row", "col"], "left")


def components_of(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected parts of a mask, from 1; 0 outside. Runs of a row are joined with those above by union-find."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), dtype=np.int8)
    flat[:, 1:-1] = mask
    step = np.diff(flat, axis=1)
    row, begin = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    head = list(range(len(row)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    begins, stops = begin.tolist(), stop.tolist()
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if begins[i] < stops[j] and begins[j] < stops[i]:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    number = np.unique([find(i) for i in head], return_inverse=True)[1] + 1 if head else np.zeros(0, dtype=int)
    ends = np.zeros((h, w + 1), dtype=np.int64)
    np.add.at(ends, (row, begin), number)
    np.add.at(ends, (row, stop), -number)
    return np.cumsum(ends, axis=1)[:, :w]


def without_small(mask: np.ndarray, most: int) -> np.ndarray:
    """Parts of at most so many pixels are given to the other side, background first."""
    out = mask.copy()
    for side in (False, True):
        label = components_of(out == side)
        size = np.bincount(label.ravel())
        out[(label > 0) & (size[label] <= most)] = not side
    return out


def resampled(tiles: DataFrame, key: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Area-weighted averages of an array column 'values' on another grid; equal grids are returned as they are."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low, high = edge[:-1, None], edge[1:, None]
        cell = np.arange(n)[None, :]
        return np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None) * m / n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down, across = weights(height, new_height), weights(width, new_width)
        for f in frames:
            yield pd.DataFrame({key: f[key], "values": [(down @ np.asarray(v, dtype=float).reshape(height, width) @ across.T).ravel() for v in f["values"]]})

    kind = tiles.schema[key].dataType.simpleString()
    return tiles.select(key, "values").mapInPandas(run, f"{key} {kind}, values array<double>")
