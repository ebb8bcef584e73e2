"""Outcome rows: what can't be read, scored or predicted is a row with a status in place of a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.functions.binning import NODATA, TREE
from groundloom.operators import canopy, metrics
from groundloom.operators.spatial import BOX, boxes_overlapping, cells_of


def by_status(outcomes: DataFrame, *keys: str, mean: str | None = None) -> DataFrame:
    """Rows of each status (and key), with the mean of a column over the rows that have it."""
    return outcomes.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"), *([F.avg(mean).alias(mean)] if mean else []))


def _readable(values: str, height: str, width: str) -> Column:
    return F.coalesce(F.col(values).isNotNull() & (F.size(values) == F.col(height) * F.col(width)), F.lit(False))


def _flag(df: DataFrame, key: str, other: DataFrame, name: str) -> DataFrame:
    return df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _block(values: str, width: Column, row: Column, col: Column, size: int) -> Column:
    """The pixels of a square, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice(values, ((row + i) * width + col + 1).cast("int"), F.lit(size))))


def patch_outcomes(observations: DataFrame, rasters: DataFrame, key: str, size: int, stride: int, least_cover: float = 0.0, most_nodata: float = 1.0) -> DataFrame:
    """Training patches of every observation: its columns, patch_no (from 0, row by row), row_off, col_off, tree_cover_pct, status.

    rasters: key, height, width, values. An observation whose raster is missing,
    null or not of height times width pixels is one row 'unreadable'; one that
    gives no patch (smaller than a patch, no data, too little cover) is one row
    'no_patch'. Null pixels are no data. Windows are cut inside the array, so a
    raster isn't copied for each of its windows and numbers need no sorting.
    """
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    met = observations.join(rasters.select(key, "height", "width", "values"), key, "left").withColumn("_ok", _readable("values", "height", "width"))
    count = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride).cast("int") + 1)
    met = met.withColumns({"_rows": count("height"), "_cols": count("width")})

    def window(k: Column) -> Column:
        row, col = F.floor(k / F.col("_cols")).cast("int") * stride, (k % F.col("_cols")) * stride
        valid = F.filter(_block("values", F.col("width"), row, col, size), lambda v: v != NODATA)
        return F.struct(row.alias("row_off"), col.alias("col_off"), F.size(valid).alias("valid"), F.size(F.filter(valid, lambda v: v != 0)).alias("tree"))

    whole = F.col("_ok") & (F.col("_rows") > 0) & (F.col("_cols") > 0)
    windows = F.when(whole, F.transform(F.sequence(F.lit(0), F.col("_rows") * F.col("_cols") - 1), window))
    cover = lambda w: 100.0 * w["tree"] / F.nullif(w["valid"], F.lit(0))
    good = F.filter(windows, lambda w: (w["valid"] > 0) & (1 - w["valid"] / (size * size) <= most_nodata) & (cover(w) >= least_cover))
    each = met.select(*observations.columns, "_ok", F.posexplode_outer(good).alias("patch_no", "_w"))
    status = F.when(~F.col("_ok"), "unreadable").when(F.col("patch_no").isNull(), "no_patch").otherwise("ok")
    return each.select(*observations.columns, "patch_no", "_w.row_off", "_w.col_off", F.round(cover(F.col("_w")), 2).alias("tree_cover_pct"), status.alias("status"))


def reference_outcomes(samples: DataFrame, cached: DataFrame, lidar: DataFrame, points: DataFrame, key: str, block: float, resolution: float = 1.0, buffer: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(samples with status and n_points, cells of the boxes that can be built).

    samples: key, x0, y0, x1, y1 and any strata, which are carried through;
    cached: keys with a mask; lidar: x0..y1 and url of point tiles; points: x,
    y, z, classification. The first of these holds: 'cached'; 'no_lidar_tile'
    (no tile with a url touches the box); 'no_points' in the closed buffered
    box; 'chm_failed' (the box has no width or height); 'ok'. Cells
    are key, row, col, top, ground from the buffered box's upper left corner, as
    canopy.canopy_masks() takes them. Only boxes still open reach the points,
    and boxes of one place, or points of one, do so once.
    """
    known = _flag(samples, key, cached, "_cached").withColumn("_place", F.struct(*BOX))
    # Boxes alike meet the points once, as do points alike; each sample then looks up its place.
    places = known.where("not _cached").select("_place").distinct().select("_place", "_place.*")
    hit = boxes_overlapping(places, lidar.where("url <> ''").select(*BOX, "url"), "_place", "url", block, closed=True).select("_place").distinct()
    wide = {"x0": F.col("x0") - buffer, "y0": F.col("y0") - buffer, "x1": F.col("x1") + buffer, "y1": F.col("y1") + buffer}
    blocks = hit.select("_place", "_place.*").withColumns(wide).withColumn("_c", F.explode(cells_of(*map(F.col, BOX), block))).select("_place", *BOX, "_c.*")
    spots = points.groupBy("x", "y").agg(F.max("z").alias("z"), F.min(F.when(F.col("classification") == 2, F.col("z"))).alias("_low"), F.count(F.lit(1)).alias("_k"))
    near = spots.withColumns({"cx": F.floor(F.col("x") / block), "cy": F.floor(F.col("y") / block)})
    met = near.join(blocks, ["cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    steps = lambda a, b: F.ceil((F.col(b) - F.col(a)) / resolution).cast("int")
    at = lambda c, n: F.greatest(F.lit(0), F.least(n - 1, F.floor(c / resolution).cast("int")))
    # A cell's heights come before the box's count: points are summed once, and a hot box is many cells.
    cells = met.groupBy("_place", at(F.col("y1") - F.col("y"), steps("y0", "y1")).alias("row"), at(F.col("x") - F.col("x0"), steps("x0", "x1")).alias("col")).agg(
        F.max("z").alias("top"), F.min("_low").alias("ground"), F.sum("_k").alias("_n")
    )
    n = cells.groupBy("_place").agg(F.sum("_n").alias("n_points"))
    found = hit.withColumn("_hit", F.lit(True)).join(n, "_place", "left")
    told = known.join(found, "_place", "left").withColumn("_hit", ~F.col("_cached") & F.coalesce("_hit", F.lit(False))).withColumn("n_points", F.when(F.col("_hit"), F.coalesce("n_points", F.lit(0).cast("long"))).otherwise(0))
    flat = (steps("x0", "x1") < 1) | (steps("y0", "y1") < 1)
    status = F.when(F.col("_cached"), "cached").when(~F.col("_hit"), "no_lidar_tile").when(F.col("n_points") == 0, "no_points").when(flat, "chm_failed").otherwise("ok")
    outcomes = told.withColumn("status", status)
    good = outcomes.where("status = 'ok'").select(key, "_place").distinct()
    return outcomes.select(*samples.columns, "status", "n_points"), good.join(cells, "_place").select(key, "row", "col", "top", "ground")


def reference_masks(cells: DataFrame, key: str, height: int, width: int, **options) -> DataFrame:
    """key, values: the masks of reference_outcomes()'s cells, row by row: 1 tree, 0 none, 255 no data."""
    code = F.when(F.col("is_nodata"), NODATA).otherwise(F.col("is_tree").cast("int"))
    made = canopy.canopy_masks(cells, key, height, width, **options).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "col", code.alias("v")))).alias("_v"))
    return made.select(key, F.transform("_v", lambda p: p["v"]).alias("values"))


def boxes_to_score(footprints: DataFrame, position: str) -> DataFrame:
    """footprints with sample_id (where the table has none, their position) and without those marked exclude. Ids come before the filter."""
    ids = F.col("sample_id") if "sample_id" in footprints.columns else F.col(position)
    named = footprints.withColumn("sample_id", ids.cast("long"))
    return named.where(F.coalesce(F.col("exclude").cast("int"), F.lit(0)) == 0) if "exclude" in footprints.columns else named


def on_reference_grid(values: str, height: str, width: str, factor: int, to_height: int, to_width: int) -> Column:
    """A prediction as flags of the reference's grid: whether tree is the commonest code of each full block (of ties the smallest code); missing blocks are False."""
    cols = F.floor(F.col(width) / factor).cast("int")

    def cell(k: Column) -> Column:
        row, col = F.floor(k / to_width).cast("int"), k % to_width
        block = _block(values, F.col(width), row * factor, col * factor, factor)
        n = lambda code: F.size(F.filter(block, lambda v: v == code))
        there = (row < F.floor(F.col(height) / factor)) & (col < cols)
        return F.when(there, (n(TREE) > n(0)) & (n(TREE) >= n(NODATA))).otherwise(False)

    return F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width - 1)), cell)


def score_outcomes(boxes: DataFrame, references: DataFrame, predictions: DataFrame, key: str, height: int, width: int, factor: int) -> DataFrame:
    """boxes with status, the four counts and the metrics; counts and metrics are null unless status is 'ok'.

    references: key, values (1, 0, 255) of height times width; predictions: key,
    height, width, values. The first of these holds: 'no_reference' (missing or
    of another size), 'no_prediction' (missing or of another size than it says),
    'unexpected_code' (a code that predictions never hold), 'ok'.
    """
    right = references.select(key, F.col("values").alias("_ref"))
    left = predictions.select(key, F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("values").alias("_pred"))
    met = boxes.join(right, key, "left").join(left, key, "left")
    no_reference = ~F.coalesce(F.col("_ref").isNotNull() & (F.size("_ref") == height * width), F.lit(False))
    odd = F.exists("_pred", lambda v: ~F.coalesce(v.isin(0, TREE, NODATA), F.lit(False)))
    status = F.when(no_reference, "no_reference").when(~_readable("_pred", "_h", "_w"), "no_prediction").when(odd, "unexpected_code").otherwise("ok")
    met = met.withColumn("status", status)
    pairs = F.when(F.col("status") == "ok", F.arrays_zip(F.col("_ref").alias("r"), on_reference_grid("_pred", "_h", "_w", factor, height, width).alias("p")))
    met = met.withColumn("_z", F.filter(pairs, lambda z: z["r"] != NODATA))
    n = lambda r, p: F.when(F.col("_z").isNotNull(), F.size(F.filter("_z", lambda z: ((z["r"] == TREE) == F.lit(r)) & (z["p"] == F.lit(p)))).cast("long"))
    counted = met.select(*boxes.columns, "status", n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    ok = F.col("status") == "ok"
    given = {m: F.when(ok, F.col(m)) for m in (*metrics.METRICS, "reference_cover_pct", "model_cover_pct")}
    return counted.select("*", *metrics.metrics()).withColumns(given)


def prediction_outcomes(tasks: DataFrame, done: DataFrame, tiles: DataFrame, key: str, predict: Callable[[np.ndarray], np.ndarray], height: int, width: int, halo: int = 0) -> DataFrame:
    """tasks with status, error, tree_cover_pct and values: one row for each task, whatever happens to it.

    'skipped' if done has its key, 'unavailable' if tiles has no values for it,
    'error' with its message if the tile's size is wrong or predict fails, else
    'ok'. predict takes a window of height times width pixels with a halo on
    each side and gives its classes; values and cover are of the inner window.
    Only tiles still to do are read and reach Python; an error costs its row.
    """
    high, wide, names = height + 2 * halo, width + 2 * halo, tasks.columns
    todo = tasks.join(done.select(key), key, "left_anti").join(tiles.select(key, F.col("values").alias("_v")), key, "left")

    def one(v: np.ndarray) -> tuple[str, str | None, float | None, list[int] | None]:
        try:
            if len(v) != high * wide:
                raise ValueError(f"{len(v)} pixels, not {high * wide}")
            made = np.asarray(predict(np.asarray(v, dtype="float64").reshape(high, wide)))
            if made.shape != (high, wide):
                raise ValueError(f"prediction of {made.shape}, not {(high, wide)}")
            made = made[halo : halo + height, halo : halo + width]
            return "ok", None, float(100.0 * np.count_nonzero(made == TREE) / made.size) if made.size else 0.0, made.ravel().astype(int).tolist()
        except Exception as failed:  # a tile's failure is its row
            return "error", f"{type(failed).__name__}: {failed}", None, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = pd.DataFrame([one(v) for v in f["_v"]], columns=["status", "error", "tree_cover_pct", "values"], index=f.index)
            yield pd.concat([f[names], found], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    made = todo.where(F.col("_v").isNotNull()).mapInPandas(run, f"{kinds}, status string, error string, tree_cover_pct double, values array<int>")
    blank = lambda df, status: df.select(*names, F.lit(status).alias("status"), *(F.lit(None).cast(k).alias(c) for c, k in (("error", "string"), ("tree_cover_pct", "double"), ("values", "array<int>"))))
    return made.unionByName(blank(todo.where(F.col("_v").isNull()), "unavailable")).unionByName(blank(tasks.join(done.select(key), key, "left_semi"), "skipped"))
