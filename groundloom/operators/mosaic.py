"""Where a tile lands in its 10 km cell, and cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixel size in metres, cell and stripe in pixels.
PIXEL, CELL, STRIPE = 0.2, 50_000, 5_000


def placement(left: Column, top: Column, width: Column, height: Column, cell_x: Column, cell_y: Column) -> Column:
    """struct of offsets in the cell and in the tile, size and trimmed; null where nothing of the tile is inside.

    Offsets are rounded half to even, the window is held to the cell and to the
    stripe of its first row.
    """
    col = F.rint((left - cell_x) / PIXEL).cast("int")
    row = F.rint((cell_y + CELL * PIXEL - top) / PIXEL).cast("int")
    zero = F.lit(0)
    col0, row0 = F.greatest(col, zero), F.greatest(row, zero)
    stripe_end = (F.floor(row0 / STRIPE) + 1) * STRIPE
    w = F.least(col + width, F.lit(CELL)) - col0
    whole = F.least(row + height, F.lit(CELL)) - row0
    h = F.least(row + height, F.lit(CELL), stripe_end) - row0
    out = F.struct(
        col0.alias("col_off"), row0.alias("row_off"), (col0 - col).alias("src_col"), (row0 - row).alias("src_row"), w.cast("int").alias("width"), h.cast("int").alias("height"),
        F.floor(row0 / STRIPE).cast("int").alias("stripe"), (whole - h).cast("int").alias("trimmed"),
    )
    return F.when((w > 0) & (h > 0), out)


def off_grid(left: Column, top: Column) -> Column:
    """The larger distance of a corner from the pixel grid, in pixels."""
    part = lambda c: F.abs(c / PIXEL - F.rint(c / PIXEL))
    return F.greatest(part(left), part(top))


def is_copyable(left: Column, top: Column, pixel_x: Column, pixel_y: Column, tolerance: float = 1e-9) -> Column:
    return (off_grid(left, top) <= 1e-6) & (F.abs(pixel_x - PIXEL) <= tolerance) & (F.abs(pixel_y - PIXEL) <= tolerance)


def cell_statistics(tiles: DataFrame, cell: str) -> DataFrame:
    """A row a cell: tiles, covered and tree area, share, states, first and last date. tiles: state, date, covered_km2, tree_km2."""
    sums = tiles.groupBy(cell).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("covered_km2").alias("covered_km2"), F.sum("tree_km2").alias("tree_km2"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return sums.withColumn("tree_pct", F.coalesce(F.try_divide(100 * F.col("tree_km2"), F.col("covered_km2")), F.lit(0.0)))


def cell_ring(x: Column, y: Column, size: float, per_edge: int = 10) -> Column:
    """A closed, densified ring of a square, as an array of [x, y]."""
    step = size / per_edge
    along = lambda fx, fy: F.transform(F.sequence(F.lit(0), F.lit(per_edge - 1)), lambda i: F.array(fx(i), fy(i)))
    low, far = F.lit(0.0), F.lit(float(size))
    ring = F.concat(
        along(lambda i: x + i * step, lambda i: y + low), along(lambda i: x + far, lambda i: y + i * step),
        along(lambda i: x + far - i * step, lambda i: y + far), along(lambda i: x + low, lambda i: y + far - i * step),
    )
    return F.concat(ring, F.array(F.array(x + low, y + low)))


def feature(ring: Column, properties: list[str], digits: int | None = None) -> Column:
    """A GeoJSON feature as text."""
    points = ring if digits is None else F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, digits)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))
