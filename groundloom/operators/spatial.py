"""Spatial joins by blocking: an equi-join on grid cells, then an exact test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def cells_of(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """The grid cells that a box touches, as an array of structs."""
    at = lambda c: F.floor(c / size)
    return F.flatten(F.transform(F.sequence(at(x0), at(x1)), lambda i: F.transform(F.sequence(at(y0), at(y1)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is strictly inside a closed ring of struct(x, y); a point on the boundary isn't."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return straight & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return spans & (x < at)

    n = F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False))))
    return (n % 2 == 1) & ~F.exists(edges, on)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Inner join of points (x, y) strictly inside boxes (x0, y0, x1, y1); a point in two boxes is there twice."""
    b = boxes.withColumn("_c", F.explode(cells_of(*map(F.col, BOX), size))).select("*", "_c.*").drop("_c")
    p = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    met = p.join(b, ["cx", "cy"])
    return met.where("x > x0 and x < x1 and y > y0 and y < y1").drop("cx", "cy")


def points_in_rings(points: DataFrame, units: DataFrame, size: float) -> DataFrame:
    """points_in_boxes for units with a ring, an array of struct(x, y)."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = units.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    return points_in_boxes(points, boxed, size).where(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).drop(*BOX)


def flag_points(points: DataFrame, key: str, boxes: DataFrame, size: float, flag: str = "on_land") -> DataFrame:
    """points with a flag: whether any box holds them."""
    hits = points_in_boxes(points.select(key, "x", "y"), boxes.select(*BOX), size).select(key).distinct().withColumn(flag, F.lit(True))
    return points.join(hits, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def overlaps(a: str, b: str, closed: bool) -> Column:
    """Boxes a.x0.. and b.x0..: touching counts only if closed."""
    c = lambda t, n: F.col(f"{t}.{n}")
    less = (lambda u, v: u <= v) if closed else (lambda u, v: u < v)
    return reduce(lambda u, v: u & v, [less(c(a, "x0"), c(b, "x1")), less(c(b, "x0"), c(a, "x1")), less(c(a, "y0"), c(b, "y1")), less(c(b, "y0"), c(a, "y1"))])


def boxes_overlapping(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: float, closed: bool = False, shrink: float = 0.0, extra: list[str] | None = None) -> DataFrame:
    """left_key, right_key of overlapping boxes, and is_open if closed (they do more than touch); left is shrunk on each side; extra columns must be equal (a reference system).

    A pair that shares several cells is kept in one of them, the cell of the
    lower left corner of what they share, so no distinct is needed.
    """
    extra = extra or []
    grown = {"x0": F.col("x0") + shrink, "y0": F.col("y0") + shrink, "x1": F.col("x1") - shrink, "y1": F.col("y1") - shrink}
    block = lambda d, k: d.select(k, *BOX, *extra).withColumn("_c", F.explode(cells_of(*map(F.col, BOX), size))).select("*", "_c.*")
    a, b = block(left.withColumns(grown), left_key).alias("a"), block(right, right_key).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cx", "cy", *extra)]
    corner = lambda i, n: F.floor(F.greatest(F.col(f"a.{n}"), F.col(f"b.{n}")) / size) == F.col(f"a.{i}")
    met = a.join(b, reduce(lambda u, v: u & v, same)).where(overlaps("a", "b", closed) & corner("cx", "x0") & corner("cy", "y0"))
    return met.select(F.col(f"a.{left_key}").alias(left_key), F.col(f"b.{right_key}").alias(right_key), *([overlaps("a", "b", False).alias("is_open")] if closed else []))


def overlaps_of_boxes(left: DataFrame, right: DataFrame, left_key: str, size: float) -> DataFrame:
    """left_key, n_open, n_closed: how many boxes of right a box of left overlaps, without and with those it only touches; none: no row.

    Boxes alike meet once and count as many: pairs grow with the distinct boxes
    of both sides, not with their rows.
    """
    place = F.struct(*BOX)
    a = left.select(place.alias("_a")).distinct().select("_a", "_a.*")
    b = right.groupBy(*BOX).agg(F.count(F.lit(1)).alias("_k")).withColumn("_b", F.struct(*BOX, "_k"))
    met = boxes_overlapping(a, b, "_a", "_b", size, closed=True)
    k = F.col("_b._k")
    n = met.groupBy("_a").agg(F.sum(F.when(F.col("is_open"), k).otherwise(0)).alias("_open"), F.sum(k).alias("_closed"))
    each = left.select(left_key, place.alias("_a")).join(n, "_a")
    return each.groupBy(left_key).agg(F.sum("_open").alias("n_open"), F.sum("_closed").alias("n_closed"))
