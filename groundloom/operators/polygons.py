"""Polygons of any number of rings: joins by grid cells, and outlines of cells.

A polygon is a column ``rings``, an array of rings, each an array of
struct(x, y); a ring may leave out its last point, which closes it. What lies
within an odd number of rings is inside, so holes, islands in holes and several
parts need no marks. A polygon with null or empty rings holds nothing.

Joins cut polygons by a grid. Cells that no edge touches lie wholly inside or
outside and need no test; only in border cells points meet edges, and there
only those of their own row of cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.lineage import cut

EDGE = ("ax", "ay", "bx", "by")


def edges(units: DataFrame, key: str) -> DataFrame:
    """key, ax, ay, bx, by: one row for each side of each ring; sides without length are left out."""
    ring = units.select(F.col(key), F.explode("rings").alias("_r")).where(F.size("_r") > 1)
    turned = F.concat(F.slice("_r", F.lit(2), F.size("_r")), F.slice("_r", F.lit(1), F.lit(1)))
    side = ring.select(key, F.explode(F.arrays_zip(F.col("_r").alias("a"), turned.alias("b"))).alias("_e"))
    value = {"ax": "a.x", "ay": "a.y", "bx": "b.x", "by": "b.y"}
    out = side.select(key, *(F.col(f"_e.{v}").cast("double").alias(c) for c, v in value.items()))
    return out.where("not (ax = bx and ay = by)")


def _rows(sides: DataFrame, size: float) -> DataFrame:
    """sides with cy: each row of cells that a side touches, and perhaps a neighbour that it only comes near to."""
    row, slack = (lambda c: F.floor(c / size)), 1e-9 * size
    return sides.withColumn("cy", F.explode(F.sequence(row(F.least("ay", "by") - slack), row(F.greatest("ay", "by") + slack))))


def _cells(rows: DataFrame, size: float) -> DataFrame:
    """rows with cx: each cell of the row that the side touches, and perhaps a neighbour that it only comes near to."""
    dy = F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    at = lambda y: F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / dy
    low = F.greatest(F.least("ay", "by"), F.col("cy") * size)
    high = F.least(F.greatest("ay", "by"), (F.col("cy") + 1) * size)
    left = F.coalesce(F.least(at(low), at(high)), F.least("ax", "bx"))
    right = F.coalesce(F.greatest(at(low), at(high)), F.greatest("ax", "bx"))
    slack = 1e-9 * size
    return rows.withColumn("cx", F.explode(F.sequence(F.floor((left - slack) / size), F.floor((right + slack) / size))))


def covering(units: DataFrame, key: str, size: float) -> DataFrame:
    """key, cx, cy, inner: the cells of a grid that a polygon reaches; inner ones lie inside it and no side touches them."""
    rows = _rows(edges(units, key), size)
    border = _cells(rows, size).select(key, "cx", "cy").distinct()
    middle = (F.col("cy") + 0.5) * size
    x = F.col("ax") + (middle - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    order = Window.partitionBy(key, "cy").orderBy("x")
    crossed = rows.where((F.col("ay") > middle) != (F.col("by") > middle)).select(key, "cy", x.alias("x"))
    spans = crossed.select(key, "cy", "x", F.lead("x").over(order).alias("to"), F.row_number().over(order).alias("i")).where("i % 2 = 1")
    first, last = F.floor(F.col("x") / size) + 1, F.floor(F.col("to") / size) - 1
    inner = spans.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("cx"), "cy").join(border, [key, "cx", "cy"], "left_anti")
    return inner.withColumn("inner", F.lit(True)).unionByName(border.withColumn("inner", F.lit(False)))


def inside(x: Column, y: Column, sides: Column) -> Column:
    """Whether a point lies inside an odd number of rings, by their sides (an array of struct(ax, ay, bx, by)), and on none."""

    def on(e: Column) -> Column:
        straight = (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
        return straight & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crossed(e: Column) -> Column:
        at = e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    n = F.size(F.filter(sides, lambda e: F.coalesce(crossed(e), F.lit(False))))
    return (n % 2 == 1) & ~F.exists(sides, on)


def points_in_polygons(points: DataFrame, units: DataFrame, key: str, size: float, holds: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """points (x, y and other columns) with the key of each polygon that they lie strictly inside; a point in two is there twice.

    Points with a null coordinate, and points inside no polygon, are left out.
    units: key (unique) and rings. The sides of one polygon in one row of cells
    are one array. holds: the polygons' own test of a point (x, y) by other
    columns of units, where their corners are rounded and only it is exact; it
    stands in for the sides in border cells.
    """
    cells = covering(units, key, size)
    at = points.where("x is not null and y is not null").withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    met = at.join(cells, ["cx", "cy"])
    if holds is None:
        in_row = _rows(edges(units, key), size).groupBy(key, "cy").agg(F.collect_list(F.struct(*EDGE)).alias("_sides"))
        near = met.where("not inner").join(in_row, [key, "cy"]).where(inside(F.col("x"), F.col("y"), F.col("_sides")))
    else:
        near = met.where("not inner").join(units.drop("rings"), key).where(holds(F.col("x"), F.col("y")))
    keep = [*points.columns, key]
    return met.where("inner").select(*keep).unionByName(near.select(*keep))


def flag_inside(points: DataFrame, point_key: str, units: DataFrame, key: str, size: float, flag: str = "excluded", most: float = 0.25) -> DataFrame:
    """points with a flag, whether any polygon holds them, and flagged_share and is_suspect: that of all points, and whether it is above most."""
    hits = points_in_polygons(points.select(point_key, "x", "y"), units, key, size).select(point_key).distinct().withColumn(flag, F.lit(True))
    out = points.join(hits, point_key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    share = out.agg((F.count_if(flag) / F.count(F.lit(1))).alias("flagged_share"))
    return out.crossJoin(F.broadcast(share)).withColumn("is_suspect", F.col("flagged_share") > most)  # one row


def polygons_intersecting(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: float, right_holds: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """left_key, right_key of polygons that share a point; touching counts. Keys must be unique and named differently.

    Either sides meet in some cell, or one polygon holds a ring of the other,
    so one point of each ring tells. right_holds: as points_in_polygons() takes
    it, for right.
    """
    cells = lambda units, key, p: _cells(_rows(edges(units, key), size), size).select(key, "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in EDGE))
    met = cells(left, left_key, "l").join(cells(right, right_key, "r"), ["cx", "cy"])

    def side(p: str, q: str, point: str) -> Column:
        ax, ay, bx, by = (F.col(f"{p}{c}") for c in EDGE)
        return (bx - ax) * (F.col(f"{q}{point}y") - ay) - (by - ay) * (F.col(f"{q}{point}x") - ax)

    def apart(c: str) -> Column:
        low, high = (lambda p: F.least(f"{p}a{c}", f"{p}b{c}")), (lambda p: F.greatest(f"{p}a{c}", f"{p}b{c}"))
        return (low("l") > high("r")) | (low("r") > high("l"))

    crossing = ~apart("x") & ~apart("y") & (side("l", "r", "a") * side("l", "r", "b") <= 0) & (side("r", "l", "a") * side("r", "l", "b") <= 0)
    pairs = met.where(crossing).select(left_key, right_key)
    one = lambda units, key: units.select(key, F.explode("rings").alias("_r")).where(F.size("_r") > 0).select(key, F.get("_r", F.lit(0))["x"].alias("x"), F.get("_r", F.lit(0))["y"].alias("y"))
    held = points_in_polygons(one(left, left_key), right, right_key, size, right_holds).select(left_key, right_key)
    holds = points_in_polygons(one(right, right_key), left, left_key, size).select(left_key, right_key)
    return pairs.unionByName(held).unionByName(holds).distinct()


def outlines(cells: DataFrame, by: str, size: float) -> DataFrame:
    """by, ring_id, is_hole, n_corners, perimeter, area, ring: the outlines of each group's square cells (cx, cy), dissolved.

    Sides that two cells of a group share cancel in a sum; what is left is
    joined to straight stretches and traced by pointer doubling, so rounds grow
    with the logarithm of the longest ring. Shells run counterclockwise, holes
    clockwise, their area below zero: a group's areas add up to its cells'.
    Where cells touch at a corner only, rings part there. Rings are closed and
    begin at their least corner. Repeated cells count once; a null group is one.
    """
    one = cells.select(F.col(by), F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy")).where("cx is not null and cy is not null").distinct()
    # Sides with direction, counterclockwise: 0 east, 1 north, 2 west, 3 south; a line's sides in both directions cancel.
    corner = [(0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3)]
    sides = one.select(by, F.explode(F.array(*(F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y"), F.lit(d).alias("d")) for i, j, d in corner))).alias("_s")).select(by, "_s.*")
    way = F.when(F.col("d") < 2, 1).otherwise(-1)
    even = F.col("d") % 2 == 0
    line = sides.select(by, even.alias("flat"), F.when(F.col("d") == 2, F.col("x") - 1).otherwise(F.col("x")).alias("x"), F.when(F.col("d") == 3, F.col("y") - 1).otherwise(F.col("y")).alias("y"), way.alias("way"))
    left = line.groupBy(by, "flat", "x", "y").agg(F.sum("way").alias("way")).where("way <> 0")
    # Stretches: sides of one direction that follow each other on one line. Where four sides meet at a corner both lines end.
    along, across = F.when(F.col("flat"), F.col("x")).otherwise(F.col("y")), F.when(F.col("flat"), F.col("y")).otherwise(F.col("x"))
    left = left.select(by, "flat", "way", along.alias("u"), across.alias("v"))
    ends = left.select(by, F.explode(F.array(F.col("u"), F.col("u") + 1)).alias("u"), "v", "flat").select(by, "flat", F.when(F.col("flat"), F.col("u")).otherwise(F.col("v")).alias("x"), F.when(F.col("flat"), F.col("v")).otherwise(F.col("u")).alias("y"))
    corners = ends.groupBy(by, "x", "y").agg(F.count_if("flat").alias("_f"), F.count(F.lit(1)).alias("_n")).where("_f % 2 = 1 or _n = 4").select(by, "x", "y")
    at = corners.select(by, F.explode(F.array(F.lit(True), F.lit(False))).alias("flat"), "x", "y").select(by, "flat", F.when(F.col("flat"), F.col("x")).otherwise(F.col("y")).alias("u"), F.when(F.col("flat"), F.col("y")).otherwise(F.col("x")).alias("v"), F.lit(1).alias("_c"))
    begins = left.join(at, [left[by].eqNullSafe(at[by]), *(left[c] == at[c] for c in ("flat", "u", "v"))], "left").select(left["*"], F.coalesce("_c", F.lit(0)).alias("_c"))
    order = Window.partitionBy(by, "flat", "v").orderBy("u")
    numbered = begins.withColumn("_k", F.sum("_c").over(order))
    stretch = numbered.groupBy(by, "flat", "v", "_k").agg(F.min("u").alias("low"), (F.max("u") + 1).alias("high"), F.first("way").alias("way"))
    ahead = F.col("way") > 0
    begin, stop = F.when(ahead, F.col("low")).otherwise(F.col("high")), F.when(ahead, F.col("high")).otherwise(F.col("low"))
    point = lambda u: (F.when(F.col("flat"), u).otherwise(F.col("v")), F.when(F.col("flat"), F.col("v")).otherwise(u))
    (x0, y0), (x1, y1) = point(begin), point(stop)
    d = F.when(F.col("flat"), F.when(ahead, 0).otherwise(2)).otherwise(F.when(ahead, 1).otherwise(3))
    parts = cut(stretch.select(F.col(by), x0.alias("x"), y0.alias("y"), x1.alias("to_x"), y1.alias("to_y"), d.alias("d")).withColumn("id", F.monotonically_increasing_id()))
    start = parts.select(F.col(by).alias("_of"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("d").alias("_d"), F.col("id").alias("next"))
    found = parts.join(start, parts[by].eqNullSafe(start["_of"]) & (parts["to_x"] == start["_x"]) & (parts["to_y"] == start["_y"]))
    # Of two ways on, the one to the left keeps to the same cell.
    turn = F.when((F.col("_d") - F.col("d") + 4) % 4 == 1, 0).otherwise(1)
    linked = cut(found.groupBy("id").agg(F.min(F.struct(turn.alias("t"), "next")).alias("n")).join(parts, "id").select("id", by, "x", "y", "to_x", "to_y", "n.next"))
    ranked = _ranked(linked.select("id", "next", F.struct("x", "y", "id").alias("least")))
    whole = linked.join(ranked, "id")
    twice = F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")
    length = F.abs(F.col("to_x") - F.col("x")) + F.abs(F.col("to_y") - F.col("y"))
    corner_ = F.struct((F.col("x") * size).alias("x"), (F.col("y") * size).alias("y"))
    rings = whole.groupBy(by, F.col("root").alias("ring_id")).agg(F.count(F.lit(1)).alias("n_corners"), (F.sum(length) * size).alias("perimeter"), (F.sum(twice) * (size * size / 2)).alias("area"), F.array_sort(F.collect_list(F.struct("rank", corner_.alias("p")))).alias("_r"))
    ring = F.transform("_r", lambda s: s["p"])
    return rings.select(by, "ring_id", (F.col("area") < 0).alias("is_hole"), "n_corners", "perimeter", "area", F.concat(ring, F.slice(ring, F.lit(1), F.lit(1))).alias("ring"))


def _ranked(linked: DataFrame) -> DataFrame:
    """id, root (the id with the least of its cycle), rank (steps from it): cycles of id -> next, by pointer doubling."""
    state = cut(linked.select("id", F.col("next").alias("ptr"), "least"))
    mark = None
    while True:
        sums = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "least"))).first()
        if sums == mark or not sums[0]:
            break
        mark = sums
        other = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"))
        state = cut(state.join(other, "ptr").select("id", F.col("_ptr").alias("ptr"), F.least("least", "_least").alias("least")))
    roots = state.select("id", F.col("least.id").alias("root"))
    # Steps to go until the root, which stands still; rank counts from it.
    steps = linked.select("id", "next").join(roots, "id")
    steps = cut(steps.select("id", "root", F.when(F.col("id") == F.col("root"), F.col("id")).otherwise(F.col("next")).alias("ptr"), (F.col("id") != F.col("root")).cast("long").alias("togo")))
    while steps.where("ptr <> root").limit(1).count():
        other = steps.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("togo").alias("_togo"))
        steps = cut(steps.join(other, "ptr").select("id", "root", F.col("_ptr").alias("ptr"), (F.col("togo") + F.col("_togo")).alias("togo")))
    first = F.col("id") == F.col("root")
    return steps.select("id", "root", F.when(first, F.lit(-(1 << 62))).otherwise(-F.col("togo")).alias("rank"))


def coverage_polygons(tiles: DataFrame, zone: str, date: str, size: float) -> DataFrame:
    """zone, date and the outlines of the ground that each date is the newest for; undated (0) ranks last. tiles: zone, date, cx, cy."""
    newest = tiles.groupBy(zone, "cx", "cy").agg(F.max(date).alias(date))
    key = F.struct(F.col(zone), F.col(date))
    return outlines(newest.select(key.alias("_by"), "cx", "cy"), "_by", size).select(F.col("_by").getField(zone).alias(zone), F.col("_by").getField(date).alias(date), "ring_id", "is_hole", "n_corners", "perimeter", "area", "ring")


def nested(rings: DataFrame, by: list[str], size: float) -> DataFrame:
    """by, ring_id, area, rings of each shell of outlines() with its holes: area without them, the shell first.

    A hole belongs to the smallest shell of its group around the cell left of
    the hole's first corner. size: the cells' side.
    """
    shells = rings.where("not is_hole")
    holes = rings.where("is_hole").select(F.col("ring_id").alias("hole"), *(F.col(c).alias(f"_{c}") for c in by), F.col("area").alias("_area"), F.col("ring").alias("_ring"), (F.get("ring", F.lit(0))["x"] - size / 2).alias("x"), (F.get("ring", F.lit(0))["y"] + size / 2).alias("y"))
    around = points_in_polygons(holes.select("hole", "x", "y"), shells.select("ring_id", F.array("ring").alias("rings")), "ring_id", 4 * size)
    met = around.join(shells.select("ring_id", "area", *by), "ring_id").join(holes.drop("x", "y"), "hole")
    for c in by:
        met = met.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    owner = met.groupBy("hole").agg(F.min(F.struct("area", "ring_id")).alias("s"), F.first("_area").alias("_area"), F.first("_ring").alias("_ring"))
    gaps = owner.groupBy(F.col("s.ring_id").alias("ring_id")).agg(F.sum("_area").alias("_less"), F.collect_list("_ring").alias("_holes"))
    out = shells.join(gaps, "ring_id", "left")
    return out.select(*by, "ring_id", (F.col("area") + F.coalesce("_less", F.lit(0.0))).alias("area"), F.when(F.col("_holes").isNull(), F.array("ring")).otherwise(F.concat(F.array("ring"), F.col("_holes"))).alias("rings"))


def feature(rings: Column, properties: list[str], crs: str | None = None, digits: int = 2) -> Column:
    """A GeoJSON feature as text: a polygon of rings (the shell first), coordinates rounded; crs names the reference system."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))
    parts = [F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")]
    if crs:
        parts.append(F.struct(F.lit("name").alias("type"), F.struct(F.lit(crs).alias("name")).alias("properties")).alias("crs"))
    return F.to_json(F.struct(*parts))
