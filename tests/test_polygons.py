"""Polygon joins and outlines against definitions on small, awkward shapes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from groundloom.operators import polygons

SHAPES = {
    1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (2, 8), (8, 8), (8, 2)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)], [(12, 1), (15, 3), (12, 5)]],
    2: [[(9.5, 9.5), (13, 9.5), (11, 14)]],
    3: [],
    4: None,
    5: [[(-5.25, -5.5), (-5.25, -5.5), (20.5, 21.25)]],  # a line
    6: [[(4.5, 4.5), (5.5, 4.5), (5.5, 5.5), (4.5, 5.5)]],  # on the island of 1
    7: [[(3, 3), (3.5, 3), (3.5, 3.5)]],  # in the hole of 1
}
KIND = "unit int, rings array<array<struct<x:double,y:double>>>"


def units(spark, keys=tuple(SHAPES)):
    rows = [(k, None if SHAPES[k] is None else [[(float(x), float(y)) for x, y in r] for r in SHAPES[k]]) for k in keys]
    return spark.createDataFrame(rows, KIND)


def sides(rings):
    return [(a, b) for r in rings or [] for a, b in zip(r, r[1:] + r[:1], strict=True) if a != b]


def held(x, y, rings):
    e = sides(rings)
    on = any((b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]) for a, b in e)
    return not on and sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in e) % 2 == 1


@pytest.mark.parametrize("size", [0.7, 3.0])
def test_points_meet_polygons_whatever_the_grid(spark, size):
    r = random.Random(1)
    at = [(i / 2, j / 2) for i in range(-4, 34) for j in range(-4, 32)] + [(r.uniform(-2, 17), r.uniform(-2, 16)) for _ in range(300)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(-1, None, 1.0), (0, *map(float, at[0]))], "id int, x double, y double")
    got = sorted((p.id, p.unit) for p in polygons.points_in_polygons(points, units(spark), "unit", size).collect())
    assert got == sorted((i, k) for i, (x, y) in enumerate(at) for k in SHAPES if held(x, y, SHAPES[k]))
    assert polygons.points_in_polygons(points.limit(0), units(spark).limit(0), "unit", size).count() == 0


def test_polygons_that_share_a_point(spark):
    left, right = units(spark, (1, 2, 3, 4)), units(spark, (2, 5, 6, 7)).withColumnRenamed("unit", "other")
    got = sorted(tuple(r) for r in polygons.polygons_intersecting(left, right, "unit", "other", 1.5).select("unit", "other").collect())
    assert got == [(1, 2), (1, 5), (1, 6), (2, 2), (2, 5)]
    touching = spark.createDataFrame([(8, [[(10.0, 5.0), (11.0, 5.0), (11.0, 6.0)]])], KIND.replace("unit", "other"))
    assert polygons.polygons_intersecting(left, touching, "unit", "other", 4.0).collect()[0].unit == 1


def test_flags_warn_above_a_share(spark):
    points = spark.createDataFrame([(i, 1.0 + 9 * (i % 2), 1.0) for i in range(8)], "id int, x double, y double")
    out = polygons.flag_inside(points, "id", units(spark), "unit", 2.0).collect()
    assert [r.excluded for r in sorted(out)] == [True, False] * 4 and all(r.flagged_share == 0.5 and r.is_suspect for r in out)


def area(ring):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:], strict=False)) / 2


def test_outlines_of_cells(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if not (0 < x < 4 and 0 < y < 4)]
    cells = [("a", *c) for c in ring] + [("a", 2, 2), ("a", 2, 2), ("a", 9, 9), ("a", 10, 10), (None, 0, 0), (None, 1, 0), ("b", 0, None)]
    df = spark.createDataFrame(cells, "g string, cx int, cy int")
    out = polygons.outlines(df, "g", 2.0).cache()
    got = sorted((r.g or "", r.is_hole, r.n_corners, r.perimeter, r.area) for r in out.collect())
    assert got == [("", False, 4, 12.0, 8.0), ("a", False, 4, 8.0, 4.0), ("a", False, 4, 8.0, 4.0), ("a", False, 4, 8.0, 4.0), ("a", False, 4, 40.0, 100.0), ("a", True, 4, 24.0, -36.0)]
    for r in out.collect():
        assert r.ring[0] == r.ring[-1] == min(r.ring) and len(r.ring) == r.n_corners + 1 and area(r.ring) == r.area
    whole = polygons.nested(out.where("g = 'a'"), ["g"], 2.0).collect()
    assert sorted((r.area, len(r.rings)) for r in whole) == [(4.0, 1), (4.0, 1), (4.0, 1), (64.0, 2)]
    assert polygons.outlines(df.limit(0), "g", 2.0).count() == 0


def test_outlines_of_random_cells_hold_exactly_their_cells(spark):
    r = random.Random(5)
    cells = [(k % 3, x, y) for k in range(3) for x in range(14) for y in range(14) if r.random() < 0.6]
    out = polygons.outlines(spark.createDataFrame(cells, "g int, cx int, cy int"), "g", 1.0).cache()
    rings = {}
    for row in out.collect():
        rings.setdefault(row.g, []).append([(p.x, p.y) for p in row.ring[:-1]])
    for g in range(3):
        assert {(x, y) for x in range(14) for y in range(14) if held(x + 0.5, y + 0.5, rings[g])} == {c[1:] for c in cells if c[0] == g}
    whole = polygons.nested(out, ["g"], 1.0).cache()
    assert whole.agg(F.sum("area")).first()[0] == len(cells)
    assert all(held(p.x + 1e-6, p.y + 1e-6, [[(q.x, q.y) for q in h[:-1]]]) for row in whole.collect() for h in row.rings[1:] for p in h[:1])


def test_a_long_ring_is_one(spark):
    comb = [(0, x, 0) for x in range(60)] + [(0, x, y) for x in range(0, 60, 2) for y in range(1, 4)]
    out = polygons.outlines(spark.createDataFrame(comb, "g int, cx int, cy int"), "g", 1.0).collect()
    assert [(r.area, r.n_corners) for r in out] == [(150.0, 122)]


def test_features_are_geojson(spark):
    cells = spark.createDataFrame([("a", x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "date string, cx int, cy int")
    whole = polygons.nested(polygons.outlines(cells, "date", 1.23456), ["date"], 1.23456)
    made = json.loads(whole.select(polygons.feature(F.col("rings"), ["date"], "urn:ogc:def:crs:EPSG::25832").alias("f")).first().f)
    assert made["geometry"]["type"] == "Polygon" and len(made["geometry"]["coordinates"]) == 2 and made["properties"] == {"date": "a"}
    assert made["geometry"]["coordinates"][0][0] == [0.0, 0.0] and made["crs"]["properties"]["name"].endswith("25832")


def test_a_corner_on_a_rounded_side_is_judged_by_the_shapes_own_rule(spark):
    """Corner (11.4, 48.44) lies on a diamond's side whose corners are rounded; its sides alone put it outside by 1e-16."""
    u, v, w = 6.0 + 58 * 0.09, 47.0 + 16 * 0.085, 0.02 + 12 * 0.02
    left = spark.createDataFrame([(8, [[(11.4, 48.44), (13.1, 48.54), (13.2, 49.79)]])], KIND)
    right = spark.createDataFrame([(1, u, v, w, [[(u, v - w), (u + w, v), (u, v + w), (u - w, v)]])], "other int, u double, v double, w double, rings array<array<struct<x:double,y:double>>>")
    own = lambda x, y: F.abs(x - F.col("u")) + F.abs(y - F.col("v")) < F.col("w")
    for size in (0.2, 0.02, 3.0):
        assert [r.unit for r in polygons.polygons_intersecting(left, right, "unit", "other", size, own).collect()] == [8]


def test_shapes_sharing_ground_agree_with_their_sql_where_corners_touch(spark, tmp_path):
    import duckdb

    from groundloom.plans import catalogue

    spark.createDataFrame([(8,), (12,)], "n_nationkey int").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(48073,), (90172,), (11486,)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("nation", "customer"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.ORACLES["polygons_sharing_ground"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["polygons_sharing_ground"](spark, str(tmp_path)).select("unit", "parcel").collect())
    assert (8, 48073) in want and got == want
