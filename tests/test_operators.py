"""Rules that the catalogue's tables don't reach: nulls, ties, edges and bad input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.operators import canopy, links, metrics, mosaic, observations, overlap, raster, sampling, spatial, stats, weighted
from groundloom.session import require_columns

TILES = "lon_c double, lat_c double, tile_area_km2 double, ours double, other double"


def tiles(spark, *rows):
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], TILES)


def test_grid_means(spark):
    t = tiles(spark, (9.9, 51.9, 1, None, None), (10.001, 52.001, 1, 10, 12), (10.002, 52.002, 1, 20, 18), (10.003, 52.003, 1, 30, 33), (10.004, 52.004, 1, 40, 37))
    got = weighted.aggregate_to_grid(t, ["ours", "other", "absent"], 1.0, 1.0, "tile_area_km2").collect()
    assert [(r.ours, r.other) for r in got] == [(25.0, 25.0)]
    t = tiles(spark, (9, 51, 1, 1, 1), (10, 52, 9, 10, None), (10, 52, 1, 90, 50))
    r = weighted.aggregate_to_grid(t, ["ours", "other"], 1.0, 1.0, "tile_area_km2").first()
    assert abs(r.ours - (90 + 90) / 10) < 1e-9 and r.other == 50


def test_totals_and_lone_tiles(spark):
    t = tiles(spark, (10, 52, 2, 50, 10))
    assert weighted.aggregate_to_grid(t, ["ours"], 1.0, 1.0, "tile_area_km2").count() == 0
    assert weighted.totals_km2(t, "ours", ["ours", "other"], "tile_area_km2").first().ours_km2 == 1.0
    t = tiles(spark, *((10, 52, 1, o, v) for o, v in ((10, 12), (20, 18), (30, 33), (None, 37))))
    assert abs(weighted.totals_km2(t, "ours", ["other"], "tile_area_km2").first().other_km2 - 0.63) < 1e-9
    with pytest.raises(KeyError, match="available"):
        weighted.totals_km2(t.drop("ours"), "ours", ["other"], "tile_area_km2")


def test_national_mean_is_a_ratio_of_sums(spark):
    u = spark.createDataFrame([("Bayern", 70000.0, 35.0, 24500.0, 30.0, 21000.0), ("Bremen", 400.0, 10.0, 40.0, 12.0, 48.0)], "unit string, unit_area_km2 double, a double, a_km2 double, b double, b_km2 double")
    r = u.agg(weighted.national_mean(u, "a").alias("m")).first()
    assert round(r.m, 2) == 34.86
    plain = u.select("a")
    assert plain.agg(weighted.national_mean(plain, "a").alias("m")).first().m == 22.5
    d = {r["product"]: r for r in weighted.difference_table(u, ["a", "b"]).collect()}
    assert d["a"].diff_pp == 0 and d["b"].diff_km2 == 21048 - 24540 and d["b"].units_with_data == 2


def test_weight_column(spark):
    df = spark.createDataFrame([(1.0,)], "tile_area_km2 double")
    assert df.select(weighted.weight_column(df)).columns == ["tile_area_km2"]
    with pytest.raises(KeyError):
        weighted.weight_column(df.select(F.lit(1).alias("x")))
    with pytest.raises(KeyError):
        require_columns(df, "x")


@pytest.mark.parametrize(
    "rows, winner", [([("20210508", "BB"), ("20230612", "MV")], "MV"), ([("20210508", "BB"), ("00000000", "MV")], "BB"), ([("20210508", "BB"), ("20210508", "MV")], "MV")]
)
def test_newest_wins(spark, rows, winner):
    df = spark.createDataFrame([(1, d, s, f"{s}.tif") for d, s in rows] + [(None, "x", "ZZ", "odd.tif")], "cell int, date string, state string, name string")
    got = {r.cell: r for r in overlap.newest_per_cell(df, ["cell"]).collect()}
    assert got[1].state == winner and got[1].n_rejected == 1 and got[None].n_rejected == 0


def test_confusion_of_nothing_is_perfect(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 5, 0, 5), (2, 1, 1, 6)], "tp long, fp long, fn long, tn long")
    none, wrong, some = df.select(*metrics.metrics()).collect()
    assert none.iou == none.f1 == none.precision == none.recall == none.accuracy == 1.0 and none.reference_cover_pct == 0
    assert wrong.iou == 0 and wrong.recall == 1.0 and some.iou == 0.5 and some.accuracy == 0.8


def test_zero_reference(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.3), (0.0, 20.0, 0.3), (5.0, 5.0, 0.3)], "lidar_tree_cover_pct double, model_tree_cover_pct double, iou double").withColumn("accuracy", F.lit(0.5))
    got = [(r.iou, r.accuracy) for r in metrics.score_zero_reference(df).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.8), (0.3, 0.5)]
    assert metrics.score_zero_reference(df, "drop").count() == 1 and metrics.score_zero_reference(df, "keep").count() == 3
    assert metrics.score_zero_reference(df.drop("lidar_tree_cover_pct")).columns == ["model_tree_cover_pct", "iou", "accuracy"]
    with pytest.raises(ValueError):
        metrics.score_zero_reference(df, "other")


@pytest.mark.parametrize(
    "values, kind, nodata, cover",
    [([0, 1, 2.9, 3, 10, 25], "height", None, 50.0), ([3.0], "height", None, 100.0), ([2.99], "height", None, 0.0), ([0, 25, 75, 100], "cover", None, 50.0), ([80, 80, 255, 255], "cover", 255, 80.0), ([255], "cover", 255, None), ([], "cover", None, None)],
)
def test_zonal(spark, values, kind, nodata, cover):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    assert df.select(raster.zonal(F.col("v"), kind, nodata).alias("c")).first().c == cover


def test_unknown_kind():
    with pytest.raises(ValueError):
        raster.zonal(F.lit(1), "other")


def test_tile_statistics(spark):
    half = [1] * 50 + [0] * 50
    df = spark.createDataFrame([("a", half, [True] * 100), ("b", half, [i % 2 == 0 for i in range(100)]), ("c", half, [False] * 100), ("d", [4] * 100, [True] * 100), ("e", [255] * 100, [True] * 100)], "t string, values array<int>, land array<boolean>")
    got = {r.t: r for r in raster.tile_statistics(df, 100.0, land="land").collect()}
    assert (got["a"].tree_cover_pct, got["b"].tree_cover_pct, got["b"].land_area_ha) == (50.0, 50.0, 0.5)
    assert (got["c"].tree_cover_pct, got["c"].land_area_ha, got["c"].tile_area_ha, got["c"].error) == (0.0, 0.0, 1.0, None)
    assert got["d"].error and got["d"].tree_cover_pct is None and got["e"].tree_cover_pct == 0.0


def test_majority_ties_and_edges(spark):
    df = spark.createDataFrame([(1, [1, 0, 1, 1, 0, 1, 0, 0, 1])], "t int, v array<int>")
    got = raster.majority(raster.pixels(df, "t", "v", 3), "t", 2, 3, 3).collect()
    assert [(r.row, r.col, r.value) for r in got] == [(0, 0, 0)]


def test_small_parts_change_sides():
    mask = np.zeros((8, 8), bool)
    mask[1:7, 1:7] = True
    mask[3, 3] = False
    mask[0, 0] = True
    out = raster.without_small(mask, 2)
    assert out[3, 3] and not out[0, 0] and out.sum() == 36
    assert len(set(raster.components_of(np.eye(3, dtype=bool)).ravel()) - {0}) == 3


def test_canopy(spark):
    rows = [(1, r, c, 20.0 if (r, c) in ((2, 2), (2, 3), (3, 2), (3, 3), (2, 4)) else 1.0, 1.0) for r in range(8) for c in range(8)]
    got = canopy.canopy_masks(spark.createDataFrame(rows, "w int, row int, col int, top double, ground double"), "w", 8, 8, largest_hole_m2=4.0).collect()
    assert len(got) == 64 and sum(r.is_tree for r in got) == 5 and max(r.height_m for r in got) == 19.0
    none = spark.createDataFrame(rows, "w int, row int, col int, top double, ground double").limit(0)
    assert canopy.canopy_masks(none, "w", 8, 8).count() == 0


def test_resampling_keeps_the_mean(spark):
    v = np.random.default_rng(0).random(35).tolist()
    out = raster.resampled(spark.createDataFrame([(1, v)], "t int, values array<double>"), "t", 5, 7, 2, 3).first()
    assert len(out["values"]) == 6 and abs(np.mean(out["values"]) - np.mean(v)) < 1e-12


def test_points_on_a_boundary_are_outside(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 1.0, 5.0, 5.0)], "unit string, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(0.0, 1.0), (1.5, 1.5), (2.0, 1.0), (4.0, 4.0), (9.0, 9.0)], "x double, y double")
    got = sorted((r.x, r.unit) for r in spatial.points_in_boxes(points, boxes, 1.0).collect())
    assert got == [(1.5, "a"), (1.5, "b"), (4.0, "b")]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    units = spark.createDataFrame([("m", ring)], "unit string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(2.0, 0.5), (2.0, 1.0), (2.0, 3.0), (0.5, 2.0), (0.0, 2.0), (3.9, 3.0)], "x double, y double")
    assert sorted((r.x, r.y) for r in spatial.points_in_rings(points, units, 1.0).collect()) == [(0.5, 2.0), (2.0, 0.5), (3.9, 3.0)]
    flagged = spatial.flag_points(points.withColumn("id", F.monotonically_increasing_id()), "id", boxes, 1.0)
    assert flagged.count() == 6 and flagged.where("on_land").count() == 2


def test_touching_boxes(spark):
    box = lambda k, *v: (k, *map(float, v))
    a = spark.createDataFrame([box(1, 0, 0, 10, 10)], "a int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([box(1, 10, 0, 20, 10), box(2, 5, 5, 30, 30), box(3, 11, 11, 12, 12)], "b int, x0 double, y0 double, x1 double, y1 double")
    pairs = lambda **k: sorted(r.b for r in spatial.boxes_overlapping(a, b, "a", "b", 3.0, **k).collect())
    assert pairs() == [2] and pairs(closed=True) == [1, 2] and pairs(shrink=5.0) == []


OBS = [("t1", "2021-07-15"), ("t1", "2022-01-10"), ("t1", "2022-07-15"), ("t1", "2023-07-15"), ("t2", "2022-07-15")]


def test_label_source(spark):
    obs = spark.createDataFrame([(t, dt.date.fromisoformat(d), d) for t, d in OBS], "tile string, date date, path string")
    at = lambda k: sorted(r.path for r in observations.label_source(obs.where("tile = 't1'"), "tile", "date", "path", k).collect())
    assert at(1) == ["2022-07-15", "2023-07-15"] and at(0) == ["2023-07-15"] and len(at(10)) == 4


def test_border_of_a_block(spark):
    ids = [f"32{300 + e}{5800 + n}" for e in range(3) for n in range(3)]
    got = {r.tile_id: r.is_border for r in observations.border_tiles(spark.createDataFrame([(i,) for i in [*ids, "12", "abc"]], "tile_id string"), "tile_id").collect()}
    assert [i for i in got if not got[i]] == ["323015801"] and got["12"] and got["abc"]


def test_windows_and_spans(spark):
    r = spark.createDataFrame([("a", 1024, 600), ("b", 100, 600)], "k string, height int, width int")
    got = [(x.row_off, x.col_off) for x in observations.patch_windows(r, "k", 512, 512).collect()]
    assert got == [(0, 0), (512, 0)]
    for n in (100, 512, 513, 900, 5000):
        plan = observations.axis_plan(spark.createDataFrame([("a", n)], "k string, n int"), "k", "n", 512, 384).orderBy("start").collect()
        spans = [(p.inner_start, p.inner_stop) for p in plan]
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(p.start <= p.inner_start and p.inner_stop <= p.start + 512 for p in plan)


def test_pairing(spark):
    rows = [("a", "d1", "x"), ("b", "d1", "x"), ("a", "d2", "x"), ("c", "d2", "x"), ("a", None, "y"), ("b", None, "y")]
    df = spark.createDataFrame(rows, "product string, date string, tile string")
    kept, dropped = links.paired(df, "a", "b")
    assert kept.count() == 5 and [tuple(r) for r in dropped.collect()] == [("a", "d2", "x")]
    assert links.paired(df, "a", "missing")[0].count() == 6
    with pytest.raises(ValueError):
        links.assert_no_leak(spark.createDataFrame([("t", "train"), ("t", "val")], "tile_id string, split string"))


def test_expand_without_imagery(spark):
    ground = spark.createDataFrame([("a", "d0"), ("b", "d0")], "tile string, date string")
    shots = spark.createDataFrame([("a", "d1"), ("a", "d2")], "tile string, date string")
    assert sorted(map(tuple, links.expand_ground(ground, shots).collect())) == [("a", "d1", "d0"), ("a", "d2", "d0"), ("b", "d0", "d0")]


def test_draws(spark):
    rows = [(i, "B1" if i % 4 else "B2", f"f{i % 50}", i % 60 * 5000.0, i // 60 * 5000.0, "u" if i % 3 else "r") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, bin string, flight_date string, x double, y double, kind string")
    got = sampling.training_draw(df, "id", "bin", {"B1": 30, "B2": 10}, 2000.0, 3, 100).collect()
    assert sum(r.bin == "B1" for r in got) == 30 and sum(r.bin == "B2" for r in got) == 10
    flights = [rows[r.id][2] for r in got]
    assert max(map(flights.count, flights)) <= 3
    levels = [rows[r.id] for r in sampling.validation_draw(df, "id", ["bin", "kind"], 12, 500.0, 42).collect()]
    assert all(sum(x[i] == v for x in levels) >= 12 for i, v in ((1, "B1"), (1, "B2"), (5, "u"), (5, "r")))
    none = df.where("bin = 'B3'")
    assert sampling.training_draw(none, "id", "bin", {"B3": 2}, 10.0, 3, 1).count() == 0 and sampling.validation_draw(none, "id", ["bin"], 2, 10.0, 1).count() == 0


def test_draws_keep_their_distance_and_balance(spark):
    r = np.random.default_rng(4)
    orders = ["summer_then_non-summer", "non-summer_then_summer", "both"]
    rows = [(i, "ab"[i % 2], [f"d{i % 40}", f"d{i % 17}"], float(x), float(y), orders[0 if i % 10 else i // 10 % 3], [1 + i % 3] if i % 12 else [5, 6, 7, 8]) for i, (x, y) in enumerate(r.uniform(0, 900, (1500, 2)))]
    df = spark.createDataFrame(rows, "id int, s string, flight_date array<string>, x double, y double, pattern string, months array<int>")
    got = sampling.training_draw(df, "id", "s", {"a": 40, "b": 20}, 30.0, 6, 1, by_stratum=True, pattern="pattern").collect()
    assert [r.turn for r in sorted(got, key=lambda r: r.turn)] == list(range(60)) and sum(x.s == "a" for x in got) == 40
    at = np.array([rows[x.id][3:5] for x in got])
    apart = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))[np.triu_indices(60, 1)]
    assert apart.min() >= 30
    dates = [(x.s, d) for x in got for d in set(rows[x.id][2])]
    assert max(map(dates.count, dates)) <= 6
    plain = sampling.training_draw(df, "id", "s", {"a": 40, "b": 20}, 30.0, 6, 1, by_stratum=True).collect()
    behind = lambda drawn: sum(rows[x.id][5] == orders[1] for x in drawn)
    rare = lambda drawn: sum(len(rows[x.id][6]) == 4 for x in drawn)
    by_month = sampling.training_draw(df, "id", "s", {"a": 40, "b": 20}, 30.0, None, 1, months="months").collect()
    assert behind(got) > behind(plain) and rare(by_month) > rare(plain)
    dense = sampling.training_draw(df, "id", "s", {"a": 500, "b": 500}, 100.0, None, 1).collect()
    spots = np.array([rows[x.id][3:5] for x in dense])
    free = [i for i, row in enumerate(rows) if np.hypot(*(spots - row[3:5]).T).min() >= 100]
    assert not free  # it ends only when no candidate is left
    levels = sampling.validation_draw(df, "id", ["s", "pattern"], 15, 30.0, 2).collect()
    spots = np.array([rows[x.id][3:5] for x in levels])
    assert np.hypot(*(spots[:, None] - spots[None]).transpose(2, 0, 1))[np.triu_indices(len(spots), 1)].min() >= 30
    assert all(sum(rows[x.id][k] == v for x in levels) >= 15 for k, v in ((1, "a"), (1, "b"), (5, orders[0]), (5, orders[1]), (5, orders[2])))


def test_order_statistics_of_skewed_values(spark):
    r = np.random.default_rng(6)
    values = list(map(float, [*(10.0 ** r.uniform(-300, 300, 3000)), *[7.0] * 2000, 1e308, -1e308, *r.normal(0, 1e-9, 2000)]))
    df = spark.createDataFrame([("g", v, f"key{i % 3000}") for i, v in enumerate(values)] + [("h", 1.0, "x"), (None, 2.0, "y")], "g string, v double, id string").repartition(6)
    points = [0.0, 0.1, 0.37, 0.5, 0.98, 1.0]
    got = {x.g: x for x in stats.percentiles(df, "v", points, "g", fits=50).collect()}
    assert list(got["g"])[1:] == pytest.approx(list(np.quantile(values, points)), rel=1e-9)
    assert got["h"].p50 == 1 and got[None].p50 == 2
    ranks = [0, 3, 1999, 2500, 4000, 6000, len(values) - 1]
    picked = stats.rows_at_ranks(df.where("g = 'g'"), ["g"], "v", "id", lambda n: F.array(*map(F.lit, ranks)), fits=50).collect()
    assert [x.v for x in sorted(picked, key=lambda x: x._rank)] == [sorted(values)[k] for k in ranks]
    rows = stats.ranked_values(df.select("g", "v").selectExpr("struct(g) as _g", "v as _v"), df.where("g = 'g'").limit(1).selectExpr("struct(g) as _g", "4000L as _rank"), fits=50).first()
    assert rows._v == sorted(values)[4000] and rows._below == sum(v < rows._v for v in values) and rows._same == values.count(rows._v)


def brute_examples(rows, n, n_first):
    out, used = [], set()
    if len(rows) <= n:
        return sorted(x["id"] for x in rows)
    kinds = [[x for x in rows if x["u"]], [x for x in rows if not x["u"]]]
    few = min(n_first, n, len(kinds[0]))
    for pool, m in zip(kinds, (few, n - few), strict=True):
        pool = sorted(pool, key=lambda x: (x["v"], x["id"]))
        if m <= 0 or not pool:
            continue
        if m >= len(pool):
            out += pool
            used |= {x["d"] for x in pool}
            continue
        last, taken = len(pool) - 1, set()
        for i in range(m):
            target = min(last, round((i + 0.5) / m * last))
            window = [j for j in range(max(0, target - 2), min(last, target + 2) + 1) if j not in taken]
            if window:
                best = max(window, key=lambda j: (pool[j]["d"] not in used, pool[j]["c"], -abs(j - target)))
                taken.add(best)
                used.add(pool[best]["d"])
                out.append(pool[best])
    return sorted(x["id"] for x in out)


def test_examples_are_spread_and_differ_in_date(spark):
    r = np.random.default_rng(8)
    rows = [dict(g=g, id=k * 1000 + i, v=float(r.integers(0, 400)) if i % 9 else float(i), d=f"d{r.integers(0, 4)}", c=int(r.integers(0, 1000)), u=bool(r.random() < 0.3)) for k, (g, size) in enumerate((("a", 90), ("b", 4), ("c", 2), ("d", 30))) for i in range(size)]
    rows += [dict(g="a", id=9999, v=None, d="d0", c=1, u=True)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "g string, id int, v double, d string, c int, u boolean")
    got = observations.spread_examples(df, "g", "v", "id", "d", "c", 3, first="u", fits=8).collect()
    for g in "abcd":
        assert sorted(x.id for x in got if x.g == g) == brute_examples([x for x in rows if x["g"] == g and x["v"] is not None], 3, 1)


def test_draws_use_every_candidate(spark):
    # One square holds all of a stratum's candidates; only the last by hash aren't of a full flight or too near.
    rows = [(i, "B1", "full", 100.0 + i % 7, 100.0) for i in range(400)] + [(1000 + i, "B1", f"f{i}", 100.0 + 50 * i, 900.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, bin string, flight_date string, x double, y double")
    several = [sampling.training_draw(df.repartition(n), "id", "bin", {"B1": 8, "B2": 3}, 40.0, 1, 7).collect() for n in (1, 5)]
    assert len({tuple(map(tuple, x)) for x in several}) == 1
    assert sum(r.id >= 1000 for r in several[0]) == 6 and len(several[0]) == 7
    some = [sampling.validation_draw(df.repartition(n), "id", ["bin"], 7, 40.0, 7).collect() for n in (1, 4)]
    assert some[0] == some[1] and len(some[0]) == 7


def test_percentiles_and_ranks(spark):
    r = np.random.default_rng(2)
    rows = [(k, None if i % 50 == 9 else float(v), i) for k in ("a", None, "one") for i, v in enumerate(r.integers(0, 9, 1 if k == "one" else 301) ** 3)]
    rows += [("none", None, 1), ("two", 5.0, 1), ("two", 5.0, 2), ("same", 1.0, 2), ("same", 1.0, 1), ("same", 1.0, 3)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(4)
    got = {x.k: tuple(x)[1:] for x in stats.percentiles(df, "v", [0.5, 0.02, 0.98], "k", fits=8).collect()}
    for k in {x[0] for x in rows}:
        of = [x[1] for x in rows if x[0] == k and x[1] is not None]
        assert got[k] == (pytest.approx(np.quantile(of, [0.5, 0.02, 0.98])) if of else (None, None, None))
    whole = stats.percentiles(df, "v", [0.5]).first()
    assert whole.p50 == np.median([x[1] for x in rows if x[1] is not None])
    ranked = {(x.k, x.role): x.id for x in observations.best_median_worst(df, "k", "v", "id", fits=8).collect()}
    for k in {x[0] for x in rows}:
        of = sorted((-1.0 if x[1] is None else x[1], x[2]) for x in rows if x[0] == k)
        assert ranked[k, "best"] == of[-1][1]
        assert len(of) < 2 or ranked[k, "worst"] == of[0][1]
        assert len(of) < 3 or ranked[k, "median"] == of[len(of) // 2][1]
    first = overlap.first_of_each(df, ["k"], ["v", "id"]).collect()
    assert {x.k: x.id for x in first} == {k: min((-1.0 if x[1] is None else x[1], x[2]) for x in rows if x[0] == k)[1] for k in {x[0] for x in rows}}


def test_split_sizes_and_weights(spark):
    df = spark.createDataFrame([(i, "a") for i in range(100)] + [(200, "b"), (201, "b")], "id int, s string")
    n = {(r.s, r.split): r["count"] for r in sampling.stratified_split(df, "id", "s").groupBy("s", "split").count().collect()}
    assert n == {("a", "train"): 60, ("a", "val"): 20, ("a", "test"): 20, ("b", "train"): 2}
    drawn = sampling.weighted_draw(spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, w double"), "id", "w", 2000, 1)
    share = {r.id: r["count"] / 2000 for r in drawn.groupBy("id").count().collect()}
    assert sum(share.values()) == 1 and abs(share[2] - 0.75) < 0.05
    report = {r.s: r.is_short for r in sampling.draw_report(df, "s", {"a": 50, "b": 5}).collect()}
    assert report == {"a": False, "b": True}


def test_fit_of_a_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)] + [(None, 1.0)], "x double, y double")
    r = df.agg(*stats.fit("x", "y")).first()
    assert abs(r.slope - 2) < 1e-9 and abs(r.intercept - 1) < 1e-9 and abs(r.rmse) < 1e-6 and r.n == 5 and abs(r.bias - 3) < 1e-9
    assert df.limit(1).agg(*stats.fit("x", "y")).first().slope is None


def test_placement(spark):
    at = lambda l, t: spark.range(1).select(mosaic.placement(F.lit(float(l)), F.lit(float(t)), F.lit(5000), F.lit(5000), F.lit(440000.0), F.lit(5860000.0)).alias("p")).first().p  # noqa: E731, E741
    p = at(445000, 5862000)
    assert (p.col_off, p.row_off, p.width, p.height, p.stripe, p.trimmed) == (25000, 40000, 5000, 5000, 8, 0)
    p = at(439500, 5870500)
    assert (p.col_off, p.src_col, p.row_off, p.src_row, p.width, p.height) == (0, 2500, 0, 2500, 2500, 2500)
    assert at(430000, 5862000) is None
    cut = at(445000, 5861999.8)
    assert (cut.row_off, cut.height, cut.trimmed, cut.stripe) == (40001, 4999, 1, 8)
    ring = spark.range(1).select(mosaic.cell_ring(F.lit(0.0), F.lit(0.0), 100.0).alias("r")).first().r
    assert len(ring) == 41 and ring[0] == ring[-1] == [0.0, 0.0] and [100.0, 100.0] in ring


def test_boxes_alike_are_counted_without_their_pairs(spark, monkeypatch):
    met = []
    whole = spatial.boxes_overlapping
    monkeypatch.setattr(spatial, "boxes_overlapping", lambda left, right, *a, **k: met.append((left.count(), right.count())) or whole(left, right, *a, **k))
    x = F.when(F.col("id") % 2 == 0, 0.0).otherwise(50.0)
    box = lambda n, key, x: spark.range(n).select(F.col("id").alias(key), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(10.0).alias("y1"))
    right = box(70, "b", F.lit(5.0)).unionByName(box(30, "b", F.lit(10.0)))
    got = spatial.overlaps_of_boxes(box(40, "a", x), right, "a", 3.0).collect()
    assert met == [(2, 2)] and {tuple(r) for r in got} == {(k, 70, 100) for k in range(0, 40, 2)}
