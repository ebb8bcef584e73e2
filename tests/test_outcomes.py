"""Outcome rows, the box service, and reports, on small tables with every way to fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.operators import observations, outcomes, overlap, sampling
from groundloom.sources import answers

RASTER = "tile long, height int, width int, values array<int>"


def test_patches_of_readable_and_unreadable_rasters(spark):
    flat = [1] * 16
    stored = spark.createDataFrame([(1, 4, 4, flat), (2, 4, 4, flat[:15]), (3, 4, 4, None), (4, 1, 4, [1] * 4), (5, 4, 4, [255] * 16), (6, 4, 4, [None] * 8 + [0, 0, 1, 1] * 2)], RASTER)
    observed = spark.createDataFrame([(k, "x") for k in (1, 2, 3, 4, 5, 6, 7, None)], "tile long, values string")
    got = outcomes.patch_outcomes(observed.drop("values"), stored, "tile", 2, 2)
    told = {}
    for r in got.collect():
        told.setdefault(r.tile, []).append((r.status, r.patch_no, r.row_off, r.col_off, r.tree_cover_pct))
    assert sorted(told[1]) == [("ok", k, k // 2 * 2, k % 2 * 2, 100.0) for k in range(4)]
    assert told[6] == [("ok", 0, 2, 0, 0.0), ("ok", 1, 2, 2, 100.0)]
    assert {k: [s[0] for s in v] for k, v in told.items() if k not in (1, 6)} == {2: ["unreadable"], 3: ["unreadable"], 7: ["unreadable"], None: ["unreadable"], 4: ["no_patch"], 5: ["no_patch"]}
    assert outcomes.patch_outcomes(observed.drop("values").limit(0), stored, "tile", 2, 2).count() == 0
    with pytest.raises(ValueError):
        outcomes.patch_outcomes(observed, stored, "tile", 2, 0)


def test_patches_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    grids = {k: rng.choice([0, 1, 255], size=(9, 11), p=[0.4, 0.4, 0.2]) for k in range(12)}
    stored = spark.createDataFrame([(k, 9, 11, g.ravel().tolist()) for k, g in grids.items()], RASTER)
    got = sorted(tuple(r) for r in outcomes.patch_outcomes(stored.select("tile"), stored, "tile", 4, 3, 45.0, 0.25).where("status = 'ok'").drop("status").collect())
    want = []
    for k, g in grids.items():
        n = 0
        for r in range(0, 6, 3):
            for c in range(0, 8, 3):
                part = g[r : r + 4, c : c + 4]
                valid = part[part != 255]
                if valid.size and 1 - valid.size / 16 <= 0.25 and 100 * (valid != 0).sum() / valid.size >= 45:
                    want.append((k, n, r, c, float(f"{100 * (valid != 0).sum() / valid.size:.2f}")))
                    n += 1
    assert len(got) == len(want) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 0.011 for a, b in zip(got, want, strict=True))


def test_predictions_become_rows_whatever_happens(spark):
    def predict(image):
        if np.isnan(image).any():
            raise ValueError("no data in the window")
        return image[:3] if image[0, 0] == 9 else image  # a result of another size

    tasks = spark.createDataFrame([(k, "s") for k in (1, 2, 3, 4, 5, 6)], "tile long, state string")
    ring = [0.0] * 16
    inner = [1.0 if i in (5, 6, 9) else 0.0 for i in range(16)]
    tiles = spark.createDataFrame([(1, inner), (2, ring[:7]), (3, [*ring[:15], float("nan")]), (4, None), (6, [9.0] + ring[1:])], "tile long, values array<double>")
    done = spark.createDataFrame([(1,), (1,)], "tile long")
    none = done.limit(0)
    got = {r.tile: r for r in outcomes.prediction_outcomes(tasks, none, tiles, "tile", predict, 2, 2, halo=1).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "error", 3: "error", 4: "unavailable", 5: "unavailable", 6: "error"}
    assert got[1].tree_cover_pct == 75.0 and got[1]["values"] == [1, 1, 1, 0] and got[1].state == "s" and "no data" in got[3].error and got[6].tree_cover_pct is None
    again = outcomes.prediction_outcomes(tasks, done, tiles, "tile", predict, 2, 2, halo=1)
    assert {r.status: r.n for r in outcomes.by_status(again).collect()} == {"skipped": 1, "error": 3, "unavailable": 2}
    assert outcomes.prediction_outcomes(tasks.limit(0), none, tiles, "tile", predict, 2, 2).count() == 0


def test_scores_of_boxes(spark):
    foot = spark.createDataFrame([(10, 1, 0), (11, 2, 1), (12, 3, None), (13, 4, 0), (14, 5, 0)], "pos long, stratum int, exclude int")
    boxes = outcomes.boxes_to_score(foot, "pos")
    assert sorted(r.sample_id for r in boxes.collect()) == [10, 12, 13, 14]
    assert [r.sample_id for r in outcomes.boxes_to_score(foot.withColumn("sample_id", F.col("pos") + 5), "pos").where("pos = 10").collect()] == [15]
    references = spark.createDataFrame([(10, [1, 0, 1, 255]), (12, [1, 1, 1, 1]), (13, [1, 1, 1]), (14, [0, 0, 0, 0])], "sample_id long, values array<int>")
    # Two rows of blocks in one column: what is missing is no tree.
    votes = [1, 1, 0, 1, 0, 0, 0, 1]
    predictions = spark.createDataFrame([(10, 4, 2, votes), (13, 4, 2, votes), (14, 4, 2, [7, *votes[1:]])], "sample_id long, height int, width int, values array<int>")
    got = {r.sample_id: r for r in outcomes.score_outcomes(boxes, references, predictions, "sample_id", 2, 2, 2).collect()}
    assert {k: r.status for k, r in got.items()} == {10: "ok", 12: "no_prediction", 13: "no_reference", 14: "unexpected_code"}
    assert (got[10].tp, got[10].fp, got[10].fn, got[10].tn) == (1, 0, 1, 1) and got[10].iou == 0.5 and got[12].iou is None and got[14].tp is None and got[10].stratum == 1


def test_reference_boxes_and_their_masks(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0, "a"), (2, 0.0, 0.0, 4.0, 4.0, "b"), (3, 50.0, 0.0, 54.0, 4.0, "c"), (4, 10.0, 10.0, 14.0, 14.0, "d"), (5, 2.5, 1.0, 2.5, 3.0, "e")], "sample long, x0 double, y0 double, x1 double, y1 double, kind string")
    lidar = spark.createDataFrame([(0.0, 0.0, 20.0, 20.0, "u"), (40.0, 0.0, 60.0, 20.0, ""), (40.0, 0.0, 60.0, 20.0, None)], "x0 double, y0 double, x1 double, y1 double, url string")
    ground = [(x + 0.5, y + 0.5, 100.0, 2) for x in range(4) for y in range(4)]
    points = spark.createDataFrame([*ground, (0.5, 3.5, 105.0, 1), (3.4, 0.4, 102.0, 1)], "x double, y double, z double, classification int")
    told, cells = outcomes.reference_outcomes(boxes, boxes.where("sample = 2"), lidar, points, "sample", 8.0)
    assert {r.sample: (r.status, r.kind) for r in told.collect()} == {1: ("ok", "a"), 2: ("cached", "b"), 3: ("no_lidar_tile", "c"), 4: ("no_points", "d"), 5: ("chm_failed", "e")}
    assert told.where("sample = 1").first().n_points == 18
    (mask,) = outcomes.reference_masks(cells, "sample", 4, 4, largest_hole_m2=0.0).collect()
    assert mask.sample == 1 and mask["values"] == [1] + [0] * 15
    empty, nothing = outcomes.reference_outcomes(boxes.limit(0), boxes, lidar, points, "sample", 8.0)
    assert empty.count() == 0 and nothing.count() == 0


def test_box_service_retries_and_gives_up(spark):
    def ask(request, attempt):
        if request["x0"] >= 2:
            raise answers.Refused("x0")
        if request["y0"] >= 1 and attempt < 3:
            raise ConnectionError("503")
        if request["x0"] >= 1:
            raise TimeoutError
        return f"{request['x0']}"

    spark.dataSource.register(answers.box_source("recorded_boxes", ask))
    read = spark.read.format("recorded_boxes").option("step", "1").option("pause", "0")
    df = read.option("bounds", "0,0,2.5,2").load()
    assert df.rdd.getNumPartitions() == 6
    got = {(r.x0, r.y0): (r.x1, r.status, r.attempts, r.body) for r in df.collect()}
    assert got == {(0, 0): (1, "ok", 1, "0.0"), (0, 1): (1, "ok", 3, "0.0"), (1, 0): (2, "unreachable", 3, None), (1, 1): (2, "unreachable", 3, None), (2, 0): (2.5, "refused", 1, None), (2, 1): (2.5, "refused", 1, None)}
    assert read.option("bounds", "0,0,0,2").load().count() == 0
    asked = answers.fetch(spark.createDataFrame([(0.0, 5.0), (0.0, 0.0)], "x0 double, y0 double"), ask, retries=2, pause=0.0)
    assert sorted((r.y0, r.status, r.attempts, r.error) for r in asked.collect()) == [(0.0, "ok", 1, None), (5.0, "unreachable", 2, "ConnectionError: 503")]
    with pytest.raises(ValueError):
        answers.fetch(asked, ask, retries=0)


def test_attempts_pause_longer_each_time(monkeypatch):
    slept = []
    monkeypatch.setattr(answers.time, "sleep", slept.append)

    def down(request, attempt):
        raise OSError("down")

    assert answers.answer(down, {}, 4, 0.5)[:2] == ("unreachable", 4) and slept == [0.5, 1.0, 1.5]


def test_reports(spark):
    tiles = spark.createDataFrame([(1, "20200101", "a", "p"), (2, "20210101", "a", "q"), (2, "00000000", "b", "r"), (3, "00000000", "a", "s"), (3, "00000000", "b", "t"), (4, "20200000", "a", "u"), (4, "20190101", "a", "v")], "cell int, date string, state string, name string")
    one = overlap.contest_summary(tiles, ["cell"]).first()
    assert (one.n_cells, one.n_contested, one.n_undated_winners, one.contested_pct) == (4, 3, 2, 75.0)
    assert tuple(overlap.contest_summary(tiles.limit(0), ["cell"]).first()) == (0, 0, 0, 0.0)
    drawn = spark.createDataFrame([([3, 4],), ([4],), ([],), (None,)], "months array<int>")
    months = {r.month: (r.n, r.share_pct) for r in sampling.months_of_draw(drawn, "months").collect()}
    assert len(months) == 12 and months[4] == (2, pytest.approx(200 / 3)) and months[1] == (0, 0.0)
    assert {r.share_pct for r in sampling.months_of_draw(drawn.limit(0), "months").collect()} == {0.0}
    assert tuple(sampling.stopped_early(drawn, {"a": 3, "b": 2}).first()) == (4, 5, True) and not sampling.stopped_early(drawn, {"a": 4}).first().stopped_early
    patches = spark.createDataFrame([(1, 1, "train"), (1, 2, "val"), (2, 3, None)], "tile_id int, obs_id int, split string")
    totals = {r.name: (r.actual, r.is_equal) for r in observations.compared_totals(patches, {"tiles": 2, "patches": 4, "train_patches": 1}).collect()}
    assert totals == {"tiles": (2, True), "patches": (3, False), "train_patches": (1, True)}
    with pytest.raises(ValueError):
        observations.compared_totals(patches, {"bytes": 1})


def test_mosaic_windows_cover_once(spark):
    sizes = [(1, 5, 7), (2, 4, 4), (3, 0, 9), (4, 1, 1), (5, None, 3)]
    got = observations.mosaic_windows(spark.createDataFrame(sizes, "mosaic int, height int, width int"), "mosaic", 4).collect()
    for key, h, w in sizes:
        seen = np.zeros((h or 0, w), int)
        for r in got:
            if r.mosaic == key:
                seen[r.row_off : r.row_off + r.height, r.col_off : r.col_off + r.width] += 1
        assert (seen == 1).all()
    assert {r.tile_id for r in got if r.mosaic == 1} == {"r0000000_c0000000", "r0000000_c0000004", "r0000004_c0000000", "r0000004_c0000004"}


def test_boxes_of_one_place_meet_the_points_once(spark, monkeypatch):
    """200 samples over 300 points: one place of points and two of boxes reach the joins, and a sample listed twice has its points once."""
    met = []
    whole = outcomes.boxes_overlapping
    monkeypatch.setattr(outcomes, "boxes_overlapping", lambda left, *a, **k: met.append(left.count()) or whole(left, *a, **k))
    at = F.when(F.col("id") % 2 == 0, 0.0).otherwise(4.0)
    boxes = spark.range(200).select(F.col("id").alias("sample"), at.alias("x0"), F.lit(0.0).alias("y0"), (at + 2).alias("x1"), F.lit(2.0).alias("y1"))
    boxes = boxes.unionByName(boxes.where("sample = 2"))
    lidar = spark.createDataFrame([(0.0, 0.0, 20.0, 20.0, "u")], "x0 double, y0 double, x1 double, y1 double, url string")
    points = spark.range(300).select(F.lit(1.5).alias("x"), F.lit(0.5).alias("y"), F.col("id").cast("double").alias("z"), (F.col("id") % 2 + 1).cast("int").alias("classification"))
    told, cells = outcomes.reference_outcomes(boxes, boxes.where("sample = 4"), lidar, points, "sample", 4.0)
    n = {(r.status, r.n_points): r["count"] for r in told.groupBy("status", "n_points").count().collect()}
    assert met == [2] and n == {("ok", 300): 100, ("cached", 0): 1, ("no_points", 0): 100}
    assert {(r.row, r.col, r.top, r.ground) for r in cells.collect()} == {(1, 1, 299.0, 1.0)} and cells.count() == 99
