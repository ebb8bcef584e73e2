import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from groundloom.functions import binning as B
from groundloom.functions import dates as D
from groundloom.functions import names as N
from groundloom.functions import projection as P


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "v string" if isinstance(value, str) or value is None else "v double")
    return df.select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "name, cell",
    [("dop20rgbi_33_418_5931_bb_file_20210508_pred.tif", (33, 418, 5931)), ("a/b/x_32_001_5309.tif", (32, 1, 5309)), ("x_31_418_5931.tif", None), ("x_133_418_5931.tif", None), ("", None), (None, None)],
)
def test_cells(spark, name, cell):
    got = one(spark, name, N.cell_key)
    assert (tuple(got) if got else None) == cell


@pytest.mark.parametrize(
    "name, date", [("t_20210508_x.tif", "20210508"), ("t_20211508_20220101.tif", "20220101"), ("t_120210508.tif", None), ("t_19891231.tif", None), ("nothing", None), ("t_20210231.tif", "20210231")]
)
def test_dates_in_names(spark, name, date):
    assert one(spark, name, N.date_from_name) == date
    assert one(spark, name, lambda c: N.tile_date(c, F.lit("2020"))) == (date or "20200000")
    assert one(spark, name, N.tile_date) == (date or "00000000")


def test_undated(spark):
    assert [one(spark, d, N.is_dated) for d in ("20210508", "20200000", "00000000")] == [True, False, False]


def test_ids_and_cells(spark):
    assert one(spark, "323015801", N.id_to_key) == "32_301_5801" and one(spark, "32_301_5801", N.key_to_id) == "323015801"
    assert one(spark, "x", lambda c: N.cell_id(F.lit(33), F.lit(445), F.lit(5861))) == "UTM33_E4400_N58600"
    assert one(spark, "x", lambda c: N.cell_id(F.lit(32), F.lit(449), F.lit(5309))) == "UTM32_E4400_N53000"
    assert tuple(one(spark, "UTM33_E4400_N58600", N.parse_cell_id)) == (25833, 440000.0, 5860000.0)
    assert one(spark, "misc", N.parse_cell_id) is None
    assert one(spark, "a/UTM33_E4400_N58600/x.tif", N.cell_folder) == "UTM33_E4400_N58600" and one(spark, "x.tif", N.cell_folder) is None


def test_small_text_rules(spark):
    assert one(spark, "a_bb_file_x", N.state_from_stem) == "BB" and one(spark, "ab", N.state_from_stem) is None
    assert one(spark, "x_pred.tif", N.tile_stem) == "x" and one(spark, "x.jp2", N.tile_stem) == "x"
    assert one(spark, "x20210508y", N.date_from_stem) == "2021-05-08"
    assert one(spark, "/old/a", lambda c: N.moved(c, "/old", "/new")) == "/new/a" and one(spark, "/x", lambda c: N.moved(c, "/old", "/new")) == "/x"
    assert one(spark, " B2: 10-25", N.clean_bin_label) == "10-25"
    assert [one(spark, v, N.as_flag) for v in ("True", "0", "what", None)] == [True, False, None, None]
    assert [one(spark, float(v), N.human_size) for v in (12, 2048, 5 * 1024**3)] == ["12 B", "2.0 KB", "5.0 GB"]
    assert one(spark, "my-segformer_b3.pt", N.backbone) == "b3"
    given = (F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    assert tuple(one(spark, "(5, 6, 7, 8)", lambda c: N.window_of(c, *given))) == (5, 6, 7, 8)
    assert tuple(one(spark, None, lambda c: N.window_of(c, *given))) == (1, 2, 3, 4)


@pytest.mark.parametrize("text, date", [("20210715", (2021, 7, 15)), ("2021-07-15", (2021, 7, 15)), ("15.07.2021", (2021, 7, 15)), ("Winter 2020", (2020, 1, 15)), ("autumn 2019", (2019, 10, 15)), ("never", None), (None, None)])
def test_parse_dates(spark, text, date):
    assert one(spark, text, D.parse_date) == (dt.date(*date) if date else None)


def test_months_and_seasons(spark):
    assert [one(spark, t, D.month_of) for t in ("2021-05-08", "20211301", "2021/11", "x", None)] == [5, None, 11, None, None]
    assert [one(spark, t, D.month_name) for t in ("5", "5.0", "Month_05", "May", "13", "", "x")] == ["May", "May", "May", "May", "Unknown", "", "Unknown"]
    assert one(spark, None, lambda c: D.phenological_season(F.lit(None).cast("int"))) == "leaf_off"
    assert one(spark, None, lambda c: D.meteorological_season(F.lit(12))) == "winter"
    assert [one(spark, t, D.coverage_date) for t in ("20210508", "19990101", "x")] == [20210508, 0, 0]


def test_date_encoding(spark):
    e = one(spark, "2020-12-31", lambda c: D.date_encoding(c.cast("date")))
    assert abs(e.sin - 0.5) < 1e-9 and abs(e.cos - 1) < 1e-9
    assert tuple(one(spark, None, lambda c: D.date_encoding(c.cast("date")))) == (0.5, 0.5)


def test_seasonal_pattern(spark):
    def label(*dates):
        return one(spark, ",".join(dates), lambda c: D.seasonal_pattern(F.transform(F.split(c, ","), lambda x: x.cast("date"))))

    assert label("2021-03-01", "2021-07-01", "2021-11-01") == "both"
    assert label("2021-03-01", "2021-07-01") == "before" and label("2021-07-01", "2021-11-01") == "after"
    assert label("2021-07-01") == "none" and label("2021-03-01") is None


def test_bins(spark):
    labels = [one(spark, float(v), B.right_closed) for v in (0, 5, 10, 10.5, 25, 50, 100, 100.5, -1)]
    assert [x and x[:2] for x in labels] == ["B1", "B1", "B1", "B2", "B2", "B3", "B4", None, None]
    assert [one(spark, float(v), B.left_closed) for v in (0, 10, 25, 50, 100, 101)] == [0, 1, 2, 3, 3, None]
    grid = [one(spark, v, lambda c: B.grid_bin(c, F.lit(10.0), 0.02)) for v in (10.0, 10.02, 10.03, 10.04, 9.0)]
    assert grid == [None, 0, 1, 1, None]


def test_grid_bins_agree_with_their_edges(spark):
    df = spark.range(1, 2000).select((F.lit(6.0) + F.col("id") * F.lit(0.02)).alias("v")).withColumn("i", B.grid_bin(F.col("v"), F.lit(6.0), 0.02))
    assert df.where("not (v > 6.0D + i * 0.02D and v <= 6.0D + (i + 1) * 0.02D)").count() == 0


def test_codes(spark):
    codes = spark.createDataFrame([([0, 1, 255],), ([0, 4],)], "a array<int>").select(B.bad_codes(F.col("a")).alias("b")).collect()
    assert [r.b for r in codes] == [None, [4]]
    assert one(spark, 50.0, lambda c: B.relative_difference(c, F.lit(20.0))) == 100.0 and one(spark, 1.0, lambda c: B.relative_difference(c, F.lit(0.0))) is None
    assert [one(spark, v, B.percent_bin) for v in (-100.0, 0.0, 99.9, 100.0)] == [0, 100, 199, 199]
    assert [one(spark, v, B.normalised) for v in (255.0, float("nan"))] == [1.0, -1.0]


def test_projection(spark):
    lon, lat = tuple(one(spark, 500000.0, lambda c: P.utm_to_lonlat(c, F.lit(0.0), F.lit(32))))
    assert abs(lon - 9) < 1e-9 and abs(lat) < 1e-9
    # The quarter meridian of GRS80 is 10001965.7293 m.
    assert abs(one(spark, 500000.0, lambda c: P.utm_to_lonlat(c, F.lit(0.9996 * 10001965.7293), F.lit(32))).lat - 90) < 1e-6
    df = spark.createDataFrame([(x, y) for x in (300000.0, 500000.0, 700000.0) for y in (5.2e6, 6.1e6)], "x double, y double")
    g = df.withColumn("g", P.utm_to_lonlat(F.col("x"), F.col("y"), F.lit(33))).withColumn("b", P.lonlat_to_utm(F.col("g.lon"), F.col("g.lat"), F.lit(33)))
    assert all(math.hypot(r.x - r.b.x, r.y - r.b.y) < 1e-3 for r in g.collect())
    factors = [r.f for r in df.where("y = 5.2e6").orderBy("x").select(P.geodesic_area_factor(F.col("x"), F.col("y"), F.lit(33)).alias("f")).collect()]
    assert all(0.998 < f < 1.002 and f != 1 for f in factors) and factors[1] > factors[0] > 1 - 2e-3
