import json

from pyspark.sql import functions as F

from groundloom.sources import sinks, tables
from groundloom.streaming import live


def test_archive(spark, tmp_path):
    root = tmp_path / "archive"
    for path in ("BB/2021/predictions/UTM/dop_33_418_5931_bb_file_20210508_pred.tif", "mv/2020/predictions/x/odd_pred.tif", "BB/2021/other.txt"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"12")
    got = {(r.state, r.year): r for r in tables.archive(spark, str(root)).collect()}
    assert set(got) == {("BB", "2021"), ("mv", "2020")} and got["BB", "2021"].date == "20210508" and got["mv", "2020"].date == "20200000" and got["mv", "2020"].cell is None
    assert tables.archive(spark, str(root), states=["MV"]).count() == 1 and tables.archive(spark, str(root), states=["MV"], exact_state=True).count() == 0
    assert tables.archive(spark, str(root), years=["2021"]).count() == 1


def test_csv_of_states(spark, tmp_path):
    (tmp_path / "metrics_nrw.csv").write_text("overall_iou,n\n0.5,3\n")
    (tmp_path / "metrics_BB.csv").write_text("overall_iou,n\n0.7,4\n")
    got = tables.csv_by_state(spark, str(tmp_path / "*.csv"), "overall_iou double, n int")
    assert got.columns == ["iou", "n", "state"] and sorted((r.state, r.iou) for r in got.collect()) == [("BB", 0.7), ("NW", 0.5)]


def test_geojson(spark, tmp_path):
    path = tmp_path / "x.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    r = tables.features(spark, str(path), "name:string").first()
    assert r.name == "a" and r.geometry.type == "Point" and json.loads(r.geometry.coordinates) == [1, 2]


def test_attributes_and_answers(spark):
    df = spark.createDataFrame([("2021-07-15, 2022-01-01, nan", "True")], "flight_dates string, is_border string")
    r = tables.attributes(df, ["flight_dates"], ["is_border"]).first()
    assert len(r.flight_dates) == 2 and r.is_border is True
    a = spark.createDataFrame([("t", '{"items": [{"url": "u1"}, {"url": "u2"}]}'), ("s", "broken")], "tile string, body string")
    assert sorted(r.url for r in tables.recorded_answers(a, "url:string").collect()) == ["u1", "u2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "nan", [1, 2])], "a int, b string, c array<int>")
    r = sinks.as_text_columns(df).first()
    assert r.b is None and r.c == "1, 2"
    sinks.write_csv(df.select("a"), str(tmp_path / "c"))
    sinks.append_report(df, str(tmp_path / "j"))
    sinks.append_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 1
    sinks.write_table(df, str(tmp_path / "t"), by=["a"])
    assert spark.read.parquet(str(tmp_path / "t")).where("a = 1").count() == 1
    sinks.write_geojson_lines(df.select(F.lit('{"type":"Feature"}').alias("feature")), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).first().type == "Feature"


def test_stream_keeps_the_newest_whatever_the_order(spark, tmp_path):
    source = tmp_path / "in"
    schema = "cell int, date string, state string, name string"
    batches = [[(1, "20230101", "A", "new"), (2, "20200101", "A", "x")], [(1, "20210101", "B", "late"), (2, "20220101", "A", "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = live.newest_wins(stream, ["cell"], str(tmp_path / "out"), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
        state = {r.cell: r.name for r in spark.read.parquet(str(tmp_path / f"out/state-{i}")).collect()}
        assert state == ({1: "new", 2: "x"} if i == 0 else {1: "new", 2: "y"})


def test_daily_counts_of_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 1.5D as value union all select timestamp'2024-01-01 11:00:00', 2.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = live.daily_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("daily").first()
    assert (r.n, r.total) == (2, 3.5)
