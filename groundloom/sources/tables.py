"""Sources: archives of files, vectors, CSV with drifting names, and recorded API answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.functions.names import cell_key, file_name, none_if_empty, tile_date


def archive(spark: SparkSession, root: str, states: list[str] | None = None, years: list[str] | None = None, pattern: str = "*_pred.tif", exact_state: bool = False) -> DataFrame:
    """path, length, state, year, cell, date of <root>/<STATE>/<YEAR>/predictions/...; file contents aren't read.

    State names are compared without case unless exact_state; a missing root is an error of the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    parts = F.split(F.substring_index(F.col("path"), f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1), "/")
    # Shallower paths have no state or year.
    deep = lambda i: F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i))).otherwise(F.lit(""))
    out = files.select("path", "length", deep(0).alias("state"), deep(1).alias("year"), cell_key(F.col("path")).alias("cell"))
    out = out.withColumn("date", tile_date(F.col("path"), none_if_empty(F.col("year"))))
    if states:
        out = out.where(F.col("state").isin(*states) if exact_state else F.lower("state").isin(*(s.lower() for s in states)))
    return out.where(F.col("year").isin(*years)) if years else out


def features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a GeoJSON FeatureCollection: the given properties and the geometry's type and coordinates as text."""
    kind = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{schema}>>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def csv_by_state(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """CSV files of one schema; a missing state comes from the file name (NRW is NW); overall_ prefixes are dropped."""
    rows = spark.read.schema(schema).csv(glob, header=True)
    stem = F.regexp_replace(file_name(F.col("_metadata.file_path")), r"\.csv$", "")
    named = none_if_empty(F.upper(F.regexp_extract(stem, r"(?:^|_)([A-Za-z]{2,3})$", 1)))
    state = F.coalesce(F.col("state"), named) if "state" in rows.columns else named
    rows = rows.withColumn("state", F.when(state == "NRW", "NW").otherwise(state))
    return rows.withColumnsRenamed({c: c.removeprefix("overall_") for c in rows.columns if c.startswith("overall_")})


def recorded_answers(answers: DataFrame, schema: str) -> DataFrame:
    """Items of recorded JSON answers (tile, body); a body that can't be read gives no items."""
    items = F.from_json("body", f"struct<items:array<struct<{schema}>>>")["items"]
    return answers.select("tile", F.explode(items).alias("i")).select("tile", "i.*")


def attributes(df: DataFrame, lists: list[str], flags: list[str]) -> DataFrame:
    """A cached attribute table read again: lists of dates from text, flags from words."""
    dates = {c: F.filter(F.transform(F.split(c, r",\s*"), lambda d: d.try_cast("date")), lambda d: d.isNotNull()) for c in lists}
    return df.withColumns(dates | {c: F.lower(F.col(c).cast("string")).isin("true", "1", "1.0") for c in flags})


def points_near(points: DataFrame, x0: float, y0: float, x1: float, y1: float, buffer: float = 0.0) -> DataFrame:
    """Points of a closed, buffered box: the filter reaches the files' statistics."""
    return points.where(F.col("x").between(x0 - buffer, x1 + buffer) & F.col("y").between(y0 - buffer, y1 + buffer))
