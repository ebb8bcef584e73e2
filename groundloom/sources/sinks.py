"""Sinks: tables, GeoJSON lines, and appends that can be taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, force: bool = True) -> None:
    """One CSV file for a report; for small, aggregated tables."""
    df.coalesce(1).write.mode("overwrite" if force else "errorifexists").csv(path, header=True)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, force: bool = True) -> None:
    """Parquet, in folders by the given columns."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_report(df: DataFrame, path: str) -> None:
    """JSON lines added to what is there: a report that survives a crash."""
    df.write.mode("append").json(path)


def write_geojson_lines(features: DataFrame, path: str, column: str = "feature") -> None:
    """One feature a line, in as many files as partitions."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def as_text_columns(df: DataFrame) -> DataFrame:
    """Arrays joined by commas, nan and None as null: what a vector or CSV format can hold."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            out[name] = F.array_join(F.transform(name, lambda x: x.cast("string")), ", ")
        elif kind == "string":
            out[name] = F.when(F.col(name).isin("nan", "None"), None).otherwise(F.col(name))
    return df.withColumns(out)
