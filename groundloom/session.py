"""Session defaults that the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; conf adds or replaces settings (_ for .)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName("groundloom").config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; available: {df.columns}")


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The names that df has: absent product columns are skipped, not an error."""
    return [n for n in names if n in df.columns]
