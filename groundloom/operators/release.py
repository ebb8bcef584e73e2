"""Inventory of files against what a release should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundloom.functions.names import checksum


#: Items of an inventory at most.
MOST = 10_000


def _few(items: DataFrame) -> DataFrame:
    if items.limit(MOST + 1).count() > MOST:
        raise ValueError(f"an inventory has at most {MOST} items")
    return items


def inventory(items: DataFrame, files: DataFrame, clutter: str = r"(^|/)(\.DS_Store|Thumbs\.db|\._.*)$") -> DataFrame:
    """item, n_files, size, is_present: files (path, length) matched by an item's pattern (rlike); clutter doesn't count.

    items is a written list of at most MOST rows, which is checked before it is broadcast: files are never sent about.
    """
    real = files.where(~F.col("path").rlike(clutter))
    found = real.join(F.broadcast(_few(items)), F.expr("path rlike pattern")).groupBy("item").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("size"))
    zero = F.lit(0).cast("long")
    sums = items.select("item").join(found, "item", "left").select("item", F.coalesce("n_files", zero).alias("n_files"), F.coalesce("size", zero).alias("size"))
    return sums.withColumn("is_present", F.col("size") > 0)


def unlisted(items: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(F.broadcast(_few(items)), F.expr("path rlike pattern"), "left_anti")


def manifest(files: DataFrame, limit: int | None = None) -> DataFrame:
    """path, length, sha256 of files with content; null above the limit of bytes."""
    return files.select("path", "length", checksum(F.col("content"), limit).alias("sha256"))
