"""Downloads: pairing acquisitions of products, expanding, and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda u, v: u & v, (a[k].eqNullSafe(b[k]) for k in keys))


def paired(links: DataFrame, first: str, second: str, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links kept and links dropped: rows of two products stay where both have the tile and date (null dates are equal).

    Other products are untouched, and nothing is dropped unless both products are present.
    """
    keys = keys or ["tile", "date"]
    two = links.where(F.col("product").isin(first, second))
    both = two.groupBy(*keys).agg(F.count_distinct("product").alias("_n"))
    present = links.agg(F.bool_or(F.col("product") == first).alias("_a"), F.bool_or(F.col("product") == second).alias("_b"))
    marked = links.join(both, _same(links, both, keys), "left").select(links["*"], "_n").crossJoin(F.broadcast(present))  # one row
    keep = ~F.col("product").isin(first, second) | ~(F.col("_a") & F.col("_b")) | (F.coalesce("_n", F.lit(0)) == 2)
    marked = marked.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    drop = ["_n", "_a", "_b", "_keep"]
    return marked.where("_keep").drop(*drop), marked.where("not _keep").drop(*drop)


def expand_ground(ground: DataFrame, imagery: DataFrame) -> DataFrame:
    """Each ground model once for each imagery date of its tile, its own date kept as source_date; without imagery, as it is."""
    shots = imagery.groupBy("tile").agg(F.array_sort(F.collect_set("date")).alias("_dates"))
    met = ground.join(shots, "tile", "left").withColumn("source_date", F.col("date"))
    return met.withColumn("date", F.explode(F.coalesce("_dates", F.array("date")))).drop("_dates")


def missing_acquisitions(expected: DataFrame, fetched: DataFrame) -> DataFrame:
    """Expected (tile, date) that weren't fetched. expected: tile, dates as text, comma-joined."""
    each = expected.select("tile", F.explode(F.split("dates", r",\s*")).alias("date")).where("date <> ''")
    return each.join(fetched.select("tile", "date"), ["tile", "date"], "left_anti")


def links_of_tiles(tiles: DataFrame, links: DataFrame, overlapping: DataFrame) -> DataFrame:
    """Links by equal tile id; tiles without one take the first overlapping link, re-keyed to the tile.

    overlapping: tile_id, link_id, from a spatial join.
    """
    exact = tiles.select("tile_id").join(links.withColumnRenamed("tile", "tile_id"), "tile_id")
    rest = tiles.select("tile_id").join(links.select(F.col("tile").alias("tile_id")), "tile_id", "left_anti")
    first = rest.join(overlapping, "tile_id").groupBy("tile_id").agg(F.min("link_id").alias("link_id"))
    return exact.unionByName(first.join(links, "link_id").drop("tile").select(*exact.columns))


def apply_splits(patches: DataFrame, published: DataFrame, key: str = "tile_id") -> DataFrame:
    """Published splits replace and restrict; of a tile's several rows the last counts. Ids are compared as text."""
    last = published.groupBy(F.col(key).cast("string").alias("_id")).agg(F.max_by("split", "pos").alias("_split"))
    met = patches.join(last, F.col(key).cast("string") == F.col("_id"))
    return met.withColumn("split", F.col("_split")).drop("_id", "_split")


def assert_no_leak(patches: DataFrame, key: str = "tile_id") -> None:
    """Raises if a tile is both in train and in val."""
    both = patches.where(F.col("split").isin("train", "val")).groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
    if not both.isEmpty():
        raise ValueError("tiles in both train and val")


def fetch_report(log: DataFrame) -> DataFrame:
    return log.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tile").alias("n_tiles"))
