"""Which acquisition a cell belongs to, and tables rebuilt in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundloom.functions.names import is_dated


def newest_per_cell(tiles: DataFrame, cell: list[str], date: str = "date", state: str = "state", name: str = "name") -> DataFrame:
    """The newest tile of each cell (then the last state, then the last name), with n_rejected.

    Tiles without a cell pass uncontested. The winner is an aggregate with
    map-side combine, so a cell with very many candidates is no hot spot.
    """
    keyed = tiles.where(F.col(cell[0]).isNotNull())
    rest = [c for c in tiles.columns if c not in (*cell, date, state, name)]
    best = F.max(F.struct(date, state, name, *rest)).alias("w")
    won = keyed.groupBy(*cell).agg(best, (F.count(F.lit(1)) - 1).alias("n_rejected")).select(*cell, "w.*", "n_rejected")
    free = tiles.where(F.col(cell[0]).isNull()).withColumn("n_rejected", F.lit(0).cast("long"))
    return won.unionByName(free.select(*won.columns))


def overlap_report(tiles: DataFrame, cell: list[str], date: str = "date", state: str = "state", name: str = "name") -> DataFrame:
    """A row for each rejected tile with the winner of its cell."""
    mine = F.struct(date, state, name)
    won = tiles.groupBy(*cell).agg(F.max(mine).alias("w"))
    met = tiles.join(won, cell).where(mine != F.col("w"))
    return met.select(*cell, *(F.col(f"w.{c}").alias(f"winner_{c}") for c in (date, state, name)), *(F.col(c).alias(f"rejected_{c}") for c in (date, state, name)))


def contest_report(tiles: DataFrame, cell: list[str]) -> DataFrame:
    """Losers by state."""
    return overlap_report(tiles, cell).groupBy("rejected_state").agg(F.count(F.lit(1)).alias("n_lost"))


def contest_summary(tiles: DataFrame, cell: list[str], date: str = "date", state: str = "state", name: str = "name") -> DataFrame:
    """One row: cells, contested ones, their share in percent (0 without cells), and contested ones that an undated tile won, where only the tiebreak decided."""
    won = tiles.groupBy(*cell).agg(F.max(F.struct(date, state, name)).alias("w"), F.count(F.lit(1)).alias("n"))
    contested = F.col("n") > 1
    undated = contested & ~F.coalesce(is_dated(F.col(f"w.{date}")), F.lit(False))
    sums = won.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(contested).alias("n_contested"), F.count_if(undated).alias("n_undated_winners"))
    return sums.withColumn("contested_pct", F.coalesce(F.try_divide(100.0 * F.col("n_contested"), F.col("n_cells")), F.lit(0.0)))


def coverage_by_date(tiles: DataFrame, cell: list[str], date: str = "date") -> DataFrame:
    """Area of each date, every cell belonging to its newest; undated (0) ranks last."""
    newest = tiles.groupBy(*cell).agg(F.max(date).alias(date))
    return newest.groupBy(date).agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) * F.lit(1.0)).alias("area_km2"))


def upsert(old: DataFrame, fresh: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Old rows that weren't rebuilt, then the fresh ones; columns the old table lacks get their default."""
    kept = old.join(fresh.select(key), key, "left_anti")
    for name, value in (defaults or {}).items():
        kept = kept.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in kept.columns else F.lit(value))
    return kept.unionByName(fresh, allowMissingColumns=True)


def to_rebuild(wanted: DataFrame, recorded: DataFrame, key: str, count: str) -> DataFrame:
    """Wanted cells whose recorded count differs or is missing."""
    was = recorded.select(key, F.col(count).alias("_was"))
    return wanted.join(was, key, "left").where(~F.col(count).eqNullSafe(F.col("_was"))).drop("_was")


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order: a least struct with map-side combine, so a hot key is never sorted."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))


def lookup_first(df: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join with the first row of each key of the table."""
    return df.join(first_of_each(table, [key], order), key, "left")


def set_overlap(drawn: DataFrame, reference: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in both draws, in one, or of the reference not eligible."""
    ids = lambda d: d.select(key).distinct()
    flag = lambda d, name: ids(d).withColumn(name, F.lit(True))
    both = flag(drawn, "d").join(flag(reference, "r"), key, "full").join(flag(eligible, "e"), key, "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    d, r, e = (F.coalesce(F.col(c), F.lit(False)) for c in "dre")
    return both.agg(n(d & r).alias("n_both"), n(d & ~r).alias("n_drawn_only"), n(r & ~d).alias("n_reference_only"), n(r & ~e).alias("n_reference_ineligible"))
