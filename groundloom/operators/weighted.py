"""Area-weighted aggregation: ratios of sums, never means of percentages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundloom.functions.binning import grid_bin
from groundloom.session import present, require_columns

#: Fixed value: weights by preference.
WEIGHTS = ("land_area_km2", "tile_area_km2")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows without a value or a weight count in neither sum; no rows give null."""
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))


def weight_column(df: DataFrame, constant: float | None = None) -> Column:
    """Measured land where there is a column of it, else the footprint, else the constant, else an error."""
    for name in present(df, list(WEIGHTS)):
        return F.col(name)
    if constant is None:
        raise KeyError(f"none of {WEIGHTS} in {df.columns}")
    return F.lit(float(constant))


def aggregate_to_grid(tiles: DataFrame, products: list[str], lon_step: float, lat_step: float, area: str) -> DataFrame:
    """lat_bin, lon_bin, centre_lat, centre_lon and a weighted mean of each product.

    The grid starts at the least centre of all tiles, valued or not; that tile's
    own edge is outside. Cells without any product's value are left out. The
    bounds are one row of sums, so joining them costs no shuffle.
    """
    require_columns(tiles, "lon_c", "lat_c", area)
    products = present(tiles, products)
    bounds = tiles.agg(F.min("lon_c").alias("lon_0"), F.min("lat_c").alias("lat_0"))
    binned = tiles.crossJoin(F.broadcast(bounds)).select(
        grid_bin(F.col("lat_c"), F.col("lat_0"), lat_step).alias("lat_bin"), grid_bin(F.col("lon_c"), F.col("lon_0"), lon_step).alias("lon_bin"), "lat_0", "lon_0", F.col(area).alias("_w"), *products
    ).where("lat_bin is not null and lon_bin is not null")
    cells = binned.groupBy("lat_bin", "lon_bin", "lat_0", "lon_0").agg(*(weighted_mean(F.col(p), F.col("_w")).alias(p) for p in products))
    some = reduce(lambda a, b: a | b, (F.col(p).isNotNull() for p in products))
    centre = lambda start, step, i: F.col(start) + F.col(i) * F.lit(float(step)) + F.lit(step / 2)
    return cells.where(some).select("lat_bin", "lon_bin", centre("lat_0", lat_step, "lat_bin").alias("centre_lat"), centre("lon_0", lon_step, "lon_bin").alias("centre_lon"), *products)


def totals_km2(tiles: DataFrame, ours: str, products: list[str], area: str) -> DataFrame:
    """One row: the area of each product where ours has a value."""
    require_columns(tiles, ours, area)
    valid = F.col(ours).isNotNull()
    return tiles.agg(*(F.sum(F.when(valid, F.col(area) * F.col(p) / 100)).alias(f"{p}_km2") for p in present(tiles, products)))


def aggregate_by_unit(tiles: DataFrame, products: list[str], unit: str, area: str, ours: str) -> DataFrame:
    """For each unit and product: weighted mean, area and reference area, over tiles where ours has a value."""
    out = []
    for p in present(tiles, products):
        v, w = F.col(p), F.col(area)
        out += [weighted_mean(v, w).alias(p), F.sum(w * v / 100).alias(f"{p}_km2"), F.sum(F.when(v.isNotNull(), w)).alias(f"{p}_ref_km2")]
    return tiles.where(F.col(ours).isNotNull()).groupBy(unit).agg(*out)


def with_units(units: DataFrame, result: DataFrame, unit: str) -> DataFrame:
    """All units; those without tiles stay null."""
    return units.join(result, unit, "left")


def national_mean(per_unit: DataFrame, product: str, unit_area: str = "unit_area_km2") -> Column:
    """An aggregate: area over the product's own reference, else over the units' area, else a plain mean."""
    km2, ref = f"{product}_km2", f"{product}_ref_km2"
    plain = F.avg(product)
    options = []
    for base in present(per_unit, [ref, unit_area] if km2 in per_unit.columns else []):
        both = F.col(km2).isNotNull() & F.col(base).isNotNull()
        total = F.sum(F.when(both, F.col(base)))
        options.append(F.when(total > 0, 100 * F.sum(F.when(both, F.col(km2))) / total))
    return F.coalesce(*options, plain)


def difference_table(per_unit: DataFrame, products: list[str]) -> DataFrame:
    """One row a product, the first is ours: cover, area, and differences from ours.

    One aggregate row is unpivoted, so nothing but it leaves the units' scan.
    """
    products = present(per_unit, products)
    one = per_unit.agg(*(x for i, p in enumerate(products) for x in (national_mean(per_unit, p).alias(f"c{i}"), F.sum(f"{p}_km2").alias(f"a{i}"), F.count(p).alias(f"n{i}"))))
    lines = F.array(*(F.struct(F.lit(p).alias("product"), F.col(f"c{i}").alias("cover_pct"), F.col(f"a{i}").alias("area_km2"), F.col(f"n{i}").alias("units_with_data")) for i, p in enumerate(products)))
    ours = one.select("c0", "a0", F.explode(lines).alias("line")).select("c0", "a0", "line.*")
    pp = F.col("cover_pct") - F.col("c0")
    return ours.select(
        "product", "cover_pct", "area_km2", "units_with_data", pp.alias("diff_pp"), (100 * pp / F.nullif("c0", F.lit(0.0))).alias("diff_pct"), (F.col("area_km2") - F.col("a0")).alias("diff_km2")
    )


def gap_completion(table: DataFrame, fresh: DataFrame, key: str, ours: str, products: list[str]) -> DataFrame:
    """Rows where ours is null take fresh values that aren't null; a row whose own value stays null is left as it was."""
    new = fresh.select(key, *(F.col(c).alias(f"_new_{c}") for c in [ours, *products]))
    gap = F.col(ours).isNull() & F.col(f"_new_{ours}").isNotNull()
    filled = [F.when(gap, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) for c in [ours, *products]]
    rest = [c for c in table.columns if c not in (ours, *products)]
    return table.join(new, key, "left").select(*rest, *filled)


def state_summary(rows: DataFrame) -> DataFrame:
    """Per state and for all (state null): tiles, areas and cover from sums; no land gives 0."""
    sums = rows.rollup("state").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("land_area_ha").alias("land_ha"), F.sum("tree_area_ha").alias("tree_ha"))
    return sums.select("state", "n_tiles", (F.col("land_ha") / 100).alias("land_km2"), (F.col("tree_ha") / 100).alias("tree_km2"), F.coalesce(F.try_divide(100 * F.col("tree_ha"), F.col("land_ha")), F.lit(0.0)).alias("tree_pct"))
