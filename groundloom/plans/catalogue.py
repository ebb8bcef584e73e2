"""Named queries over the driver's tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.functions import binning as B
from groundloom.functions import dates as D
from groundloom.functions import names as N
from groundloom.functions import projection as P
from groundloom.lineage import cut
from groundloom.operators import links as L
from groundloom.operators import metrics as M
from groundloom.operators import canopy, mosaic, observations, outcomes, overlap, polygons, raster, release, sampling, spatial, stats, weighted, windows
from groundloom.plans import views as V
from groundloom.sources import answers, tables
from groundloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that must agree with it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# Weighted aggregation -------------------------------------------------------------------------------------------------


@query(f"with {V.TILES} select unit, round(sum(case when our_pct is not null then our_pct * land_area_km2 end) / nullif(sum(case when our_pct is not null then land_area_km2 end), 0), 6) as our_pct, round(sum(case when prod_a is not null then prod_a * land_area_km2 end) / nullif(sum(case when prod_a is not null then land_area_km2 end), 0), 6) as prod_a from tiles where our_pct is not null group by unit")
def weighted_mean_by_unit(spark, d):
    return rounded(weighted.aggregate_by_unit(V.tiles(spark, d), ["our_pct", "prod_a"], "unit", "land_area_km2", "our_pct").select("unit", "our_pct", "prod_a"))


@query(f"with {V.TILES} select unit, round(sum(land_area_km2 * our_pct / 100), 6) as our_pct_km2, round(sum(case when our_pct is not null then land_area_km2 end), 6) as our_pct_ref_km2, round(sum(land_area_km2 * prod_a / 100), 6) as prod_a_km2, round(sum(case when prod_a is not null then land_area_km2 end), 6) as prod_a_ref_km2 from tiles where our_pct is not null group by unit")
def unit_areas_and_reference(spark, d):
    return rounded(weighted.aggregate_by_unit(V.tiles(spark, d), ["our_pct", "prod_a"], "unit", "land_area_km2", "our_pct").drop("our_pct", "prod_a"))


@query(f"""with {V.TILES}, u as (select unit, sum(land_area_km2 * our_pct / 100) as a, sum(land_area_km2) as ra, sum(land_area_km2 * prod_a / 100) as b,
  sum(case when prod_a is not null then land_area_km2 end) as rb, count(prod_a) as nb from tiles where our_pct is not null group by unit),
 t as (select 100 * sum(a) / sum(ra) as c0, 100 * sum(b) / sum(rb) as c1, sum(a) as a0, sum(b) as a1, count(*) as n0, count(*) filter (nb > 0) as n1 from u)
 select product, round(c, 6) as cover_pct, round(a, 6) as area_km2, n as units_with_data, round(c - c0, 6) as diff_pp, round(100 * (c - c0) / c0, 6) as diff_pct, round(a - a0, 6) as diff_km2
 from (select 'our_pct' as product, c0 as c, a0 as a, n0 as n, c0, a0 from t union all select 'prod_a', c1, a1, n1, c0, a0 from t)""")
def national_difference_table(spark, d):
    per_unit = weighted.aggregate_by_unit(V.tiles(spark, d), ["our_pct", "prod_a"], "unit", "land_area_km2", "our_pct")
    return rounded(weighted.difference_table(per_unit, ["our_pct", "prod_a"]))


@query(f"with {V.TILES} select round(sum(land_area_km2 * our_pct / 100), 4) as our_pct_km2, round(sum(case when our_pct is not null then land_area_km2 * prod_a / 100 end), 4) as prod_a_km2 from tiles")
def totals_ours_valid(spark, d):
    return rounded(weighted.totals_km2(V.tiles(spark, d), "our_pct", ["our_pct", "prod_a"], "land_area_km2"), 4)


GRID = """b as (select min(lon_c) as e0, min(lat_c) as f0 from tiles),
 g as (select *, ceil((lat_c - f0) / 0.012::double)::bigint - 1 as gi, ceil((lon_c - e0) / 0.02::double)::bigint - 1 as gj from tiles, b),
 bins as (select *, case when lat_c > f0 then case when lat_c <= f0 + gi * 0.012::double then gi - 1 when lat_c > f0 + (gi + 1) * 0.012::double then gi + 1 else gi end end as lat_bin,
  case when lon_c > e0 then case when lon_c <= e0 + gj * 0.02::double then gj - 1 when lon_c > e0 + (gj + 1) * 0.02::double then gj + 1 else gj end end as lon_bin from g)"""


@query(f"with {V.TILES}, {GRID} select lat_bin, lon_bin, count(*) as n from bins group by all")
def grid_bins_right_closed(spark, d):
    t = V.tiles(spark, d)
    bounds = t.agg(F.min("lon_c").alias("e0"), F.min("lat_c").alias("f0"))
    t = t.crossJoin(F.broadcast(bounds))  # one row
    return t.groupBy(B.grid_bin(F.col("lat_c"), F.col("f0"), 0.012).alias("lat_bin"), B.grid_bin(F.col("lon_c"), F.col("e0"), 0.02).alias("lon_bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {V.TILES}, {GRID} select lat_bin, lon_bin, round(f0 + lat_bin * 0.012::double + 0.006::double, 6) as centre_lat, round(e0 + lon_bin * 0.02::double + 0.01::double, 6) as centre_lon, round(our_pct, 6) as our_pct, round(prod_a, 6) as prod_a from
 (select lat_bin, lon_bin, f0, e0, sum(case when our_pct is not null then our_pct * land_area_km2 end) / nullif(sum(case when our_pct is not null then land_area_km2 end), 0) as our_pct, sum(case when prod_a is not null then prod_a * land_area_km2 end) / nullif(sum(case when prod_a is not null then land_area_km2 end), 0) as prod_a
  from bins where lat_bin is not null and lon_bin is not null group by all) where our_pct is not null or prod_a is not null""")
def grid_aggregate(spark, d):
    return rounded(weighted.aggregate_to_grid(V.tiles(spark, d), ["our_pct", "prod_a", "absent"], 0.02, 0.012, "land_area_km2"))


@query(f"with {V.TILES}, {GRID}, n as (select lat_bin // 10 as row, lon_bin // 10 as col, unit, count(*) as k from bins where lat_bin is not null and lon_bin is not null group by all) select row, col, unit as mode from (select *, row_number() over (partition by row, col order by k desc, unit) as i from n) where i = 1")
def grid_mode(spark, d):
    t = V.tiles(spark, d)
    bounds = t.agg(F.min("lon_c").alias("e0"), F.min("lat_c").alias("f0"))
    t = t.crossJoin(F.broadcast(bounds))  # one row
    at = lambda c, start, step: F.floor(B.grid_bin(F.col(c), F.col(start), step) / 10)
    return t.select(at("lat_c", "f0", 0.012).alias("row"), at("lon_c", "e0", 0.02).alias("col"), "unit").where("row is not null and col is not null").groupBy("row", "col").agg(F.mode("unit", True).alias("mode"))


@query("""select coalesce(l_returnflag, 'all') as state, count(*) as n_tiles, round(sum(l_quantity) / 100, 6) as land_km2, round(sum(l_quantity * l_discount) / 100, 6) as tree_km2, round(coalesce(100 * sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 0), 6) as tree_pct from lineitem group by rollup (l_returnflag)""")
def state_summary_rollup(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("state"), F.col("l_quantity").alias("land_area_ha"), (F.col("l_quantity") * F.col("l_discount")).alias("tree_area_ha"))
    return rounded(weighted.state_summary(rows).withColumn("state", F.coalesce("state", F.lit("all"))))


@query("""select p_partkey as id, p_brand, case when p_size % 3 = 0 and f is not null then coalesce(f, o) else o end as ours, case when p_size % 3 = 0 and f is not null then coalesce(g, a) else a end as prod_a
 from (select *, case when p_size % 3 <> 0 then p_retailprice end as o, case when p_size % 2 = 0 then p_size::double end as a, case when p_partkey % 5 <> 0 then p_retailprice + 1 end as f, case when p_partkey % 4 <> 0 then p_size + 0.5::double end as g from part)""")
def gap_completion(spark, d):
    p = V.table(spark, d, "part")
    old = p.select(F.col("p_partkey").alias("id"), "p_brand", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("ours"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).alias("prod_a"))
    fresh = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") + 1).alias("ours"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") + 0.5).alias("prod_a"))
    return weighted.gap_completion(old, fresh, "id", "ours", ["prod_a"])


@query(f"with {V.TILES}, r as (select unit, sum(land_area_km2) as km2 from tiles where our_pct is not null and unit % 3 <> 0 group by unit) select n_nationkey as unit, n_name, round(km2, 6) as km2 from nation left join r on n_nationkey = unit")
def units_without_tiles_stay_null(spark, d):
    t = V.tiles(spark, d).where("our_pct is not null and unit % 3 <> 0").groupBy("unit").agg(F.sum("land_area_km2").alias("km2"))
    units = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), "n_name")
    return rounded(weighted.with_units(units, t, "unit"))


# Overlap --------------------------------------------------------------------------------------------------------------


@query(f"with {V.CANDIDATES} select cell, date, state, name, pos, n - 1 as n_rejected from (select *, count(*) over (partition by cell) as n, row_number() over (partition by cell order by date desc, state desc, name desc, pos desc) as i from candidates) where i = 1")
def newest_per_cell(spark, d):
    return overlap.newest_per_cell(V.candidates(spark, d).drop("area"), ["cell"])


@query(f"with {V.CANDIDATES}, w as (select cell, date, state, name, row_number() over (partition by cell order by date desc, state desc, name desc) as i from candidates) select c.cell, w.date as winner_date, w.state as winner_state, w.name as winner_name, c.date as rejected_date, c.state as rejected_state, c.name as rejected_name from candidates c join w on c.cell = w.cell and i = 1 where (c.date, c.state, c.name) is distinct from (w.date, w.state, w.name)")
def overlap_report(spark, d):
    return overlap.overlap_report(V.candidates(spark, d).drop("area", "pos"), ["cell"])


@query(f"with {V.CANDIDATES}, w as (select cell, max((date, state, name)) as w from candidates group by cell) select state as rejected_state, count(*) as n_lost from candidates join w using (cell) where (date, state, name) <> w group by state")
def contest_losers_by_state(spark, d):
    return overlap.contest_report(V.candidates(spark, d).drop("area", "pos"), ["cell"])


@query(f"with {V.CANDIDATES}, c as (select case when pos % 4 <> 0 then cell end as cell, date, state, name, pos from candidates) select cell, date, state, name, pos, n - 1 as n_rejected from (select *, count(*) over (partition by cell) as n, row_number() over (partition by cell order by date desc, state desc, name desc, pos desc) as i from c where cell is not null) where i = 1 union all select cell, date, state, name, pos, 0 from c where cell is null")
def unkeyed_pass_through(spark, d):
    c = V.candidates(spark, d).drop("area").withColumn("cell", F.when(F.col("pos") % 4 != 0, F.col("cell")))
    return overlap.newest_per_cell(c, ["cell"])


@query(f"with {V.CANDIDATES}, m as (select cell, max(case when date::int between 20000000 and 20301231 then date::int else 0 end) as date from candidates group by cell) select date, count(*) as n_cells, count(*)::double as area_km2 from m group by date")
def coverage_area_by_date(spark, d):
    c = V.candidates(spark, d).withColumn("date", D.coverage_date(F.col("date")))
    return overlap.coverage_by_date(c, ["cell"])


@query("""with old as (select o_custkey as cell, count(*) as n, max(o_totalprice) as top from orders where o_orderkey % 2 = 0 group by 1), fresh as (select o_custkey as cell, count(*) as n, max(o_totalprice) as top from orders where o_orderkey % 5 = 0 group by 1)
 select cell, n, top, 0 as skipped from old where cell not in (select cell from fresh) union all select cell, n, top, 1 from fresh""")
def cell_table_upsert(spark, d):
    o = V.table(spark, d, "orders")
    build = lambda k: o.where(F.col("o_orderkey") % k == 0).groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return overlap.upsert(build(2), build(5).withColumn("skipped", F.lit(1)), "cell", {"skipped": 0})


@query("""with w as (select o_custkey as cell, count(*) as n from orders group by 1), r as (select o_custkey as cell, count(*) as n from orders where o_orderstatus <> 'P' group by 1) select w.cell, w.n from w left join r using (cell) where w.n is distinct from r.n""")
def cells_to_rebuild(spark, d):
    o = V.table(spark, d, "orders").withColumnRenamed("o_custkey", "cell")
    count = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return overlap.to_rebuild(count(o), count(o.where("o_orderstatus <> 'P'")), "cell", "n")


@query("select l_partkey, l_orderkey, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_extendedprice, l_quantity) as i from lineitem) where i = 1")
def dedupe_first_wins(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    rows = V.table(spark, d, "lineitem").select("l_partkey", *order)
    return overlap.first_of_each(rows, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_quantity", "l_extendedprice")


@query("""with f as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) select c_custkey, c_name, o_orderkey, o_totalprice from customer left join f on c_custkey = o_custkey and i = 1""")
def lookup_first_wins(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return overlap.lookup_first(V.table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderkey"])


@query("""with d as (select distinct o_custkey as k from orders where o_orderkey % 3 = 0), r as (select distinct o_custkey as k from orders where o_orderkey % 4 = 0), e as (select distinct o_custkey as k from orders where o_orderstatus = 'F')
 select (select count(*) from d where k in (from r)) as n_both, (select count(*) from d where k not in (from r)) as n_drawn_only, (select count(*) from r where k not in (from d)) as n_reference_only, (select count(*) from r where k not in (from e)) as n_reference_ineligible""")
def sample_overlap_counts(spark, d):
    o = V.table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return overlap.set_overlap(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 4 = 0"), o.where("o_orderstatus = 'F'"), "k")


# Names and cells ------------------------------------------------------------------------------------------------------


@query(f"""with {V.CANDIDATES} select pos, 33 as zone, substr(name, 6, 3)::int as easting_km, substr(name, 10, 4)::int as northing_km, date as tile_date, date <> '00000000' and not date like '%0000' as is_dated,
 case when date = '00000000' then null else date end as own_date, upper(substr(name, 15, 1) || 'x') as state, replace(name, '_pred.tif', '') as stem from candidates""")
def parse_cell_and_date(spark, d):
    c = V.candidates(spark, d)
    date = N.tile_date(F.col("name"))
    out = c.select("pos", N.cell_key(F.col("name")).alias("k"), date.alias("tile_date"), N.is_dated(date).alias("is_dated"), N.date_from_name(F.col("name")).alias("own_date"), N.state_from_stem(F.col("name")).alias("state"), N.tile_stem(F.col("name")).alias("stem"))
    return out.select("pos", "k.zone", "k.easting_km", "k.northing_km", "tile_date", "is_dated", "own_date", "state", "stem")


@query("""select o_orderkey as id, 'UTM' || (32 + o_custkey % 2) || '_E' || (o_custkey % 900 // 10 * 100) || '_N' || ((5000 + o_orderkey % 900) // 10 * 100) as cell, (25832 + o_custkey % 2)::int as epsg, (o_custkey % 900 // 10 * 100 * 100)::double as x, ((5000 + o_orderkey % 900) // 10 * 100 * 100)::double as y from orders""")
def cell_id_10km(spark, d):
    o = V.table(spark, d, "orders")
    cell = N.cell_id(32 + F.col("o_custkey") % 2, F.col("o_custkey") % 900, 5000 + F.col("o_orderkey") % 900)
    return o.select(F.col("o_orderkey").alias("id"), cell.alias("cell")).withColumn("p", N.parse_cell_id(F.col("cell"))).select("id", "cell", "p.*")


@query("""with t as (select o_orderkey as id, (o_custkey % 60 - 5) * 1000.0::double + (o_orderkey % 7) * 0.1::double as l, (o_orderkey % 12) * 1000.0::double - 300 as t from orders),
 o as (select id, round_even(l / 0.2::double, 0)::int as c, round_even((10000.0::double - t) / 0.2::double, 0)::int as r from t),
 z as (select *, greatest(c, 0) as c0, greatest(r, 0) as r0 from o),
 w as (select *, least(c + 5000, 50000) - c0 as w, least(r + 5000, 50000) - r0 as whole, least(r + 5000, 50000, (r0 // 5000 + 1) * 5000) - r0 as h from z)
 select id, c0 as col_off, r0 as row_off, c0 - c as src_col, r0 - r as src_row, w as width, h as height, r0 // 5000 as stripe, whole - h as trimmed from w where w > 0 and h > 0""")
def placement_arithmetic(spark, d):
    o = V.table(spark, d, "orders")
    left = (F.col("o_custkey") % 60 - 5) * F.lit(1000.0) + (F.col("o_orderkey") % 7) * F.lit(0.1)
    top = (F.col("o_orderkey") % 12) * F.lit(1000.0) - 300
    p = mosaic.placement(left, top, F.lit(5000), F.lit(5000), F.lit(0.0), F.lit(0.0))
    return o.select(F.col("o_orderkey").alias("id"), p.alias("p")).where("p is not null").select("id", "p.*")


@query(f"""with {V.CANDIDATES} select cell % 50 as cell, count(*) as n_tiles, round(sum(area / 1e6::double), 10) as covered_km2, round(sum(area * 0.25::double / 1e6::double), 10) as tree_km2, string_agg(distinct state, ',' order by state) as states, min(date) as first_date, max(date) as last_date, round(coalesce(100 * sum(area * 0.25::double) / nullif(sum(area), 0), 0), 10) as tree_pct from candidates group by cell % 50""")
def cell_statistics(spark, d):
    c = V.candidates(spark, d).select((F.col("cell") % 50).alias("cell"), "state", "date", (F.col("area") / 1e6).alias("covered_km2"), (F.col("area") * 0.25 / 1e6).alias("tree_km2"))
    return rounded(mosaic.cell_statistics(c, "cell"), 10)


@query("select doc_id, length(text) as length, sha256(text) as sha256 from documents")
def manifest_checksums(spark, d):
    files = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("length"), F.col("text").alias("content"))
    return release.manifest(files).select(F.col("path").cast("long").alias("doc_id"), "length", "sha256")


@query("""with i(item, pattern) as (values ('small', '^small'), ('tall', '^tall'), ('no such thing', '^nosuch')) select item, count(p_name) as n_files, coalesce(sum(p_size), 0)::bigint as size, coalesce(sum(p_size), 0) > 0 as is_present from i left join part on regexp_matches(p_name, pattern) group by item""")
def release_inventory(spark, d):
    items = spark.createDataFrame([("small", "^small"), ("tall", "^tall"), ("no such thing", "^nosuch")], "item string, pattern string")
    return release.inventory(items, V.table(spark, d, "part").select(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("length")))


# Acquisitions ---------------------------------------------------------------------------------------------------------


@query(f"with {V.ACQUISITIONS} select tile, count(*) as image_count, bool_or(month(date) in (6, 7, 8)) as has_summer, not bool_and(month(date) in (6, 7, 8)) as has_other, count(distinct date) as n_dates, min(date)::varchar as first_date, max(date)::varchar as last_date from acq group by tile")
def tile_collapse(spark, d):
    t = observations.collapse_tiles(V.acquisitions(spark, d), "tile", "date")
    first, last = F.element_at("flight_dates", 1), F.element_at("flight_dates", -1)
    return t.select("tile", "image_count", "has_summer", "has_other", F.size("flight_dates").cast("long").alias("n_dates"), first.cast("string").alias("first_date"), last.cast("string").alias("last_date"))


@query(f"""with {V.ACQUISITIONS}, s as (select tile, min(date) filter (month(date) in (6, 7, 8)) as first from acq group by tile),
 k as (select tile, first, bool_or(month(date) not in (6, 7, 8) and date < first) as b, bool_or(month(date) not in (6, 7, 8) and date > first) as a, string_agg(distinct month(date), ',' order by month(date)) as months from acq join s using (tile) group by tile, first)
 select tile, case when first is null then null when b and a then 'both' when b then 'before' when a then 'after' else 'none' end as pattern, months from k""")
def seasonal_pattern(spark, d):
    t = V.acquisitions(spark, d).groupBy("tile").agg(F.collect_set("date").alias("dates"))
    months = F.array_join(D.months_of(F.col("dates")).cast("array<string>"), ",")
    return t.select("tile", D.seasonal_pattern(F.col("dates")).alias("pattern"), months.alias("months"))


@query(f"""with {V.ACQUISITIONS}, n as (select *, row_number() over (partition by tile order by date, path) as position from acq),
 s as (select *, coalesce(max(case when month(date) in (6, 7, 8) then position end) over (partition by tile), max(position) over (partition by tile)) as source_position from n)
 select tile, date::varchar as date, path, position::int as position, source_position::int as source_position from s where abs(position - source_position) <= 1""")
def label_source_observations(spark, d):
    return observations.label_source(V.acquisitions(spark, d), "tile", "date", "path", 1).withColumn("date", F.col("date").cast("string"))


SEASON = "case when month(date) between 5 and 9 then 'leaf_on' when month(date) in (4, 10) then 'transition' else 'leaf_off' end"


@query(f"with {V.ACQUISITIONS}, n as (select {SEASON} as season, count(*) as n from acq group by 1) select season, n, round((select sum(n) from n) / ((select count(*) from n) * n), 8) as weight from n")
def season_weights(spark, d):
    a = V.acquisitions(spark, d).withColumn("season", D.phenological_season(F.month("date")))
    return rounded(observations.season_weights(a, "season"), 8)


@query(f"""with {V.ACQUISITIONS}, u as (select distinct tile, date from acq), n as (select *, {SEASON} as season, row_number() over (partition by tile order by date) as i from u),
 p as (select *, coalesce(max(case when month(date) in (6, 7, 8) then i end) over (partition by tile), max(i) over (partition by tile)) as s from n),
 r as (select *, case season when 'leaf_off' then 0 when 'transition' then 1 else 2 end as k from p), src as (select tile, date as source_date, k as sk from r where i = s),
 c as (select r.tile, abs(k - sk) as contrast, date::varchar as partner_date, row_number() over (partition by r.tile order by abs(k - sk) desc, date desc) as j from r join src using (tile) where i <> s)
 select src.tile, source_date::varchar as source_date, contrast::int as contrast, partner_date from src left join c on c.tile = src.tile and j = 1""")
def seasonal_pairs(spark, d):
    a = V.acquisitions(spark, d).select("tile", "date").distinct().withColumn("season", D.phenological_season(F.month("date")))
    return observations.partners(a, "tile", "date", "season").withColumn("source_date", F.col("source_date").cast("string"))


@query(f"with {V.ACQUISITIONS} select path, round((sin(2 * pi() * dayofyear(date) / dayofyear(make_date(year(date), 12, 31))) + 1) / 2, 8) as sin, round((cos(2 * pi() * dayofyear(date) / dayofyear(make_date(year(date), 12, 31))) + 1) / 2, 8) as cos from acq")
def date_encoding(spark, d):
    return rounded(V.acquisitions(spark, d).select("path", D.date_encoding(F.col("date")).alias("e")).select("path", "e.*"), 8)


@query("""with a as (select o_orderkey as id, o_orderdate::date as d, o_orderkey % 6 as k from orders),
 t as (select id, d, k, case k when 0 then strftime(d, '%Y%m%d') when 1 then strftime(d, '%Y-%m-%d') when 2 then strftime(d, '%d.%m.%Y') when 3 then strftime(d, '%Y/%m/%d') when 4 then 'Summer ' || year(d) else 'unknown' end as text from a)
 select id, case when k < 4 then d::varchar when k = 4 then year(d) || '-07-15' end as date, (case when k in (0, 1, 3) then month(d) end)::int as month from t""")
def parsed_dates(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    spelled = F.lit("unknown")
    for k, f in enumerate(D.FORMATS):
        spelled = F.when(F.col("id") % 6 == k, F.date_format("d", f)).otherwise(spelled)
    text = F.when(F.col("id") % 6 == 4, F.concat(F.lit("Summer "), F.year("d").cast("string"))).otherwise(spelled)
    return o.withColumn("t", text).select("id", D.parse_date(F.col("t")).cast("string").alias("date"), D.month_of(F.when(F.col("id") % 6 != 4, F.when(F.col("id") % 6 != 2, F.col("t")))).alias("month"))


@query("""with t as (select distinct 320000000 + (l_partkey % 60) * 10000 + 5000 + l_suppkey % 60 as k from lineitem), ids as (select k::varchar as tile_id, (k // 10000) % 1000 as e, k % 10000 as n from t)
 select a.tile_id, count(b.tile_id) < 8 as is_border from ids a left join ids b on abs(a.e - b.e) <= 1 and abs(a.n - b.n) <= 1 and a.tile_id <> b.tile_id group by a.tile_id""")
def border_tiles(spark, d):
    k = F.lit(320000000) + (F.col("l_partkey") % 60) * 10000 + 5000 + F.col("l_suppkey") % 60
    return observations.border_tiles(V.table(spark, d, "lineitem").select(k.cast("string").alias("tile_id")), "tile_id")


@query("""with r as (select doc_id as id, n_chars // 10 as height, n_chars // 20 as width from documents), h as (select id, width, unnest(range(0, (height - 64) // 32 + 1)) as r from r where height >= 64 and width >= 64)
 select id, (r * 32)::int as row_off, (c * 32)::int as col_off from (select id, r, unnest(range(0, (width - 64) // 32 + 1)) as c from h)""")
def patch_windows(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("n_chars") / 10).alias("height"), F.floor(F.col("n_chars") / 20).alias("width"))
    return observations.patch_windows(docs, "id", 64, 32)


@query("""with r as (select doc_id as id, n_chars as n from documents where n_chars > 0), s as (select distinct id, n, least(s, n - 512) as start from (select id, n, unnest(case when n <= 512 then [0] else range(0, n - 512 + 384, 384) end) as s from r where n > 512) union all select id, n, 0 from r where n <= 512),
 o as (select *, lead(start) over w is null as last from s window w as (partition by id order by start)), e as (select *, case when last then n else least(n, start + 64 + 384) end as stop from o)
 select id, start::int as start, coalesce(lag(stop) over (partition by id order by start), 0)::int as inner_start, stop::int as inner_stop from e""")
def inner_span_partition(spark, d):
    docs = V.table(spark, d, "documents").where("n_chars > 0").select(F.col("doc_id").alias("id"), "n_chars")
    return observations.axis_plan(docs, "id", "n_chars", 512, 384)


@query("""select p_brand, p_partkey, role from (select p_brand, p_partkey, case when i = n then 'best' when i = 1 then 'worst' when i = n // 2 + 1 then 'median' end as role from (select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as i, count(*) over (partition by p_brand) as n from part)) where role is not null""")
def best_median_worst(spark, d):
    return observations.best_median_worst(V.table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "role")


# Bins -----------------------------------------------------------------------------------------------------------------


@query("""select l_orderkey % 500 as k, case when v between 0 and 10 then 'B1: 0-10' when v > 0 and v <= 25 then 'B2: 10-25' when v > 0 and v <= 50 then 'B3: 25-50' when v > 0 and v <= 100 then 'B4: 50-100' end as right_closed,
 (case when v < 0 or v > 100 then null when v < 10 then 0 when v < 25 then 1 when v < 50 then 2 else 3 end)::int as left_closed, count(*) as n from (select *, l_quantity * 2.5 - 5 as v from lineitem) group by all""")
def density_bins(spark, d):
    v = F.col("l_quantity") * 2.5 - 5
    return V.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("k"), B.right_closed(v).alias("right_closed"), B.left_closed(v).alias("left_closed")).agg(F.count(F.lit(1)).alias("n"))


# Metrics --------------------------------------------------------------------------------------------------------------


def _confusion(reference: str = "reference", predicted: str = "predicted") -> str:
    flag = {"tp": (reference, predicted), "fp": (f"not {reference}", predicted), "fn": (reference, f"not {predicted}"), "tn": (f"not {reference}", f"not {predicted}")}
    return ", ".join(f"count(*) filter ({a} and {b}) as {k}" for k, (a, b) in flag.items())


@query(f"with {V.BOXES}, c as (select source, {_confusion()} from boxes group by source), m as (select *, {V.METRICS} from c) select source, tp, fp, fn, tn, round(iou, 8) as iou, round(f1, 8) as f1, round(\"precision\", 8) as \"precision\", round(recall, 8) as recall, round(accuracy, 8) as accuracy from m")
def confusion_by_source(spark, d):
    c = V.boxes(spark, d).groupBy("source").agg(*M.confusion(F.col("reference"), F.col("predicted")))
    return rounded(c.select("*", *M.metrics()).drop("reference_cover_pct", "model_cover_pct"), 8)


def _scored(spark, d):
    return V.samples(spark, d).select("*", *M.metrics())


_LINES = " union all ".join(f"select {{by}} '{m}' as metric, round(avg(\"{m}\"), 6) as mean, round(stddev_samp(\"{m}\"), 6) as std, round({p}, 6) as pooled, count(*) as n from {{t}} {{g}}" for m, p in {
    "iou": "sum(tp)::double / nullif(sum(tp) + sum(fp) + sum(fn), 0)", "f1": "(2 * sum(tp))::double / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)", "precision": "sum(tp)::double / nullif(sum(tp) + sum(fp), 0)",
    "recall": "sum(tp)::double / nullif(sum(tp) + sum(fn), 0)", "accuracy": "(sum(tp) + sum(tn))::double / nullif(sum(tp) + sum(fp) + sum(fn) + sum(tn), 0)"}.items())


@query(f"with {V.SAMPLES}, m as (select *, {V.METRICS} from samples) {_LINES.format(by='', t='m', g='')}")
def metrics_mean_std_pooled(spark, d):
    return rounded(M.summarise(_scored(spark, d)))


@query(f"""with {V.SAMPLES}, m as (select *, {V.METRICS} from samples), l as (select 'p_brand' as stratum, p_brand as level, * exclude (p_brand, p_type) from m union all select 'p_type', p_type, * exclude (p_brand, p_type) from m where p_type is not null)
 {_LINES.format(by='stratum, level,', t='l', g='group by stratum, level').replace(', 6) as pooled', ', 6) as p0')}""".replace("round(sum", "coalesce(round(sum").replace("round((2", "coalesce(round((2").replace("round((sum", "coalesce(round((sum").replace(", 6) as p0", ", 6), 1) as pooled"))
def strata_long(spark, d):
    return rounded(M.strata_long(_scored(spark, d), ["p_brand", "p_type"]))


@query(f"""with {V.SAMPLES}, m as (select *, {V.METRICS}, 100.0 * (tp + fn) / nullif(tp + fp + fn + tn, 0) as r, coalesce(100.0 * (tp + fp) / nullif(tp + fp + fn + tn, 0), 0) as p from samples)
 select sample, round(case when r = 0 and p = 0 then 1 when r = 0 then 0 else iou end, 6) as iou, round(case when r = 0 and p = 0 then 1 when r = 0 then 0 else f1 end, 6) as f1, round(case when r = 0 and p = 0 then 1 when r = 0 then 1 - p / 100 else accuracy end, 6) as accuracy from m""")
def zero_reference_scored(spark, d):
    s = _scored(spark, d).withColumnsRenamed({"reference_cover_pct": "lidar_tree_cover_pct", "model_cover_pct": "model_tree_cover_pct"})
    return rounded(M.score_zero_reference(s).select("sample", "iou", "f1", "accuracy"))


# Rasters --------------------------------------------------------------------------------------------------------------


@query(f"with {V.RASTERS}, n as (select tile, r // 2 as row, c // 2 as col, v, count(*) as k from pixels group by all) select tile, row::int as row, col::int as col, v as value from (select *, row_number() over (partition by tile, row, col order by k desc, v) as i from n) where i = 1")
def majority_vote(spark, d):
    return raster.majority(raster.pixels(V.rasters(spark, d), "tile", "values", 8), "tile", 2, 8, 8)


@query(f"with {V.RASTERS} select tile, round(100.0::double * count(*) filter (x >= 0.1 and v <> 255) / nullif(count(*) filter (v <> 255), 0), 6) as cover from (select *, case when v = 255 then null else x end as y from pixels) group by tile")
def zonal_height(spark, d):
    heights = F.zip_with("value", "values", lambda x, v: F.when(v == 255, -9999.0).otherwise(F.when(x >= F.lit(0.1), 3.0).otherwise(2.9)))
    return rounded(V.rasters(spark, d).select("tile", raster.zonal(heights, "height", -9999.0).alias("cover")))


@query(f"with {V.RASTERS} select tile, round(avg(case when v <> 255 then abs(x) * 100 end), 6) as cover from pixels group by tile")
def zonal_cover(spark, d):
    share = F.zip_with("value", "values", lambda x, v: F.when(v == 255, 255.0).otherwise(F.abs(x) * 100))
    return rounded(V.rasters(spark, d).select("tile", raster.zonal(share, "cover", 255.0).alias("cover")))


@query(f"with {V.RASTERS}, s as (select tile, count(*) filter (v <> 255) as n, count(*) filter (v = 1) as t from pixels group by tile) select tile, round(64 * 0.04::double / 10000, 8) as tile_area_ha, round(n * (0.04::double / 10000), 8) as land_area_ha, round(t * (0.04::double / 10000), 8) as tree_area_ha, round(coalesce(100.0::double * t / nullif(n, 0), 0), 8) as tree_cover_pct from s")
def tile_pixel_stats(spark, d):
    return rounded(raster.tile_statistics(V.rasters(spark, d).select("tile", "values"), 0.04).drop("error"), 8)


@query(f"with {V.RASTERS}, p as (select tile // 2 as pair, r, c, max(case when tile % 2 = 0 then (v = 1)::int end) as a, max(case when tile % 2 = 1 then (v = 1)::int end) as b from pixels group by all), k as (select pair, case when a = 1 and b = 1 then 'TP' when b = 1 then 'FP' when a = 1 then 'FN' else 'TN' end as class from p where a is not null and b is not null) select pair, class, count(*) as n from k group by all")
def difference_image_counts(spark, d):
    flags = V.rasters(spark, d).select("tile", F.transform("values", lambda v: v == 1).alias("f"))
    one = flags.where("tile % 2 = 0").select(F.floor(F.col("tile") / 2).alias("pair"), F.col("f").alias("a"))
    two = flags.where("tile % 2 = 1").select(F.floor(F.col("tile") / 2).alias("pair"), F.col("f").alias("b"))
    return one.join(two, "pair").select("pair", F.explode(M.difference_classes(F.col("a"), F.col("b"))).alias("class")).groupBy("pair", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {V.RASTERS} select tile, count(*) filter (v = 255) as n_nodata, count(*) filter (v = 1) as n_tree, false as has_bad_code from pixels group by tile")
def code_check(spark, d):
    r = V.rasters(spark, d)
    n = lambda k: F.size(F.filter("values", lambda v: v == k)).cast("long")
    return r.select("tile", n(255).alias("n_nodata"), n(1).alias("n_tree"), B.bad_codes(F.col("values")).isNotNull().alias("has_bad_code"))


@query(f"with {V.POINTS} select least(9, floor(y / 2))::int as row, least(9, floor(x / 2))::int as col, max(z) as top, min(case when classification = 2 then z end) as ground from points group by all")
def chm_grid_max_min(spark, d):
    return raster.grid_extremes(V.points(spark, d), 0.0, 0.0, 2.0, 10, 10)


def _beside(cells: str, flag: str, out: str) -> str:
    """CTEs: of each cell whether its part (cells of equal flag, by sides) has at most two cells, and that part's first cell."""
    return f"""{out}_n as (select a.tile, a.i, a.{flag} as f, count(b.i) as n, min(b.i) as j from {cells} a left join (select x.tile, x.i as at, y.i, y.{flag} as f from {cells} x join beside on beside.i = x.i
   join {cells} y on y.tile = x.tile and y.i = beside.j) b on b.tile = a.tile and b.at = a.i and b.f = a.{flag} group by all),
 {out} as (select a.tile, a.i, a.f, a.n = 0 or (a.n = 1 and b.n = 1) as small, least(a.i, coalesce(a.j, a.i)) as part from {out}_n a left join {out}_n b on b.tile = a.tile and b.i = a.j)"""


HEIGHTS = f"""{V.CANOPY}, middle as (select tile, median(ground) as g from canopy where mode = 2 group by tile),
 least_top as (select tile, min(top) as m from canopy where mode = 1 group by tile),
 around as (select a.tile, a.i, min(coalesce(b.top, m)) as g from canopy a join canopy b on a.tile = b.tile and abs(a.r - b.r) <= 2 and abs(a.c - b.c) <= 2 join least_top l on l.tile = a.tile where a.mode = 1 group by all),
 high as (select c.tile, c.i, c.r, c.c, c.building, case when c.top is not null then least(100.0, greatest(0.0, c.top - case mode when 0 then plane when 1 then around.g else middle.g end)) end as h
  from canopy c left join around on around.tile = c.tile and around.i = c.i left join middle on middle.tile = c.tile)"""


@query(f"""with {HEIGHTS}, beside as (select a.i, b.i as j from range(64) a(i), range(64) b(i) where abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) = 1),
 t0 as (select tile, i, coalesce(h >= 3, false) as t, h is null as nd from high), {_beside("t0", "t", "p0")},
 t1 as (select tile, i, f or small as t from p0), {_beside("t1", "t", "p1")},
 t2 as (select tile, i, f and not small as t from p1), {_beside("t0", "nd", "gap")},
 votes as (select g.tile, g.part, 2 * count(*) filter (t2.t) >= count(*) as tree from gap g join beside using (i) join t2 on t2.tile = g.tile and t2.i = beside.j join t0 on t0.tile = g.tile and t0.i = beside.j
  where g.f and g.small and not t0.nd group by all)
 select high.tile as "window", high.r::int as row, high.c::int as col, round(h, 6) as height_m, coalesce(case when t0.nd then votes.tree else t2.t end, false) and not building as is_tree, t0.nd and votes.tree is null as is_nodata
 from high join t0 using (tile, i) join t2 using (tile, i) join gap using (tile, i) left join votes on votes.tile = gap.tile and votes.part = gap.part and gap.f and gap.small""")
def chm_interpolated(spark, d):
    cells = V.canopy_cells(spark, d)
    return rounded(canopy.canopy_masks(cells.withColumnRenamed("tile", "window"), "window", 8, 8, resolution=2.0))


@query(f"with {HEIGHTS} select tile as \"window\", (r - 2)::int as row, (c - 2)::int as col, round(h, 6) as height_m from high where r between 2 and 5 and c between 2 and 5")
def canopy_without_buffer(spark, d):
    cells = V.canopy_cells(spark, d).withColumnRenamed("tile", "window")
    return rounded(canopy.canopy_masks(cells, "window", 8, 8, resolution=2.0, buffer_px=2).select("window", "row", "col", "height_m"))


@query(f"with {V.RASTERS} select tile, r::int // 4 as row, c::int // 4 as col, round(avg(x), 6) as value from pixels group by all")
def resampled_average(spark, d):
    out = raster.resampled(V.rasters(spark, d).select("tile", F.col("value").alias("values")), "tile", 8, 8, 2, 2)
    return rounded(raster.pixels(out, "tile", "values", 2))


@query(f"with {V.RASTERS}, m as (select label, r, c, avg(x) as a, avg(-x * 0.5::double) as b from pixels join rasters using (tile) group by all) select label, r::int as row, c::int as col, case when b > a then 1 else 0 end as class, round(1 - 1 / (1 + exp(-abs(b - a))), 6) as uncertainty from m")
def pooled_logits(spark, d):
    r = V.rasters(spark, d).select("label", F.posexplode("value").alias("i", "l0"))
    long = r.select("label", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).alias("col"), "l0", (-F.col("l0") * 0.5).alias("l1"))
    out = raster.pooled_logits(long.withColumnRenamed("label", "group"), "group")
    return rounded(out.select(F.col("group").alias("label"), "row", "col", F.col("label").alias("class"), "uncertainty"))


# Links ----------------------------------------------------------------------------------------------------------------


@query(f"with {V.LINKS}, b as (select tile, date from links where product in ('dop', 'bdom') group by all having count(distinct product) = 2) select tile, date::varchar as date, product from links where product = 'dgm' or (tile, date) in (select (tile, date) from b)")
def pair_acquisitions(spark, d):
    return L.paired(V.links(spark, d), "dop", "bdom")[0].withColumn("date", F.col("date").cast("string"))


@query(f"with {V.LINKS}, i as (select distinct tile, date from links where product = 'dop'), g as (select tile, date from links where product = 'dgm') select g.tile, coalesce(i.date, g.date)::varchar as date, g.date::varchar as source_date from g left join i using (tile)")
def expand_ground_models(spark, d):
    x = V.links(spark, d)
    pick = lambda p: x.where(F.col("product") == p).select("tile", "date")
    out = L.expand_ground(pick("dgm"), pick("dop"))
    return out.select("tile", F.col("date").cast("string").alias("date"), F.col("source_date").cast("string").alias("source_date"))


@query(f"with {V.LINKS} select tile, date::varchar as date from links where product = 'dop' except select tile, date::varchar from links where product = 'bdom'")
def missing_acquisitions(spark, d):
    x = V.links(spark, d).withColumn("date", F.col("date").cast("string"))
    expected = x.where("product = 'dop'").groupBy("tile").agg(F.array_join(F.collect_set("date"), ", ").alias("dates"))
    return L.missing_acquisitions(expected, x.where("product = 'bdom'"))


@query("""with p as (select l_partkey as tile_id, case when l_quantity > 25 then 'train' else 'val' end as split, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_quantity desc) as i from lineitem where l_partkey % 3 <> 0)
 select p_partkey as tile_id, p_name, split from part join p on p_partkey = tile_id where i = 1""")
def published_splits(spark, d):
    pos = F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("pos")
    published = V.table(spark, d, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").cast("string").alias("tile_id"), F.when(F.col("l_quantity") > 25, "train").otherwise("val").alias("split"), pos)
    patches = V.table(spark, d, "part").select(F.col("p_partkey").alias("tile_id"), "p_name", F.lit("none").alias("split"))
    return L.apply_splits(patches, published)


@query(f"with {V.LINKS} select product, count(*) as n, count(distinct tile) as n_tiles from links group by product")
def fetch_report(spark, d):
    return L.fetch_report(V.links(spark, d))


# Spatial --------------------------------------------------------------------------------------------------------------


@query(f"with {V.TILES}, {V.UNITS} select u.unit, count(*) as n, round(sum(t.land_area_km2), 6) as km2 from tiles t join units u on lon_c > x0 and lon_c < x1 and lat_c > y0 and lat_c < y1 group by u.unit")
def point_in_unit_join(spark, d):
    p = V.tiles(spark, d).select(F.col("lon_c").alias("x"), F.col("lat_c").alias("y"), "land_area_km2")
    return rounded(spatial.points_in_boxes(p, V.units(spark, d), 1.0).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("land_area_km2").alias("km2")))


@query(f"with {V.TILES}, {V.UNITS}, t as (select *, row_number() over () as k from tiles) select count(*) filter (h) as n_on_land, count(*) filter (not h) as n_off_land from (select k, bool_or(coalesce(unit % 2 = 0, false)) as h from (select k, u.unit from t left join units u on lon_c > x0 and lon_c < x1 and lat_c > y0 and lat_c < y1) group by k)")
def on_land_flag(spark, d):
    p = V.tiles(spark, d).select(F.col("lon_c").alias("x"), F.col("lat_c").alias("y"))
    p = p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.struct("x", "y"))
    flagged = spatial.flag_points(p, "id", V.units(spark, d).where("unit % 2 = 0"), 1.0)
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return flagged.agg(n(F.col("on_land")).alias("n_on_land"), n(~F.col("on_land")).alias("n_off_land"))


BOX_SQL = "b as (select o_orderkey as id, (o_custkey % 1000)::double as x0, (o_orderkey % 900)::double as y0, (o_custkey % 1000 + 2)::double as x1, (o_orderkey % 900 + 2)::double as y1 from orders), p as (select p_partkey as part, (p_partkey % 997)::double as x0, (p_size * 17 % 889)::double as y0, (p_partkey % 997 + 3)::double as x1, (p_size * 17 % 889 + 3)::double as y1 from part)"


@query(f"with {BOX_SQL} select id, count(*) filter (b.x0 < p.x1 and p.x0 < b.x1 and b.y0 < p.y1 and p.y0 < b.y1) as n_open, count(*) as n_closed from b join p on b.x0 <= p.x1 and p.x0 <= b.x1 and b.y0 <= p.y1 and p.y0 <= b.y1 group by id")
def bbox_range_join(spark, d):
    def box(df, key, x, y, size):
        return df.select(key, x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + size).cast("double").alias("x1"), (y + size).cast("double").alias("y1"))

    o = box(V.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), "id", F.col("o_custkey") % 1000, F.col("id") % 900, 2)
    p = box(V.table(spark, d, "part").withColumnRenamed("p_partkey", "part"), "part", F.col("part") % 997, F.col("p_size") * 17 % 889, 3)
    return spatial.overlaps_of_boxes(o, p, "id", 8.0)


@query()
def utm_round_trip(spark, d):
    """Centres of tiles to geographic coordinates and back; checked by tests to a millimetre."""
    t = V.candidates(spark, d).select("pos", (F.lit(300000.0) + (F.col("cell") % 400) * 1000 + 500).alias("x"), (F.lit(5300000.0) + (F.col("pos") % 700) * 1000 + 500).alias("y"), (32 + F.col("pos") % 2).alias("zone"))
    t = t.withColumn("g", P.utm_to_lonlat(F.col("x"), F.col("y"), F.col("zone")))
    t = t.withColumn("b", P.lonlat_to_utm(F.col("g.lon"), F.col("g.lat"), F.col("zone")))
    return rounded(t.select("pos", "g.lon", "g.lat", (F.col("b.x") - F.col("x")).alias("dx"), (F.col("b.y") - F.col("y")).alias("dy"), P.geodesic_area_factor(F.col("x"), F.col("y"), F.col("zone")).alias("area_factor")), 7)


@query("select count(*) as n, 0::bigint as n_far from orders")
def utm_round_trip_error(spark, d):
    """Tile centres that come back over a millimetre away."""
    far = F.greatest(F.abs("dx"), F.abs("dy")) > 1e-3
    return utm_round_trip(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("n_far"))


# Statistics -----------------------------------------------------------------------------------------------------------


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 2) as rmse, round(avg(l_extendedprice - l_quantity), 2) as bias, count(*) as n from lineitem group by 1")
def ols_fit(spark, d):
    f = V.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.fit("l_quantity", "l_extendedprice"))
    return f.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"), F.round("bias", 2).alias("bias"), "n")


@query("select round(power(corr(l_quantity, l_extendedprice), 2), 6) as r2, round(avg(l_extendedprice - l_quantity), 2) as bias from lineitem")
def pearson_r2(spark, d):
    a = V.table(spark, d, "lineitem").agg(*stats.agreement("l_quantity", "l_extendedprice"))
    return a.select(F.round("r2", 6).alias("r2"), F.round("bias", 2).alias("bias"))


@query("""with v as (select l_returnflag, greatest(-100, least(100, 100.0::double * (l_tax * 1000 - l_quantity) / nullif(l_quantity, 0))) as v from lineitem), n as (select l_returnflag, least(floor(v) + 100, 199)::bigint as bin, count(*) as n from v group by all) select l_returnflag, bin, n, round(n / sum(n) over (partition by l_returnflag), 8) as share from n""")
def relative_diff_histogram(spark, d):
    v = B.relative_difference(F.col("l_tax") * 1000, F.col("l_quantity"))
    return rounded(stats.percent_histogram(V.table(spark, d, "lineitem").select("l_returnflag", v.alias("v")), "v", "l_returnflag"), 8)


@query("select event_type, round(median(value), 6) as p50, round(quantile_cont(value, 0.02), 6) as p02, round(quantile_cont(value, 0.98), 6) as p98 from events group by 1")
def medians_and_percentiles(spark, d):
    return rounded(stats.percentiles(V.table(spark, d, "events"), "value", [0.5, 0.02, 0.98], "event_type"))


@query("select month(o_orderdate)::int as month, case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) < 6 then 'spring' when month(o_orderdate) < 9 then 'summer' else 'autumn' end as season, count(*) as n, round(count(*)::double / sum(count(*)) over (), 8) as share from orders group by 1, 2")
def share_by_month(spark, d):
    o = V.table(spark, d, "orders").select(F.month("o_orderdate").alias("month")).withColumn("season", D.meteorological_season(F.col("month")))
    return rounded(stats.shares(o, "month", "season"), 8)


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def daily_event_window(spark, d):
    out = live.daily_counts(V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


# Sampling -------------------------------------------------------------------------------------------------------------


@query("""with s as (select p_brand, p_partkey, row_number() over (partition by p_brand order by sha256(p_partkey::varchar), p_partkey) as i, count(*) over (partition by p_brand) as n from part)
 select p_partkey, p_brand, case when n < 3 or i <= round_even(0.6::double * n, 0) then 'train' when i <= round_even(0.8::double * n, 0) then 'val' else 'test' end as split from s""")
def stratified_split(spark, d):
    return sampling.stratified_split(V.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


def _draw_candidates(spark, d):
    p = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return p.select(k, B.right_closed((F.col("o_custkey") % 101).cast("double")).alias("tcd_bin"), F.col("o_orderstatus").alias("urban"), F.date_format("o_orderdate", "yyyyMM").alias("flight_date"), ((k * 7919) % 100_000).cast("double").alias("x"), ((k * 104_729) % 100_000).cast("double").alias("y"))


@query()
def training_draw(spark, d):
    return sampling.training_draw(_draw_candidates(spark, d), "o_orderkey", "tcd_bin", dict.fromkeys(B.DENSITY_LABELS, 30), 2000.0, 3, 100)


@query(f"select b as tcd_bin, 30::bigint as got, 0::bigint as n_too_near, 0::bigint as n_flights_over from (select unnest([{', '.join(repr(x) for x in B.DENSITY_LABELS)}]) as b)")
def training_draw_rules(spark, d):
    """What holds for any draw where candidates suffice: targets met, none too near, no flight over its limit."""
    c = _draw_candidates(spark, d).select("o_orderkey", "flight_date", "x", "y")
    drawn = cut(training_draw(spark, d).join(c, "o_orderkey"))  # read four times below; the candidates once
    a, b = drawn.alias("a"), drawn.alias("b")
    near = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) < 2000.0**2
    too_near = a.join(b, (F.col("a.turn") < F.col("b.turn")) & near).agg(F.count(F.lit(1)).alias("n_too_near"))  # no more rows than the targets
    over = drawn.groupBy("flight_date").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 3).alias("n_flights_over"))
    return drawn.groupBy("tcd_bin").agg(F.count(F.lit(1)).alias("got")).crossJoin(too_near).crossJoin(over)


@query(f"select level, true as is_enough, 0::bigint as n_too_near from (select unnest([{', '.join(repr(x) for x in B.DENSITY_LABELS)}, 'F', 'O', 'P']) as level)")
def validation_draw_rules(spark, d):
    """Where candidates suffice, every level has its samples (20, or all there are if fewer) and none is too near."""
    c = _draw_candidates(spark, d)
    drawn = validation_draw(spark, d).join(c, "o_orderkey")
    a, b = drawn.alias("a"), drawn.alias("b")
    near = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) < 500.0**2
    too_near = a.join(b, (F.col("a.turn") < F.col("b.turn")) & near).agg(F.count(F.lit(1)).alias("n_too_near"))  # no more rows than the targets
    level = F.explode(F.array("tcd_bin", "urban")).alias("level")
    n = drawn.select(level).groupBy("level").agg(F.count(F.lit(1)).alias("got"))
    return n.select("level", (F.col("got") >= 20).alias("is_enough")).crossJoin(too_near)


@query(f"select b as tcd_bin, 30::bigint as got, true as is_level, 0::bigint as n_flights_over from (select unnest([{', '.join(repr(x) for x in B.DENSITY_LABELS)}]) as b)")
def balanced_draw_rules(spark, d):
    """A draw that keeps the two acquisition orders level and a limit of flights in each stratum: targets are met and the orders differ by a tenth of the draw at most."""
    order = F.when(F.col("o_orderkey") % 5 == 0, sampling.ORDERS[1]).otherwise(sampling.ORDERS[0])
    c = _draw_candidates(spark, d).withColumn("pattern", order).withColumn("months", F.array(F.substring("flight_date", 5, 2).cast("int")))
    drawn = sampling.training_draw(c, "o_orderkey", "tcd_bin", dict.fromkeys(B.DENSITY_LABELS, 30), 2000.0, 5, 100, by_stratum=True, pattern="pattern", months="months")
    drawn = drawn.join(c.select("o_orderkey", "flight_date", "pattern"), "o_orderkey")
    apart = F.abs(F.sum(F.when(F.col("pattern") == sampling.ORDERS[0], 1).otherwise(-1)))
    level = drawn.agg((apart <= F.count(F.lit(1)) / 10).alias("is_level"))
    over = drawn.groupBy("tcd_bin", "flight_date").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 5).alias("n_flights_over"))
    return drawn.groupBy("tcd_bin").agg(F.count(F.lit(1)).alias("got")).crossJoin(level).crossJoin(over)


@query()
def validation_draw(spark, d):
    return sampling.validation_draw(_draw_candidates(spark, d), "o_orderkey", ["tcd_bin", "urban"], 20, 500.0, 42)


@query("select o_orderkey, o_custkey % 1000 - 12.5::double as x0, o_orderkey % 1000 - 12.5::double as y0, o_custkey % 1000 + 12.5::double as x1, o_orderkey % 1000 + 12.5::double as y1 from orders")
def boxes_around_points(spark, d):
    p = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).cast("double").alias("x"), (F.col("o_orderkey") % 1000).cast("double").alias("y"))
    return sampling.boxes_around(p, 25.0).drop("x", "y")


@query("""select count(*) filter (not coalesce(o_totalprice >= 50000, false)) as lost_min_cover, count(*) filter (o_totalprice >= 50000 and not o_custkey % 3 > 0) as lost_has_both, count(*) filter (o_totalprice >= 50000 and o_custkey % 3 > 0 and o_custkey % 5 = 0) as lost_not_is_border from orders""")
def eligibility_costs(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("mean_tcd"), (F.col("o_custkey") % 3 > 0).alias("has_both"), (F.col("o_custkey") % 5 == 0).alias("is_border"))
    return sampling.eligible(o, 50000.0)[1]


# Windows --------------------------------------------------------------------------------------------------------------


def _text(values):
    return F.array_join(values.cast("array<string>"), ",")


def _listed(where: str, name: str, order: str = "r, c", value: str = "v") -> str:
    return f"string_agg({value}::varchar, ',' order by {order}) filter ({where}) as {name}"


@query(f"with {V.RASTERS} select tile, {_listed('r between 2 and 4 and c between 3 and 6', 'cut')}, {_listed('r between 2 and 5 and c between 2 and 5', 'centre')}, {_listed('r % 2 = 0 and c % 2 = 0', 'thinned')}, {_listed('r % 4 = 2 and c % 4 = 2', 'nearest')} from pixels group by tile")
def window_cuts(spark, d):
    v = F.col("values")
    cuts = {"cut": windows.cut(v, 8, 2, 3, 3, 4), "centre": windows.centre(v, 8, 8, 4), "thinned": windows.thinned(v, 8, 8, 4), "nearest": windows.nearest(v, 8, 8, 2, 2)}
    return V.rasters(spark, d).select("tile", *(_text(c).alias(k) for k, c in cuts.items()))


@query(f"with {V.RASTERS}, g as (select t.tile, r, c, v from (select tile, unnest(range(-1, 3)) as r from rasters) t cross join (select unnest(range(6, 10)) as c) k left join pixels p using (tile, r, c)) select tile, string_agg(coalesce(v, 255)::varchar, ',' order by r, c) as w from g group by tile")
def boundless_window(spark, d):
    return V.rasters(spark, d).select("tile", _text(windows.boundless(F.col("values"), 8, 8, -1, 6, 4, 4, 255)).alias("w"))


@query(f"with {V.RASTERS}, m as (select label % 5 as k, r, c, coalesce(arg_min(v, tile) filter (v <> 255), 255) as v from pixels join rasters using (tile) group by all) select k, string_agg(v::varchar, ',' order by r, c) as merged from m group by k")
def piece_merge(spark, d):
    p = V.rasters(spark, d).select((F.col("label") % 5).alias("k"), "tile", "values")
    return windows.merge_pieces(p, "k", "tile", "values").select("k", _text(F.col("values")).alias("merged"))


@query(f"with {V.RASTERS} select (tile % 20)::bigint as cell, (tile % 3)::bigint as stripe, count(*) filter (v <> 255) as covered, count(*) filter (v = 1) as tree, 0::bigint as n_skipped from pixels group by all")
def stripe_counts(spark, d):
    p = V.rasters(spark, d).select((F.col("tile") % 20).alias("cell"), (F.col("tile") % 3).alias("stripe"), "values")
    return windows.stripe_counts(p, "cell", "stripe", "values")


@query(f"with {V.RASTERS}, n as (select tile, count(*) filter (v = 255) as e, count(*) filter (v = 1) as t from pixels group by tile) select tile, round(100.0::double * t / (64 - e), 6) as tree_cover_pct, e / 64.0::double as nodata_share from n where e < 64 and 100.0::double * t / (64 - e) >= 45 and e / 64.0::double <= 0.08")
def usable_patches(spark, d):
    return rounded(windows.usable_patches(V.rasters(spark, d).select("tile", "values"), "values", 45.0, 0.08).drop("values"))


@query(f"with {V.RASTERS} select tile, count(*) filter (v <> 255 and x * 10 >= 3.0) as n_high, count(*) filter (v <> 255 and x * 10 < 3.0) as n_low, count(*) filter (v = 255) as n_none from pixels group by tile")
def display_classes(spark, d):
    heights = F.zip_with("value", "values", lambda x, v: F.when(v == 255, -9999.0).otherwise(x * 10))
    n = lambda test: F.size(F.filter("c", test)).cast("long")
    c = V.rasters(spark, d).select("tile", windows.display_class(heights, "height", -9999.0).alias("c"))
    return c.select("tile", n(lambda v: v == 1).alias("n_high"), n(lambda v: v == 0).alias("n_low"), n(lambda v: v.isNull()).alias("n_none"))


@query(f"with {V.RASTERS}, g as (select tile, r // 2 as gr, c // 2 as gc, x from pixels where r % 2 = 0 and c % 2 = 0), t as (select tile, r, c, x from pixels) select tile, round(sum(case when r = 0 and c = 0 then x end) - sum(case when r = 0 and c = 0 then x end), 6) as first, round(max(x) filter (r = 7 and c = 7) - max(x) filter (r = 6 and c = 6), 6) as last from t group by tile")
def surface_corners(spark, d):
    r = V.rasters(spark, d).select("tile", F.col("value").alias("top"), windows.thinned(F.col("value"), 8, 8, 4).alias("ground"))
    out = windows.surface_difference(r, "tile", (8, 8), (4, 4))
    return rounded(out.select("tile", F.get("values", F.lit(0)).alias("first"), F.get("values", F.lit(63)).alias("last")))


@query(f"""with {V.UNITS}, t as (select p_partkey as tile, 6.0::double + (p_partkey % 90) * 0.11::double as l, 54.5::double - (p_partkey % 70) * 0.11::double as t from part),
 px as (select tile, l + (i % 4 + 0.5::double) * 0.05::double as x, t - (i // 4 + 0.5::double) * 0.05::double as y from (select *, unnest(range(16)) as i from t)),
 n as (select tile, count(*) filter (exists (select 1 from units u where unit % 3 <> 0 and x > x0 and x < x1 and y > y0 and y < y1)) as n_land from px group by tile)
 select tile, case n_land when 0 then 'outside' when 16 then 'inside' else 'partial' end as status, n_land from n""")
def land_windows(spark, d):
    u = V.units(spark, d).where("unit % 3 <> 0")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = u.select("unit", F.array(F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"), point("x0", "y0"))).alias("rings"))
    k = F.col("p_partkey")
    t = V.table(spark, d, "part").select(k.alias("tile"), (F.lit(6.0) + (k % 90) * F.lit(0.11)).alias("left"), (F.lit(54.5) - (k % 70) * F.lit(0.11)).alias("top"))
    return windows.land_masks(t, rings, "tile", 4, 4, 0.05, 1.0)


@query("select o_custkey, o_orderstatus, max(year(o_orderdate))::int as year, arg_max(o_orderkey::varchar, (year(o_orderdate), o_orderkey::varchar)) as path from orders group by 1, 2")
def newest_year_lookup(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"), F.col("o_orderkey").cast("string").alias("path"))
    return observations.newest_year(o, ["o_custkey", "o_orderstatus"])


@query("""with s as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as i, count(*) over (partition by p_brand) as n from part)
 select p_brand, p_partkey from s where i in (select least(floor((k + 0.5::double) / 4 * s.n)::bigint, s.n - 1) from range(4) r(k))""")
def even_spread_picks(spark, d):
    return observations.even_spread(V.table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 4).select("p_brand", "p_partkey")


@query("""with p as (select case when p_size % 5 = 0 then 'val' else 'train' end as split, p_brand as tile_id, p_type as obs_id, p_size % 4 as cover from part), n as (select split, count(*) as n_patches, count(distinct tile_id) as n_tiles, count(distinct obs_id) as n_observations, count(*) filter (cover = 0) as n_treeless from p group by split)
 select split, coalesce(n_patches, 0) as n_patches, coalesce(n_tiles, 0) as n_tiles, coalesce(n_observations, 0) as n_observations, coalesce(n_treeless, 0) as n_treeless from (values ('train'), ('val'), ('test')) s(split) left join n using (split)""")
def split_report(spark, d):
    split = F.when(F.col("p_size") % 5 == 0, "val").otherwise("train")
    return observations.split_report(V.table(spark, d, "part").select(split.alias("split"), F.col("p_brand").alias("tile_id"), F.col("p_type").alias("obs_id"), (F.col("p_size") % 4).alias("tree_cover_pct")))


@query("select case when p_size % 5 = 0 then 'val' else 'train' end as split, string_agg(distinct p_type, ',' order by p_type) as observations from part group by 1 union all select 'test', ''")
def observations_by_split(spark, d):
    split = F.when(F.col("p_size") % 5 == 0, "val").otherwise("train")
    out = observations.observations_by_split(V.table(spark, d, "part").select(split.alias("split"), F.col("p_type").alias("obs_id")))
    return out.select("split", F.array_join("observations", ",").alias("observations"))


@query("select p_partkey, p_brand from part where p_size % 3 <> 1 and not p_type like 'ECONOMY%' and not (p_partkey % 10 = 1)")
def tile_filters(spark, d):
    p = V.table(spark, d, "part").withColumns({"Change": F.when(F.col("p_size") % 3 != 2, F.col("p_size") % 3), "exclude": F.when(F.col("p_partkey") % 10 < 5, (F.col("p_partkey") % 10 == 1).cast("int"))})
    return observations.exclude_where(observations.not_excluded(observations.unchanged(p)), "p_type like 'ECONOMY%'").select("p_partkey", "p_brand")


@query("""with i as (select p_partkey as stem, p_partkey % 50 as tile from part), m as (select l_partkey as stem, l_partkey % 50 as tile, min('m' || lpad(l_orderkey::varchar, 8, '0')) as path from lineitem where l_partkey % 3 = 0 and l_partkey % 50 < 40 group by 1, 2), n as (select tile, min(path) as near from m group by 1)
 select i.stem, i.tile, coalesce(m.path, n.near) as mask_path from i left join m on m.stem = i.stem left join n on n.tile = i.tile""")
def masks_of_images(spark, d):
    i = V.table(spark, d, "part").select(F.col("p_partkey").alias("stem"), (F.col("p_partkey") % 50).alias("tile"))
    path = F.concat(F.lit("m"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"))
    m = V.table(spark, d, "lineitem").where("l_partkey % 3 = 0 and l_partkey % 50 < 40").groupBy(F.col("l_partkey").alias("stem"), (F.col("l_partkey") % 50).alias("tile")).agg(F.min(path).alias("path"))
    return observations.with_masks(i, m)


@query(f"""with {V.TILES}, {V.SHAPES}, p as (select lon_c as x, lat_c as y, count(*) as n, sum(land_area_km2) as area from tiles group by all),
 met as (select p.x, p.y, s.unit, p.n, p.area from p join sides s on p.x between 5.9 and 20 group by p.x, p.y, s.unit, p.n, p.area having {V.WITHIN})
 select unit, sum(n)::bigint as n_points, round(sum(area), 4) as area from met group by unit""")
def polygon_with_holes_join(spark, d):
    t = V.tiles(spark, d).select(F.col("lon_c").alias("x"), F.col("lat_c").alias("y"), F.col("land_area_km2").alias("area"))
    met = polygons.points_in_polygons(t, V.shapes(spark, d), "unit", 0.25)
    return rounded(met.groupBy("unit").agg(F.count(F.lit(1)).alias("n_points"), F.sum("area").alias("area")), 4)


@query(f"""with {V.TILES}, {V.SHAPES}, p as (select distinct lon_c as x, lat_c as y from tiles), held as (select p.x, p.y from p join sides s on s.unit % 2 = 0 group by p.x, p.y, s.unit having {V.WITHIN}),
 each as (select unit, (lon_c, lat_c) in (select (x, y) from held) as excluded from tiles)
 select unit, count(*) as n, count(*) filter (excluded) as n_excluded, round((select avg(excluded::int) from each), 6) as flagged_share, (select avg(excluded::int) from each) > 0.25 as is_suspect from each group by unit""")
def excluded_by_polygons(spark, d):
    t = V.tiles(spark, d).select("unit", F.col("lon_c").alias("x"), F.col("lat_c").alias("y")).withColumn("place", F.struct("x", "y"))
    flagged = polygons.flag_inside(t.select("place", "x", "y").distinct(), "place", V.shapes(spark, d).where("unit % 2 = 0").withColumnRenamed("unit", "shape"), "shape", 0.25)
    each = t.join(flagged.select("place", "excluded"), "place")
    share = each.agg((F.count_if("excluded") / F.count(F.lit(1))).alias("flagged_share"))
    n = each.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("n_excluded"))
    return rounded(n.crossJoin(F.broadcast(share)).withColumn("is_suspect", F.col("flagged_share") > 0.25))  # one row


@query(f"""with {V.SHAPES}, diamond as (select c_custkey as parcel, 6.0::double + (c_custkey % 97) * 0.09::double as u, 47.0::double + (c_custkey % 83) * 0.085::double as v, 0.02::double + (c_custkey % 13) * 0.02::double as w from customer),
 other as (select parcel, unnest([u, u + w, u, u - w]) as ax, unnest([v - w, v, v + w, v]) as ay, unnest([u + w, u, u - w, u]) as ex, unnest([v, v + w, v, v - w]) as ey from diamond),
 crossing as (select distinct unit, parcel from sides l join other r on least(l.ax, l.ex) <= greatest(r.ax, r.ex) and least(r.ax, r.ex) <= greatest(l.ax, l.ex) and least(l.ay, l.ey) <= greatest(r.ay, r.ey) and least(r.ay, r.ey) <= greatest(l.ay, l.ey)
  where ((l.ex - l.ax) * (r.ay - l.ay) - (l.ey - l.ay) * (r.ax - l.ax)) * ((l.ex - l.ax) * (r.ey - l.ay) - (l.ey - l.ay) * (r.ex - l.ax)) <= 0
  and ((r.ex - r.ax) * (l.ay - r.ay) - (r.ey - r.ay) * (l.ax - r.ax)) * ((r.ex - r.ax) * (l.ey - r.ay) - (r.ey - r.ay) * (l.ex - r.ax)) <= 0),
 held as (select s.unit, p.parcel from (select parcel, u as x, v - w as y from diamond) p join sides s on true group by s.unit, p.parcel, p.x, p.y having {V.WITHIN}),
 corner as (select unit, ring[1].x as x, ring[1].y as y from (select unit, unnest(rings) as ring from shapes)),
 holds as (select p.unit, d.parcel from corner p join diamond d on abs(p.x - d.u) + abs(p.y - d.v) < d.w)
 select * from crossing union select * from held union select * from holds""")
def polygons_sharing_ground(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer").select(k.alias("parcel"), (F.lit(6.0) + (k % 97) * F.lit(0.09)).alias("u"), (F.lit(47.0) + (k % 83) * F.lit(0.085)).alias("v"), (F.lit(0.02) + (k % 13) * F.lit(0.02)).alias("w"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    u, v, w = map(F.col, "uvw")
    parcels = c.select("*", F.array(F.array(point(u, v - w), point(u + w, v), point(u, v + w), point(u - w, v))).alias("rings"))
    return polygons.polygons_intersecting(V.shapes(spark, d), parcels, "unit", "parcel", 0.2, lambda x, y: F.abs(x - u) + F.abs(y - v) < w)  # a diamond's corners are rounded


@query(f"""with {V.SHAPES}, t as (select p_partkey as tile, 6.0::double + (p_partkey % 90) * 0.11::double as l, 54.5::double - (p_partkey % 70) * 0.11::double as t from part),
 px as (select tile, i, l + (i % 4 + 0.5::double) * 0.05::double as x, t - (i // 4 + 0.5::double) * 0.05::double as y from (select *, unnest(range(16)) as i from t)),
 held as (select distinct tile, i from (select p.tile, p.i, s.unit from px p join sides s on true group by p.tile, p.i, p.x, p.y, s.unit having {V.WITHIN})),
 n as (select t.tile, count(held.i) as n_land from t left join held using (tile) group by t.tile)
 select tile, case n_land when 0 then 'outside' when 16 then 'inside' else 'partial' end as status, n_land from n""")
def land_windows_with_holes(spark, d):
    k = F.col("p_partkey")
    t = V.table(spark, d, "part").select(k.alias("tile"), (F.lit(6.0) + (k % 90) * F.lit(0.11)).alias("left"), (F.lit(54.5) - (k % 70) * F.lit(0.11)).alias("top"))
    return windows.land_masks(t, V.shapes(spark, d), "tile", 4, 4, 0.05, 0.1)


#: The newest date of each cell: years of orders, 0 for those of low priority, on the ground of a customer's number.
GROUND = """ground as (select zone, cx, cy, max(date) as date from (select o_custkey % 2 as zone, o_custkey // 2 % 31 as cx, o_custkey // 62 as cy,
  case when o_orderpriority = '5-LOW' then 0 else year(o_orderdate)::int end as date from orders where o_custkey % 5 <> 4) group by all)"""


@query(f"""with {GROUND}, side as (select zone, date, cx, cy, unnest([(1, 0), (-1, 0), (0, 1), (0, -1)]) as s from ground),
 free as (select zone, date, count(*) as n from side x where not exists (select 1 from ground g where g.zone = x.zone and g.date = x.date and g.cx = x.cx + s[1] and g.cy = x.cy + s[2]) group by all),
 quad as (select zone, date, x, y, count(*) as n, count(distinct dx) = 2 and count(distinct dy) = 2 as diagonal from (select zone, date, cx + dx as x, cy + dy as y, dx, dy from ground, range(2) a(dx), range(2) b(dy)) group by all),
 euler as (select zone, date, (count(*) filter (n = 1) - count(*) filter (n = 3) + 2 * count(*) filter (n = 2 and diagonal)) // 4 as euler from quad group by all)
 select g.zone, g.date, round(count(*) * 1e6, 3) as area_m2, round(any_value(free.n) * 1000.0::double, 3) as perimeter_m, any_value(euler.euler)::bigint as shells_less_holes, true as is_closed
 from ground g join free using (zone, date) join euler using (zone, date) group by all""")
def coverage_outlines(spark, d):
    """Rings of the ground that each year is the newest for: areas, lengths and the Euler number of each year's cells."""
    o = V.table(spark, d, "orders").where("o_custkey % 5 <> 4")
    k = F.col("o_custkey")
    date = F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.year("o_orderdate"))
    tiles = o.select((k % 2).alias("zone"), (F.floor(k / 2) % 31).alias("cx"), F.floor(k / 62).alias("cy"), date.alias("date"))
    rings = polygons.coverage_polygons(tiles, "zone", "date", 1000.0)
    closed = (F.element_at("ring", 1) == F.element_at("ring", -1)) & (F.size("ring") == F.col("n_corners") + 1)
    each = rings.groupBy("zone", "date").agg(F.sum("area").alias("area_m2"), F.sum("perimeter").alias("perimeter_m"), F.sum(F.when(F.col("is_hole"), -1).otherwise(1)).alias("shells_less_holes"), F.every(closed).alias("is_closed"))
    return rounded(each, 3)


@query(f"""with {V.RASTERS}, mosaic as (select tile % 25 as x, tile // 25 as y, tile % 25 * 8 + c as gx, tile // 25 * 8 + r as gy, v from pixels),
 spot as (select t.x, t.y, i, t.x * 8 + i % 12 - 2 as gx, t.y * 8 + i // 12 - 2 as gy from (select distinct x, y from mosaic) t, range(144) n(i))
 select spot.x::bigint as x, spot.y::bigint as y, count(*) filter (m.v is null) as n_fill, sum((i + 1) * coalesce(m.v, -1))::bigint as weighted from spot left join mosaic m using (gx, gy) group by all""")
def halo_of_neighbours(spark, d):
    t = F.col("tile")
    tiles = V.rasters(spark, d).select((t % 25).alias("x"), F.floor(t / 25).alias("y"), "values")
    out = windows.with_halo(tiles, "x", "y", "values", 8, 8, 2, -1)
    weighted = F.aggregate(F.transform("values", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("x", "y", F.size(F.filter("values", lambda v: v == -1)).cast("long").alias("n_fill"), weighted.alias("weighted"))


@query(f"with {V.RASTERS}, p as (select tile % 40 as area, case when v = 255 then 255 else abs(x) * 400 end as v from pixels) select area, round(coalesce(avg(v) filter (v <> 255 and v <= 100), 0.0::double), 6) as cover from p group by area")
def pooled_cover_of_rasters(spark, d):
    v = F.zip_with("value", "values", lambda x, c: F.when(c == 255, 255.0).otherwise(F.abs(x) * 400))
    return rounded(raster.pooled_cover(V.rasters(spark, d).select((F.col("tile") % 40).alias("area"), v.alias("v")), "area", "v", 255.0))


@query(f"""with {V.RASTERS}, p as (select tile % 40 as area, floor(abs(x) * 20)::int as v from pixels where v <> 255), n as (select area, v, count(*) as n from p group by all)
 select area, arg_max(v, n * 1000 - v) as modal_class, round(sum(n) filter (v in (2, 3)) / sum(n)::double, 6) as urban_share from n group by area""")
def modal_class_and_urban_share(spark, d):
    v = F.zip_with("value", "values", lambda x, c: F.when(c == 255, 255).otherwise(F.floor(F.abs(x) * 20).cast("int")))
    return rounded(raster.class_shares(V.rasters(spark, d).select((F.col("tile") % 40).alias("area"), v.alias("v")), "area", "v", [2, 3], 255))


# Outcome rows ---------------------------------------------------------------------------------------------------------

#: Rasters of which some are missing (every 11th) and some cut short (every 13th), as observations of 8 x 8 pixels.
WHOLE = "tile % 11 <> 0 and tile % 13 <> 0"


@query(f"""with {V.RASTERS}, w as (select tile, i // 3 * 2 as row_off, i % 3 * 2 as col_off from rasters, range(9) t(i) where {WHOLE}),
 n as (select w.tile, row_off, col_off, count(*) filter (v <> 255) as valid, count(*) filter (v = 1) as tree from w join pixels p on p.tile = w.tile and r >= row_off and r < row_off + 4 and c >= col_off and c < col_off + 4 group by all),
 good as (select tile, (row_number() over (partition by tile order by row_off, col_off) - 1)::int as patch_no, row_off::int as row_off, col_off::int as col_off, round(100.0::double * tree / valid, 2) as tree_cover_pct, 'ok' as status from n where valid > 0 and 1 - valid / 16.0::double <= 0.15 and 100.0::double * tree / valid >= 40)
 select * from good union all
 select tile, null, null, null, null, case when {WHOLE} then 'no_patch' else 'unreadable' end from rasters where tile not in (select tile from good)""")
def patches_of_observations(spark, d):
    r = V.rasters(spark, d)
    t = F.col("tile")
    stored = r.where(t % 11 != 0).select("tile", F.lit(8).alias("height"), F.lit(8).alias("width"), F.when(t % 13 == 0, F.slice("values", 1, 60)).otherwise(F.col("values")).alias("values"))
    return outcomes.patch_outcomes(r.select("tile"), stored, "tile", 4, 2, least_cover=40.0, most_nodata=0.15)


@query(f"""with {V.RASTERS}, n as (select tile, max(abs(x)) as top, count(*) filter (r between 2 and 5 and c between 2 and 5 and x >= 0) as tree from pixels group by tile),
 o as (select tile, case when tile % 7 = 0 then 'skipped' when tile % 5 = 0 then 'unavailable' when tile % 13 = 0 or top > 0.3 then 'error' else 'ok' end as status, tree from n)
 select status, count(*) as n, round(avg(100.0::double * tree / 16) filter (status = 'ok'), 6) as tree_cover_pct from o group by status""")
def prediction_statuses(spark, d):
    def predict(image):
        if abs(image).max() > 0.3:
            raise ValueError("out of range")
        return (image >= 0).astype(int)

    r, t = V.rasters(spark, d), F.col("tile")
    stored = r.where(t % 5 != 0).select("tile", F.when(t % 13 == 0, F.slice("value", 1, 60)).otherwise(F.col("value")).alias("values"))
    made = outcomes.prediction_outcomes(r.select("tile"), r.where(t % 7 == 0), stored, "tile", predict, 4, 4, halo=2)
    return rounded(outcomes.by_status(made, mean="tree_cover_pct"))


@query(f"""with {V.RASTERS}, box as (select tile, label, case when tile % 9 = 0 then 'no_reference' when tile % 11 = 0 then 'no_prediction' when tile % 17 = 0 then 'unexpected_code' else 'ok' end as status from rasters where tile % 6 <> 5),
 vote as (select tile, r // 2 as r, c // 2 as c, count(*) filter (v = 1) > count(*) filter (v = 0) and count(*) filter (v = 1) >= count(*) filter (v = 255) as p from pixels group by all),
 cell as (select b.tile, p.v, coalesce(q.p, false) as p from box b join pixels p on p.tile = b.tile and p.r < 5 and p.c < 5 left join vote q on q.tile = b.tile and q.r = p.r and q.c = p.c where b.status = 'ok' and p.v <> 255),
 n as (select tile, count(*) filter (v = 1 and p) as tp, count(*) filter (v <> 1 and p) as fp, count(*) filter (v = 1 and not p) as fn, count(*) filter (v <> 1 and not p) as tn from cell group by tile),
 m as (select tile, tp, fp, fn, tn, {V.METRICS} from n)
 select box.tile as sample_id, box.label::bigint as label, box.status, case when box.status = 'ok' then coalesce(tp, 0) end as tp, case when box.status = 'ok' then coalesce(fp, 0) end as fp, case when box.status = 'ok' then coalesce(fn, 0) end as fn, case when box.status = 'ok' then coalesce(tn, 0) end as tn,
  round(iou, 6) as iou, round(f1, 6) as f1, round("precision", 6) as "precision", round(recall, 6) as recall, round(accuracy, 6) as accuracy from box left join m using (tile)""")
def scored_boxes(spark, d):
    """Box for box: references of 5 x 5 pixels, predictions of 8 x 8 halved onto their grid and padded."""
    r, t = V.rasters(spark, d), F.col("tile")
    boxes = outcomes.boxes_to_score(r.select("tile", F.col("label").cast("long").alias("label"), (t % 6 == 5).cast("int").alias("exclude")), "tile").drop("exclude")
    five = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("values", i * 8 + 1, F.lit(5))))
    references = r.where(t % 9 != 0).select(F.col("tile").alias("sample_id"), five.alias("values"))
    codes = F.when(t % 17 == 0, F.transform("values", lambda v, i: F.when(i == 3, 7).otherwise(v))).otherwise(F.col("values"))
    predictions = r.where(t % 11 != 0).select(F.col("tile").alias("sample_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), codes.alias("values"))
    scored = outcomes.score_outcomes(boxes, references, predictions, "sample_id", 5, 5, 2)
    return rounded(scored.drop("tile", "reference_cover_pct", "model_cover_pct"))


@query(f"""with {V.POINTS}, box as (select c_custkey as sample, c_mktsegment as segment, (c_custkey % 23)::double as x0, (c_custkey // 23 % 23)::double as y0, case when c_custkey % 19 = 0 then 0.0::double else 2.0::double end as w from customer),
 tile as (select n_nationkey % 5 * 5.0::double as x0, n_nationkey // 5 * 5.0::double as y0 from nation where n_nationkey % 4 <> 3),
 hit as (select sample from box b where exists (select 1 from tile t where b.x0 <= t.x0 + 4 and t.x0 <= b.x0 + w and b.y0 <= t.y0 + 4 and t.y0 <= b.y0 + w)),
 spot as (select x, y, count(*) as k from points where (x * 3 + y)::bigint % 7 <> 0 group by all),
 n as (select sample, sum(k)::bigint as n from box join spot p on p.x between x0 - 0.5 and x0 + w + 0.5 and p.y between y0 - 0.5 and y0 + w + 0.5 group by sample)
 select sample, segment, case when sample % 8 = 0 then 'cached' when hit.sample is null then 'no_lidar_tile' when n.n is null then 'no_points' when w = 0 then 'chm_failed' else 'ok' end as status,
  case when sample % 8 = 0 or hit.sample is null then 0 else coalesce(n.n, 0) end::bigint as n_points from box left join hit using (sample) left join n using (sample)""")
def reference_statuses(spark, d):
    """What becomes of each validation box on its way to a mask."""
    k = F.col("c_custkey")
    w = F.when(k % 19 == 0, 0.0).otherwise(2.0)
    at = V.table(spark, d, "customer").select(k.alias("sample"), F.col("c_mktsegment").alias("segment"), (k % 23).cast("double").alias("x0"), (F.floor(k / 23) % 23).cast("double").alias("y0"), w.alias("_w"))
    boxes = at.select("sample", "segment", "x0", "y0", (F.col("x0") + F.col("_w")).alias("x1"), (F.col("y0") + F.col("_w")).alias("y1"))
    n = F.col("n_nationkey")
    lidar = V.table(spark, d, "nation").select((n % 5 * F.lit(5.0)).alias("x0"), (F.floor(n / 5) * F.lit(5.0)).alias("y0"), F.when(n % 4 == 3, "").otherwise(F.concat(F.lit("tile/"), n.cast("string"))).alias("url"))
    lidar = lidar.select("x0", "y0", (F.col("x0") + 4).alias("x1"), (F.col("y0") + 4).alias("y1"), "url")
    points = V.points(spark, d).where((F.col("x") * 3 + F.col("y")).cast("long") % 7 != 0)
    told, _ = outcomes.reference_outcomes(boxes, boxes.where("sample % 8 = 0"), lidar, points, "sample", 4.0, buffer=0.5)
    return told.select("sample", "segment", "status", "n_points")


#: Status codes that the recorded service gives, attempt by attempt, by an order's priority.
RECORDED = {"1-URGENT": [200], "2-HIGH": [503, 200], "3-MEDIUM": [400], "4-NOT SPECIFIED": [503, 503, 503], "5-LOW": [503, 503, 200]}


@query("""with a as (select o_orderkey as tile, o_custkey % 4 as k, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 1 else 3 end as attempts,
  case o_orderpriority when '3-MEDIUM' then 'refused' when '4-NOT SPECIFIED' then 'unreachable' else 'ok' end as status from orders)
 select status, attempts::int as attempts, count(*) as n_requests, sum(case when status = 'ok' then k else 0 end)::bigint as n_items from a group by all""")
def recorded_service(spark, d):
    """Requests to a recorded service with its failures: retried, refused at once, or given up."""

    def ask(request, attempt):
        code = RECORDED[request["priority"]][attempt - 1]
        if code == 400:
            raise answers.Refused("no such product")
        if code != 200:
            raise ConnectionError(str(code))
        return request["recorded"]

    k = F.col("o_custkey") % 4
    items = F.transform(F.slice(F.array(*map(F.lit, (1, 2, 3))), F.lit(1), k.cast("int")), lambda i: F.struct(i.alias("gsd")))
    body = F.to_json(F.struct(items.alias("items")))
    got = answers.fetch(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), F.col("o_orderpriority").alias("priority"), body.alias("recorded")), ask, pause=0.0)
    n = tables.recorded_answers(got.where("status = 'ok'").select("tile", "body"), "gsd: int").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return got.join(n, "tile", "left").groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("n_requests"), F.sum(F.coalesce("n", F.lit(0).cast("long"))).alias("n_items"))


@query("""with p as (select p_partkey as mosaic, p_size * 37 as h, floor(p_retailprice / 2)::int as w from part), a as (select mosaic, unnest(range(0, h, 256)) as row_off, h, w from p), b as (select *, unnest(range(0, w, 256)) as col_off from a)
 select mosaic, 'r' || lpad(row_off::varchar, 7, '0') || '_c' || lpad(col_off::varchar, 7, '0') as tile_id, row_off::int as row_off, col_off::int as col_off, least(256, h - row_off)::int as height, least(256, w - col_off)::int as width from b""")
def mosaic_windows(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("mosaic"), (F.col("p_size") * 37).cast("int").alias("height"), F.floor(F.col("p_retailprice") / 2).cast("int").alias("width"))
    return observations.mosaic_windows(p, "mosaic", 256)


@query(f"with {V.CANDIDATES}, c as (select cell, max((date, state, name)) as w, count(*) as n from candidates group by cell) select count(*) as n_cells, count(*) filter (n > 1) as n_contested, count(*) filter (n > 1 and w[1] = '00000000') as n_undated_winners, round(100.0::double * count(*) filter (n > 1) / count(*), 6) as contested_pct from c")
def contest_summary(spark, d):
    return rounded(overlap.contest_summary(V.candidates(spark, d), ["cell"]))


@query("""select month::int as month, coalesce(n, 0) as n, round(100.0::double * coalesce(n, 0) / sum(n) over (), 6) as share_pct from range(1, 13) t(month) left join
 (select month(o_orderdate) as month, count(*) as n from orders where o_orderstatus = 'F' and month(o_orderdate) <> 5 group by all) using (month)""")
def flight_months_of_draw(spark, d):
    o = V.table(spark, d, "orders").where("o_orderstatus = 'F' and month(o_orderdate) <> 5")
    flights = o.groupBy("o_custkey").agg(F.collect_list(F.month("o_orderdate")).alias("months"))
    return rounded(sampling.months_of_draw(flights, "months"))


#: Published totals that the comparison holds the patches against.
PUBLISHED = {"tiles": 200, "observations": 1500, "patches": 6005, "train_patches": 2000, "val_patches": 2100}


@query("""with n as (select count(distinct l_partkey) as tiles, count(distinct l_orderkey) as observations, count(*) as patches, count(*) filter (l_returnflag = 'N') as train_patches, count(*) filter (l_returnflag = 'A') as val_patches from lineitem)
 select name, published, actual, published = actual as is_equal from (select 'tiles' as name, 200::bigint as published, tiles as actual from n union all select 'observations', 1500, observations from n union all select 'patches', 6005, patches from n union all select 'train_patches', 2000, train_patches from n union all select 'val_patches', 2100, val_patches from n)""")
def totals_against_published(spark, d):
    split = F.when(F.col("l_returnflag") == "N", "train").when(F.col("l_returnflag") == "A", "val").otherwise("test")
    patches = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("tile_id"), F.col("l_orderkey").alias("obs_id"), split.alias("split"))
    return observations.compared_totals(patches, PUBLISHED)
