"""The driver's tables seen as land-cover tables: each view as DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_nationkey").alias("unit"),
        (F.lit(6.0) + (F.col("l_partkey") % 450) * F.lit(0.02)).alias("lon_c"),
        (F.lit(47.0) + (F.col("l_orderkey") % 600) * F.lit(0.012)).alias("lat_c"),
        (F.col("l_quantity") / 50.0).alias("land_area_km2"),
        F.when(~((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 4)), F.col("l_discount") * 1000).alias("our_pct"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 1000).alias("prod_a"),
    )


TILES = """tiles as (select s_nationkey as unit, 6.0::double + (l_partkey % 450) * 0.02::double as lon_c,
  47.0::double + (l_orderkey % 600) * 0.012::double as lat_c, l_quantity / 50.0::double as land_area_km2,
  case when not (l_returnflag = 'N' and l_linenumber = 4) then l_discount * 1000 end as our_pct,
  case when l_returnflag <> 'R' then l_tax * 1000 end as prod_a
  from lineitem join supplier on l_suppkey = s_suppkey)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderpriority") == "5-LOW", "00000000").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    k = F.col("o_custkey") % 1000
    name = F.concat(F.lit("t_33_"), F.lpad(k.cast("string"), 3, "0"), F.lit("_"), (5000 + k).cast("string"), F.lit("_"), F.lower("o_orderstatus"), F.lit("x_file_"), date, F.lit("_pred.tif"))
    return o.select(F.col("o_custkey").alias("cell"), date.alias("date"), F.col("o_orderstatus").alias("state"), name.alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("area"))


CANDIDATES = """candidates as (select o_custkey as cell, d as date, o_orderstatus as state,
  't_33_' || lpad((o_custkey % 1000)::varchar, 3, '0') || '_' || (5000 + o_custkey % 1000)::varchar || '_' || lower(o_orderstatus) || 'x_file_' || d || '_pred.tif' as name,
  o_orderkey as pos, o_totalprice as area
  from (select *, case when o_orderpriority = '5-LOW' then '00000000' else strftime(o_orderdate, '%Y%m%d') end as d from orders))"""


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tile"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("path"))


ACQUISITIONS = "acq as (select o_custkey as tile, o_orderdate::date as date, o_orderkey as path from orders)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    x = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(x, "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("reference"), (F.col("n_chars") >= 500).alias("predicted"))


BOXES = "boxes as (select doc_id, source, lang, quality = 1 as reference, n_chars >= 500 as predicted from documents join labels using (doc_id))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation samples: four counts each."""
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("sample"), "p_brand", F.when(k % 7 != 0, F.col("p_type")).alias("p_type"), (k % 4 * s).cast("long").alias("tp"), (k % 3).cast("long").alias("fp"), (k % 5).cast("long").alias("fn"), (s + k % 11).cast("long").alias("tn"))


SAMPLES = """samples as (select p_partkey as sample, p_brand, case when p_partkey % 7 <> 0 then p_type end as p_type, (p_partkey % 4 * p_size)::bigint as tp,
  (p_partkey % 3)::bigint as fp, (p_partkey % 5)::bigint as fn, (p_size + p_partkey % 11)::bigint as tn from part)"""

METRICS = """case when tp + fp + fn = 0 then 1.0::double else tp::double / (tp + fp + fn) end as iou,
  case when 2 * tp + fp + fn = 0 then 1.0::double else (2 * tp)::double / (2 * tp + fp + fn) end as f1,
  case when tp + fp = 0 then 1.0::double else tp::double / (tp + fp) end as "precision",
  case when tp + fn = 0 then 1.0::double else tp::double / (tp + fn) end as recall,
  case when tp + fp + fn + tn = 0 then 1.0::double else (tp + tn)::double / (tp + fp + fn + tn) end as accuracy"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 windows: values rounded, and codes 1, 0 and 255 where a value is near 0."""
    e = table(spark, sf_dir, "embeddings")
    code = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.01, 255).when(x >= 0, 1).otherwise(0))
    return e.select(F.col("vec_id").alias("tile"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("value"), code.alias("values"))


RASTERS = """rasters as (select vec_id as tile, label, [x::double for x in embedding] as value,
  [case when abs(x) < 0.01 then 255 when x >= 0 then 1 else 0 end for x in embedding] as vals from embeddings),
 pixels as (select tile, i // 8 as r, i % 8 as c, v, x from (select tile, unnest(range(64)) as i, unnest(vals) as v, unnest(value) as x from rasters))"""


def canopy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 x 8 cells over sloping ground. By mode: enough ground to triangulate (0), none (1), three cells (2)."""
    pixel = rasters(spark, sf_dir).select("tile", (F.col("label") % 3).alias("mode"), F.posexplode("value").alias("i", "x"))
    row, col, corner = F.floor(F.col("i") / 8).cast("int"), F.col("i") % 8, F.col("i").isin(0, 7, 56, 63)
    plane = 100.0 + row * F.lit(0.5) - col * F.lit(0.25) + (F.col("tile") % 7)
    ground = ((F.col("mode") == 0) & ((F.col("x") >= 0) | corner)) | ((F.col("mode") == 2) & F.col("i").isin(9, 30, 54))
    top = F.when((F.abs("x") >= 0.03) | corner, plane + F.abs("x") * 40)
    return pixel.select("tile", row.alias("row"), col.alias("col"), top.alias("top"), F.when(ground, plane).alias("ground"), (F.col("x") > 0.2).alias("building"))


CANOPY = f"""{RASTERS}, canopy as (select *, case when abs(x) >= 0.03 or i in (0, 7, 56, 63) then plane + abs(x) * 40 end as top,
  case when (mode = 0 and (x >= 0 or i in (0, 7, 56, 63))) or (mode = 2 and i in (9, 30, 54)) then plane end as ground, x > 0.2 as building
  from (select tile, label % 3 as mode, (r * 8 + c)::bigint as i, r, c, x, 100.0::double + r * 0.5::double - c * 0.25::double + tile % 7 as plane from pixels join rasters using (tile)))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).cast("double").alias("x"), (F.col("event_id") % 20).cast("double").alias("y"), F.col("value").alias("z"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("classification"), (F.col("user_id") % 5).alias("window"))


POINTS = "points as (select (user_id % 20)::double as x, (event_id % 20)::double as y, value as z, case when event_type = 'view' then 2 else 1 end as classification from events)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x0, y0 = F.lit(6.0) + (k % 5) * F.lit(1.8), F.lit(47.0) + F.floor(k / 5) * F.lit(1.44)
    return table(spark, sf_dir, "nation").select(k.alias("unit"), x0.alias("x0"), y0.alias("y0"), (x0 + 1.8).alias("x1"), (y0 + 1.44).alias("y1"))


UNITS = """units as (select n_nationkey as unit, x0, y0, x0 + 1.8::double as x1, y0 + 1.44::double as y1 from
  (select n_nationkey, 6.0::double + (n_nationkey % 5) * 1.8::double as x0, 47.0::double + (n_nationkey // 5) * 1.44::double as y0 from nation))"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit as a slanted shell with a hole, an island in the hole and, for every third, a part of its own beyond the shell."""
    u = units(spark, sf_dir)
    at = lambda i, j: F.struct((F.col("x0") + i * F.lit(0.05)).alias("x"), (F.col("y0") + j * F.lit(0.05)).alias("y"))
    ring = lambda r: F.array(*(at(i, j) for i, j in r))
    three = F.array(*map(ring, SHAPE[:3]))
    return u.select("unit", F.when(F.col("unit") % 3 == 0, F.concat(three, F.array(ring(SHAPE[3])))).otherwise(three).alias("rings"))


#: Corners in steps of 0.05 degrees from a unit's corner.
SHAPE = (((0, 0), (34, 2), (36, 27), (3, 25)), ((8, 6), (9, 20), (27, 18), (25, 5)), ((14, 9), (21, 10), (20, 16), (14, 15)), ((37, 10), (44, 9), (41, 19)))

_rings = ", ".join("[" + ", ".join(f"{{'x': x0 + {i} * 0.05::double, 'y': y0 + {j} * 0.05::double}}" for i, j in r) + "]" for r in SHAPE)
SHAPES = f"""{UNITS}, shapes as (select unit, case when unit % 3 = 0 then [{_rings}] else [{_rings}][1:3] end as rings from units),
 sides as (select unit, ring[i].x as ax, ring[i].y as ay, ring[i % len(ring) + 1].x as ex, ring[i % len(ring) + 1].y as ey from (select unit, ring, unnest(range(1, len(ring) + 1)) as i from (select unit, unnest(rings) as ring from shapes)))"""
#: Whether p.x, p.y lies in an odd number of rings, by its sides s, and on none.
WITHIN = """count(*) filter ((ay > p.y) <> (ey > p.y) and p.x < ax + (p.y - ay) * (ex - ax) / nullif(ey - ay, 0)) % 2 = 1
  and not bool_or((ex - ax) * (p.y - ay) = (ey - ay) * (p.x - ax) and p.x between least(ax, ex) and greatest(ax, ex) and p.y between least(ay, ey) and greatest(ay, ey))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    product = F.when(F.col("l_returnflag") == "N", "dop").when(F.col("l_returnflag") == "A", "bdom").otherwise("dgm")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("tile"), F.trunc("l_shipdate", "month").alias("date"), product.alias("product")).distinct()


LINKS = """links as (select distinct l_partkey as tile, date_trunc('month', l_shipdate)::date as date,
  case l_returnflag when 'N' then 'dop' when 'A' then 'bdom' else 'dgm' end as product from lineitem)"""
