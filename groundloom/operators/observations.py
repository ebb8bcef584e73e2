"""Acquisitions of a tile: collapse, label source, pairing, neighbours, windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundloom.functions import dates as D
from groundloom.operators.stats import FITS, rows_at_ranks


def collapse_tiles(index: DataFrame, tile: str, date: str) -> DataFrame:
    """A row a tile: number of images, season flags, sorted distinct dates."""
    summer = D.is_summer(F.col(date))
    return index.groupBy(tile).agg(
        F.count(F.lit(1)).alias("image_count"), F.bool_or(summer).alias("has_summer"), (~F.every(summer)).alias("has_other"), F.array_sort(F.collect_set(date)).alias("flight_dates")
    ).withColumn("has_both", F.col("has_summer") & F.col("has_other"))


def label_source(obs: DataFrame, tile: str, date: str, path: str, most: int | None = None) -> DataFrame:
    """obs with position and source_position: the latest summer acquisition, else the latest; most: how far from it rows may be."""
    order = Window.partitionBy(tile).orderBy(F.col(date).asc_nulls_first(), path)
    whole = Window.partitionBy(tile)
    n = obs.withColumn("position", F.row_number().over(order))
    source = F.coalesce(F.max(F.when(D.is_summer(F.col(date)), F.col("position"))).over(whole), F.max("position").over(whole))
    n = n.withColumn("source_position", source)
    return n if most is None else n.where(F.abs(F.col("position") - F.col("source_position")) <= most)


def partners(obs: DataFrame, tile: str, date: str, season: str) -> DataFrame:
    """For each tile its label source and the acquisition of the greatest seasonal contrast (then latest); null without one."""
    n = label_source(obs, tile, date, date)
    whole = Window.partitionBy(tile)
    source = F.max(F.when(F.col("position") == F.col("source_position"), F.col(season))).over(whole)
    n = n.withColumn("_source", source)
    other = F.col("position") != F.col("source_position")
    contrast = D.season_contrast(F.col(season), F.col("_source"))
    best = F.max(F.when(other, F.struct(contrast.alias("contrast"), F.col(date).cast("string").alias("partner_date"))))
    return n.groupBy(tile).agg(F.max(F.when(~other, F.col(date))).alias("source_date"), best.alias("b")).select(tile, "source_date", "b.*")


def border_tiles(tiles: DataFrame, tile_id: str) -> DataFrame:
    """tile_id, is_border: whether any of the eight neighbours is missing; short or odd ids are border."""
    id_ = F.col(tile_id)
    parts = tiles.select(tile_id).distinct().withColumn("_ok", id_.rlike(r"^\d{9,}$"))
    n = F.length(id_)
    e = F.when(F.col("_ok"), F.substr(id_, F.lit(3), n - 6)).cast("int")
    north = F.when(F.col("_ok"), F.right(id_, F.lit(4))).cast("int")
    steps = F.array(*(F.struct(F.lit(i).alias("de"), F.lit(j).alias("dn")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    near = parts.where("_ok").select(tile_id, F.substring(id_, 1, 2).alias("zone"), (n - 6).alias("width"), e.alias("e"), north.alias("n"), F.explode(steps).alias("s"))
    near = near.select(tile_id, F.concat("zone", F.lpad((F.col("e") + F.col("s.de")).cast("string"), F.col("width"), F.lit("0")), F.lpad((F.col("n") + F.col("s.dn")).cast("string"), 4, "0")).alias("_near"))
    whole = near.join(parts.select(F.col(tile_id).alias("_near")), "_near", "left_semi").groupBy(tile_id).agg(F.count(F.lit(1)).alias("_n"))
    return parts.join(whole, tile_id, "left").select(tile_id, (F.coalesce("_n", F.lit(0)) < 8).alias("is_border"))


def patch_windows(rasters: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """Full windows of a training grid, row by row. rasters: key, height, width."""
    n = lambda c: F.floor((F.col(c) - size) / stride).cast("int")
    ok = rasters.where((F.col("height") >= size) & (F.col("width") >= size))
    rows = ok.select(key, "width", F.explode(F.sequence(F.lit(0), n("height"))).alias("r"))
    cols = rows.select(key, "r", F.explode(F.sequence(F.lit(0), n("width"))).alias("c"))
    return cols.select(key, (F.col("r") * stride).alias("row_off"), (F.col("c") * stride).alias("col_off"))


def mosaic_windows(rasters: DataFrame, key: str, size: int) -> DataFrame:
    """key, tile_id, row_off, col_off, height, width: windows side by side, row by row, the last of each axis as short as it must be.

    rasters: key, height, width; an empty raster has no window.
    """
    at = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int"), F.lit(size)))
    some = rasters.where((F.col("height") > 0) & (F.col("width") > 0))
    cut = some.select(key, F.col("height").alias("_h"), F.col("width").alias("_w"), at("height").alias("row_off")).select("*", F.explode(F.sequence(F.lit(0), (F.col("_w") - 1).cast("int"), F.lit(size))).alias("col_off"))
    short = lambda n, off: F.least(F.lit(size), F.col(n) - F.col(off)).cast("int")
    return cut.select(key, F.format_string("r%07d_c%07d", "row_off", "col_off").alias("tile_id"), "row_off", "col_off", short("_h", "row_off").alias("height"), short("_w", "col_off").alias("width"))


def axis_plan(rasters: DataFrame, key: str, length: str, size: int, inner: int) -> DataFrame:
    """key, start, inner_start, inner_stop: patches of one axis, the last at the far edge; inner spans cover the axis once.

    Each start is a row, and a span begins where the one before ends (lag).
    """
    n = F.col(length)
    step = F.lit(inner)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), (n - size).cast("int"), step), F.array((n - size).cast("int"))))))
    each = rasters.select(key, n.alias("_n"), F.explode(starts).alias("start"))
    order = Window.partitionBy(key).orderBy("start")
    margin = (size - inner) // 2
    stop = F.when(F.lead("start").over(order).isNull(), F.col("_n")).otherwise(F.least(F.col("_n"), F.col("start") + margin + inner))
    each = each.withColumn("inner_stop", stop.cast("int"))
    return each.select(key, "start", F.coalesce(F.lag("inner_stop").over(order), F.lit(0)).alias("inner_start"), "inner_stop")


def numbered_patches(patches: DataFrame, observation: str) -> DataFrame:
    """Patch numbers from 0 without gaps, by observation, as text of four digits."""
    order = Window.partitionBy(observation).orderBy("row_off", "col_off")
    return patches.withColumn("patch_no", F.lpad((F.row_number().over(order) - 1).cast("string"), 4, "0"))


def best_median_worst(df: DataFrame, by: str, score: str, key: str, fits: int = FITS) -> DataFrame:
    """The best, median and worst row of each group, by score, then key; a null score is the least.

    A group of one has only a best, of two a best and a worst. Ranks are found
    as in stats.ranked_values(), so no group is sorted as a whole.
    """
    ranks = lambda n: F.when(n > 2, F.array(n - 1, F.floor(n / 2), F.lit(0).cast("long"))).when(n == 2, F.array(n - 1, F.lit(0).cast("long"))).otherwise(F.array(n - 1))
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    found = rows_at_ranks(df, [by], score, key, ranks, fits)
    out = found.join(sizes, found[by].eqNullSafe(sizes["_by"]))
    role = F.when(F.col("_rank") == F.col("_n") - 1, "best").when(F.col("_rank") == 0, "worst").otherwise("median")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), role.alias("role"))


def season_weights(df: DataFrame, season: str) -> DataFrame:
    """season, n, weight: N / (K * n) with K seasons present, so each season weighs alike."""
    n = df.groupBy(season).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return n.crossJoin(F.broadcast(total)).select(season, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # total is one row


def newest_year(files: DataFrame, keys: list[str]) -> DataFrame:
    """The path of the newest year for each key (then the last path)."""
    return files.groupBy(*keys).agg(F.max(F.struct("year", "path")).alias("w")).select(*keys, "w.year", "w.path")


def unchanged(tiles: DataFrame, change: str = "Change") -> DataFrame:
    """Tiles not marked as changed; null stays."""
    return tiles.where(~F.col(change).cast("string").eqNullSafe(F.lit("1")))


def not_excluded(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("exclude").try_cast("int"), F.lit(0)) == 0)


def exclude_where(df: DataFrame, predicate: str) -> DataFrame:
    """df without the rows of an SQL predicate; one that matches nothing is an error."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    if df.where(hit).isEmpty():
        raise ValueError(f"nothing matches {predicate!r}")
    return df.where(~hit)


def even_spread(df: DataFrame, by: str, value: str, key: str, n: int, fits: int = FITS) -> DataFrame:
    """n rows of each group at evenly spaced ranks of the value: the bin centres (i + 0.5) / n; a null value is the least."""
    ranks = lambda size: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.floor((i + 0.5) / n * size), size - 1))
    return rows_at_ranks(df, [by], value, key, ranks, fits).drop("_rank")


def spread_examples(pairs: DataFrame, by: str, value: str, key: str, date: str, contrast: str, n: int, near: int = 2, first: str | None = None, n_first: int = 1, fits: int = FITS) -> DataFrame:
    """Up to n rows of each group, spread over the ranks of value, no two of one date if it can be helped.

    Around each bin centre, rank round((i + 0.5) / n * (size - 1)), the row
    within ``near`` ranks wins whose date no chosen row has, then the one of the
    greatest contrast, then the nearest. first: a boolean column; of its true
    rows n_first are chosen first (fewer if there are fewer), and the rest from
    the others, which avoid their dates. Rows without a value are left out; a
    group of at most n rows is returned as it is. A group's choice looks at
    (2 * near + 1) * n rows of each kind.
    """
    known = pairs.where(F.col(value).isNotNull())
    kind = F.coalesce(F.col(first), F.lit(False)) if first else F.lit(False)
    rows = known.withColumn("_first", kind)
    sizes = rows.groupBy(by).agg(F.count_if("_first").alias("_a"), F.count_if(~F.col("_first")).alias("_b"))
    few = F.least(F.lit(n_first if first else 0), F.lit(n), F.col("_a"))
    sizes = sizes.select(F.col(by).alias("_by"), F.explode(F.array(F.struct(F.lit(True).alias("f"), few.alias("n"), F.col("_a").alias("size")), F.struct(F.lit(False).alias("f"), (n - few).alias("n"), F.col("_b").alias("size")))).alias("_s"), (F.col("_a") + F.col("_b") <= n).alias("_all"))
    sizes = sizes.select("_by", F.col("_s.f").alias("_f"), F.col("_s.n").alias("_n"), F.col("_s.size").alias("_size"), "_all")
    met = rows.join(sizes, rows[by].eqNullSafe(sizes["_by"]) & (rows["_first"] == sizes["_f"])).drop("_by", "_f")
    short = met.where(F.col("_all") | (F.col("_size") <= F.col("_n")))
    whole = short.select(*rows.columns, "_n", "_size", F.lit(None).cast("long").alias("_rank"))
    rest = met.where(~(F.col("_all") | (F.col("_size") <= F.col("_n"))) & (F.col("_n") > 0))
    i, last = F.col("_i"), F.col("_size") - 1
    centre = F.least(last, F.rint((i + 0.5) / F.col("_n") * last).cast("long"))
    asked = sizes.where(~F.col("_all") & (F.col("_size") > F.col("_n")) & (F.col("_n") > 0)).select(F.col("_by").alias(by), F.col("_f").alias("_first"), "_n", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    asked = asked.select(by, "_first", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), centre - near), F.least(last, centre + near))).alias("_rank"))
    found = rows_at_ranks(rest, [by, "_first"], value, key, asked, fits).drop("_all")
    candidates, names = whole.unionByName(found.select(*whole.columns)), pairs.columns

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for one in (True, False):
            pool = f[f["_first"] == one]
            if pool.empty:
                continue
            if pool["_rank"].isna().any():
                out.append(pool)
                used |= set(pool[date])
                continue
            m, last, taken = int(pool["_n"].iloc[0]), int(pool["_size"].iloc[0]) - 1, set()
            for i in range(m):
                target = min(last, round((i + 0.5) / m * last))
                window = pool[((pool["_rank"] - target).abs() <= near) & ~pool["_rank"].isin(taken)]
                if window.empty:
                    continue
                best = max(window.index, key=lambda j: (window.at[j, date] not in used, window.at[j, contrast], -abs(window.at[j, "_rank"] - target)))  # noqa: B023
                taken.add(window.at[best, "_rank"])
                used.add(window.at[best, date])
                out.append(window.loc[[best]])
        return pd.concat(out)[names] if out else f.iloc[:0][names]

    return candidates.orderBy("_rank").groupBy(by).applyInPandas(choose, pairs.schema)


def split_report(patches: DataFrame) -> DataFrame:
    """split, n_patches, n_tiles, n_observations, n_treeless; train, val and test are always there."""
    names = patches.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    n = patches.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_patches"), F.count_distinct("tile_id").alias("n_tiles"), F.count_distinct("obs_id").alias("n_observations"), F.count_if(F.col("tree_cover_pct") == 0).alias("n_treeless")
    )
    return names.join(n, "split", "left").na.fill(0)


def compared_totals(patches: DataFrame, published: dict[str, int]) -> DataFrame:
    """name, published, actual, is_equal for tiles, observations, patches, train_patches and val_patches, where published has the name."""
    n = lambda split: F.count_if(F.coalesce(F.col("split") == split, F.lit(False)))
    sums = {"tiles": F.count_distinct("tile_id"), "observations": F.count_distinct("obs_id"), "patches": F.count(F.lit(1)), "train_patches": n("train"), "val_patches": n("val")}
    unknown = set(published) - set(sums)
    if unknown:
        raise ValueError(f"no such totals: {sorted(unknown)}")
    lines = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).cast("long").alias("published"), F.col(k).alias("actual")) for k, v in published.items()))
    return patches.agg(*(sums[k].alias(k) for k in published)).select(F.explode(lines).alias("t")).select("t.*").withColumn("is_equal", F.col("published") == F.col("actual"))


def observations_by_split(patches: DataFrame) -> DataFrame:
    """split, observations: sorted, distinct; splits without any have an empty list."""
    names = patches.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    lists = patches.groupBy("split").agg(F.array_sort(F.collect_set("obs_id")).alias("observations"))
    empty = F.array().cast(lists.schema["observations"].dataType)
    return names.join(lists, "split", "left").select("split", F.coalesce("observations", empty).alias("observations"))


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """images (stem, path) with the mask of equal stem, else the first whose stem starts with the image's tile; null without one."""
    exact = masks.select(F.col("stem"), F.col("path").alias("_exact"))
    near = masks.groupBy(F.col("tile").alias("tile")).agg(F.min("path").alias("_near"))
    return images.join(exact, "stem", "left").join(near, "tile", "left").withColumn("mask_path", F.coalesce("_exact", "_near")).drop("_exact", "_near")
