"""Regressions, histograms, shares and percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.functions.binning import percent_bin
from groundloom.lineage import cut


def fit(x: str, y: str) -> list[Column]:
    """Least squares of y on x: slope, intercept, r2, rmse about the fit, bias, n; null for fewer than two points."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(F.when(both, 1))
    few = lambda c: F.when(n >= 2, c)
    sse = F.regr_syy(v, u) - F.pow(F.regr_sxy(v, u), 2) / F.nullif(F.regr_sxx(v, u), F.lit(0.0))
    return [
        few(F.regr_slope(v, u)).alias("slope"), few(F.regr_intercept(v, u)).alias("intercept"), few(F.regr_r2(v, u)).alias("r2"),
        few(F.sqrt(F.greatest(sse, F.lit(0.0)) / n)).alias("rmse"), few(F.avg(v - u)).alias("bias"), n.alias("n"),
    ]


def agreement(x: str, y: str) -> list[Column]:
    return [F.pow(F.corr(x, y), 2).alias("r2"), F.avg(F.col(y) - F.col(x)).alias("bias")]


def percent_histogram(df: DataFrame, value: str, panel: str | None = None) -> DataFrame:
    """bin (0..199 for -100..100), n and its share of the panel's rows."""
    keys = [panel] if panel else []
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, percent_bin(F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts and their share of all; the table of counts is small, so one window ranks it."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


#: How many values of the data cut an interval that holds a rank, and how many rows of one a task may put in order.
SPLITTERS, FITS = 64, 1 << 16


def ranked_values(rows: DataFrame, wanted: DataFrame, fits: int = FITS) -> DataFrame:
    """_g, _rank, _v, _below, _same: the value at each rank (from 0) of each group, how many rows are less and how many equal.

    rows: _g, _v (no nulls); wanted: _g, _rank, within the group's number of rows.

    A rank's interval of values shrinks in rounds: quantiles sketched from the
    rows in it cut it, rows are counted between and on the cuts (sums with
    map-side combine), and the part that holds the rank is the next interval.
    Each round leaves about one row in SPLITTERS, however values are spread;
    a value that fills its part is the answer. What fits is put in order. Only
    ranks, cuts and counts are kept between rounds.
    """
    limits = rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_c"))
    state = cut(wanted.join(limits, "_g").where("_rank >= 0 and _rank < _c").select("_g", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_c"))
    done = []
    while True:
        done.append(state.where("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_v"), "_below", F.col("_c").alias("_same")))
        small = state.where(F.col("_lo") != F.col("_hi")).where(F.col("_c") <= fits)
        done.append(_in_order(rows, small))
        state = state.where(F.col("_lo") != F.col("_hi")).where(F.col("_c") > fits)
        if state.isEmpty():
            break
        each = rows.join(state.select("_g", "_lo", "_hi").distinct(), "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        points = F.array(*(F.lit(k / SPLITTERS) for k in range(1, SPLITTERS)))
        cuts = each.groupBy("_g", "_lo", "_hi").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", points, 16 * SPLITTERS))).alias("_cuts"))
        met = rows.join(cuts, "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = met.groupBy("_g", "_lo", "_hi", part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_k").over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_part"))
        counts = counts.select("_g", "_lo", "_hi", "_least", "_most", "_k", (upto - F.col("_k")).alias("_from"))
        place = F.col("_rank") - F.col("_below") - F.col("_from")
        found = state.join(counts, ["_g", "_lo", "_hi"]).where((place >= 0) & (place < F.col("_k")))
        state = cut(found.select("_g", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_from")).alias("_below"), F.col("_k").alias("_c")))
    return reduce(DataFrame.unionByName, done)


def _in_order(rows: DataFrame, small: DataFrame) -> DataFrame:
    each = rows.join(small.select("_g", "_lo", "_hi").distinct(), "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    values = each.groupBy("_g", "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_same"))
    upto = F.sum("_same").over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_v"))
    values = values.withColumn("_from", upto - F.col("_same"))
    place = F.col("_rank") - F.col("_below") - F.col("_from")
    met = small.join(values, ["_g", "_lo", "_hi"]).where((place >= 0) & (place < F.col("_same")))
    return met.select("_g", "_rank", "_v", (F.col("_below") + F.col("_from")).alias("_below"), "_same")


def _group(by: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_one"), *(F.col(f"`{c}`") for c in by))


def rows_at_ranks(df: DataFrame, by: list[str], value: str, key: str, ranks, fits: int = FITS) -> DataFrame:
    """The rows of df, and _rank, at ranks of their group: by value (null first, with -inf), then key.

    ranks: a function from the column of the group's number of rows to an array
    of ranks, or a table of the by columns and _rank. Keys that aren't numbers are ordered by a hash of them. Of rows
    alike in all of this one is given.
    """
    numeric = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or df.schema[key].dataType.typeName().startswith("decimal")
    number = F.col(f"`{key}`") if numeric else F.xxhash64(F.col(f"`{key}`"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    rows = df.select(_group(by).alias("_g"), F.coalesce(F.col(f"`{value}`").cast("double"), F.lit(float("-inf"))).alias("_v"), number.alias("_key"), row)
    if isinstance(ranks, DataFrame):
        wanted = ranks.select(_group(by).alias("_g"), F.col("_rank").cast("long").alias("_rank")).distinct()
    else:
        n = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        wanted = n.select("_g", F.explode(F.array_distinct(ranks(F.col("_n"))).cast("array<bigint>")).alias("_rank"))
    at = cut(ranked_values(rows.select("_g", "_v"), wanted, fits))  # a row a rank
    ties = at.select(F.struct("_g", "_v").alias("_tie"), "_rank", (F.col("_rank") - F.col("_below")).alias("_m"))
    tied = rows.select(F.struct("_g", "_v").alias("_tie"), "_key", "_row").join(ties.select("_tie").distinct(), "_tie")
    keys = cut(ranked_values(tied.select(F.col("_tie").alias("_g"), F.col("_key").alias("_v")).where("_v is not null"), ties.select(F.col("_tie").alias("_g"), F.col("_m").alias("_rank")), fits))
    picked = ties.join(keys.select(F.col("_g").alias("_tie"), F.col("_rank").alias("_m"), F.col("_v").alias("_key")), ["_tie", "_m"])
    out = tied.join(picked, ["_tie", "_key"]).groupBy("_tie", "_rank").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in df.columns), "_rank")


def percentiles(df: DataFrame, value: str, points: list[float], *by: str, fits: int = FITS) -> DataFrame:
    """Exact, interpolated; null for a group without values. See ranked_values(): no task puts a group in order."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(_group(by).alias("_g"), F.col(value).cast("double").alias("_v"))
    n = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("_n") - 1) * F.lit(float(p))).alias("pos")) for i, p in enumerate(points))))
    spots = n.select("_g", at.alias("_p")).select("_g", "_p.i", "_p.pos", F.explode(F.array_distinct(F.array(F.floor("_p.pos"), F.ceil("_p.pos")))).alias("_rank"))
    met = spots.join(ranked_values(rows, spots.select("_g", "_rank").distinct(), fits), ["_g", "_rank"])
    part = F.when(F.floor("pos") == F.ceil("pos"), F.col("_v")).when(F.col("_rank") == F.floor("pos"), (F.ceil("pos") - F.col("pos")) * F.col("_v")).otherwise((F.col("pos") - F.floor("pos")) * F.col("_v"))
    names = [f"p{round(100 * p):02d}" for p in points]
    found = met.groupBy("_g").agg(*(F.sum(F.when(F.col("i") == i, part)).alias(name) for i, name in enumerate(names)))
    groups = df.select(_group(by).alias("_g")).distinct() if by else df.sparkSession.range(1).select(F.struct(F.lit(0).alias("_one")).alias("_g"))
    return groups.join(found, "_g", "left").select(*(F.col("_g").getField(c).alias(c) for c in by), *names)


def stretched(value: Column, low: Column, high: Column) -> Column:
    """Held to 0..1 between two percentiles."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
