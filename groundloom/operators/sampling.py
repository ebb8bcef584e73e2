"""Draws: eligibility, rounds of proposals settled by neighbouring squares, splits and weights."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.lineage import cut

#: Buckets of keys over which weights are summed up.
BUCKETS = 1024


def eligible(df: DataFrame, min_cover: float) -> tuple[DataFrame, DataFrame]:
    """Candidates that pass every test, and one row of what each test costs; tests on absent columns are skipped."""
    tests = {"min_cover": F.col("mean_tcd") >= min_cover}
    tests |= {c: F.col(c) for c in ("has_both", "seasonal_pair") if c in df.columns}
    tests |= {f"not_{c}": ~F.col(c) for c in ("is_border", "excluded") if c in df.columns}
    tests = {k: F.coalesce(t, F.lit(False)) for k, t in tests.items()}
    so_far, costs = F.lit(True), []
    for k, t in tests.items():
        costs.append(F.count_if(so_far & ~t).alias(f"lost_{k}"))
        so_far = so_far & t
    return df.where(reduce(lambda a, b: a & b, tests.values())), df.agg(*costs)


def _squares(df: DataFrame, spacing: float) -> DataFrame:
    return df.withColumns({f"_{c}": F.floor(F.col(c) / spacing).cast("long") for c in ("x", "y")})


def _around(points: DataFrame, *columns: str) -> DataFrame:
    """_rx, _ry: each of the nine squares where something near a point (_x, _y: its square) may lie, and its columns as _p<name>."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    each = points.withColumn("_d", F.explode(steps))
    return each.select((F.col("_x") + F.col("_d.i")).alias("_rx"), (F.col("_y") + F.col("_d.j")).alias("_ry"), *(F.col(c).alias(f"_p{c}") for c in columns))


def _too_near(spacing: float) -> Column:
    return F.pow(F.col("x") - F.col("_px"), 2) + F.pow(F.col("y") - F.col("_py"), 2) < spacing**2


def _settled(proposals: DataFrame, spacing: float) -> DataFrame:
    """The proposals (x, y, _x, _y, _rank) that no nearer one than spacing outranks: independent, and the first of all is always among them."""
    rivals = _around(proposals, "x", "y", "_rank")
    met = (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry")) & _too_near(spacing) & (F.col("_p_rank") < F.col("_rank"))
    return proposals.join(rivals, met, "left_anti")


def _free(rows: DataFrame, chosen: DataFrame | None, spacing: float) -> DataFrame:
    """rows not nearer to a chosen point than spacing. Chosen points are no more than the draw's targets."""
    if chosen is None:
        return rows
    near = _around(chosen, "x", "y")
    return rows.join(near, (F.col("_x") == F.col("_rx")) & (F.col("_y") == F.col("_ry")) & _too_near(spacing), "left_anti")


def _first(rows: DataFrame, group: str, quotas: dict, order: str = "_rank") -> DataFrame:
    """The first rows of each group, as many as its quota. The greatest quota bounds what a task keeps of a group."""
    if not quotas:
        return rows.limit(0)
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    some = rows.withColumn("_n", n).where(F.col("_n") <= max(quotas.values()))
    return some.where(F.col("_n") <= F.coalesce(_looked_up(group, quotas), F.lit(0))).drop("_n")


def _looked_up(column: str, values: dict) -> Column:
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), F.col(column))


def _quota(need: int, share: float) -> int:
    return max(1, int(np.ceil(need * share)))


def training_draw(candidates: DataFrame, key: str, stratum: str, targets: dict[str, int], spacing: float, per_flight: int | None, seed: int, share: float = 0.5, by_stratum: bool = False, pattern: str | None = None, months: str | None = None) -> DataFrame:
    """key, stratum, turn: strata fill together to their targets; no two tiles are nearer than the spacing.

    The draw goes in rounds. In each, every stratum's best candidate of every
    square proposes itself; of those too near each other the best stays (of
    different strata the one of the stratum furthest behind); a stratum takes
    at most ``share`` of what it lacks, so that counts steer the next round.
    All of a round is settled in Spark by neighbouring squares and ranks; only
    counts reach the driver. It ends when targets are met or no candidate is
    left, and drops none that could be drawn. Rounds grow with the logarithm
    of the targets.

    candidates: key, stratum, flight_date (a date or an array of dates), x, y.
    per_flight: the most tiles of one date, in the whole draw or by_stratum;
    None: any. pattern: a column of the acquisition order; of the two orders
    the one that is behind is preferred, other values never. months: an array
    of months; tiles whose months are rare so far are preferred, within 30 %
    of the stratum's best. Neither preference leaves a target open. Rows
    without x, y or stratum are left out. The same seed gives the same tiles.
    """
    several = candidates.schema["flight_date"].dataType.simpleString().startswith("array")
    dates = F.col("flight_date").cast("array<string>") if several else F.array(F.col("flight_date").cast("string"))
    dates = F.transform(dates, lambda d: F.coalesce(d, F.lit("")))
    extra = [F.col(c).alias(n) for c, n in ((pattern, "_pattern"), (months, "_months")) if c]
    rows = candidates.where(F.col(stratum).isin(list(targets)) & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(dates, F.array()).alias("_dates"), F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"), *extra)
    rows, chosen, turn = cut(_squares(rows, spacing)), None, 0
    scope = F.col("_stratum") if by_stratum else F.lit("")
    got, orders, monthly = dict.fromkeys(targets, 0), {}, {}
    while True:
        need = {s: targets[s] - got[s] for s in targets if targets[s] > got[s]}
        open_ = _free(rows.where(F.col("_stratum").isin(list(need))), chosen, spacing)
        if per_flight is not None and chosen is not None:
            used = chosen.select(scope.alias("_scope"), F.explode("_dates").alias("_date")).groupBy("_scope", "_date").agg(F.count(F.lit(1)).alias("_used")).where(F.col("_used") >= per_flight)
            full = used.groupBy("_scope").agg(F.collect_set("_date").alias("_full"))  # no more dates than tiles drawn
            open_ = open_.withColumn("_scope", scope).join(full, "_scope", "left").where(~F.coalesce(F.arrays_overlap("_dates", "_full"), F.lit(False))).drop("_scope", "_full")
        behind = _behind(orders) if pattern else None
        odd = F.lit(0) if behind is None else F.when(F.col("_pattern") == behind, 0).otherwise(1)
        rare = F.lit(0)
        if months and monthly:
            mean = sum(monthly.values()) / 12
            low = [m for m in range(1, 13) if monthly.get(m, 0) < mean]
            open_ = open_.withColumn("_score", F.size(F.array_intersect(F.coalesce("_months", F.array()).cast("array<int>"), F.array(*map(F.lit, low)).cast("array<int>"))))
            best = {(r[0], r[1]): r[2] for r in open_.groupBy("_stratum", odd.alias("odd")).agg(F.max("_score")).collect()}  # two rows a stratum
            rare = F.when(F.col("_score") >= 0.7 * F.coalesce(_looked_up("_best", {f"{s} {o}": v for (s, o), v in best.items()}), F.lit(0)), 0).otherwise(1)
            open_ = open_.withColumn("_best", F.concat_ws(" ", F.col("_stratum").cast("string"), odd.cast("string")))
        filled = _looked_up("_stratum", {s: got[s] / targets[s] for s in need})
        rank = F.struct(filled.alias("filled"), odd.alias("odd"), rare.alias("rare"), F.col("_hash").alias("hash"), F.col("_key").alias("key"))
        columns = [c for c in rows.columns if c not in ("_stratum", "_x", "_y")]
        best_of = open_.withColumn("_rank", rank).groupBy("_stratum", "_x", "_y").agg(F.min_by(F.struct(*columns), "_rank").alias("_c"), F.min("_rank").alias("_rank"))
        proposals = cut(best_of.select("_stratum", "_x", "_y", "_rank", "_c.*")) if need else None
        if proposals is None or proposals.isEmpty():
            break
        winners = _first(_settled(proposals, spacing), "_stratum", {s: _quota(n, share) for s, n in need.items()})
        if per_flight is not None:
            before = None if chosen is None else chosen.select(scope.alias("_scope"), F.explode("_dates").alias("_date")).groupBy("_scope", "_date").agg(F.count(F.lit(1)).alias("_used"))
            each = winners.select("_key", "_rank", scope.alias("_scope"), F.explode(F.array_distinct("_dates")).alias("_date"))
            each = each.withColumn("_n", F.row_number().over(Window.partitionBy("_scope", "_date").orderBy("_rank")))
            each = each.withColumn("_used", F.lit(0)) if before is None else each.join(before, ["_scope", "_date"], "left")
            over = each.where(F.col("_n") + F.coalesce("_used", F.lit(0)) > per_flight).select("_key").distinct()
            winners = winners.join(over, "_key", "left_anti")
        winners = cut(winners.withColumn("_turn", F.lit(turn)))
        turn += 1
        for r in winners.groupBy("_stratum").agg(F.count(F.lit(1)).alias("n")).collect():
            got[r["_stratum"]] += r["n"]
        if pattern:
            for r in winners.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n")).collect():
                orders[r["_pattern"]] = orders.get(r["_pattern"], 0) + r["n"]
        if months:
            for r in winners.select(F.explode("_months").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect():
                monthly[r["m"]] = monthly.get(r["m"], 0) + r["n"]
        chosen = winners if chosen is None else chosen.unionByName(winners)
    return _turns(candidates, chosen, key, stratum)


#: The two acquisition orders that are kept level.
ORDERS = ("summer_then_non-summer", "non-summer_then_summer")


def _behind(orders: dict) -> str | None:
    n = [orders.get(o, 0) for o in ORDERS]
    return None if n[0] == n[1] else ORDERS[n[1] < n[0]]


def _turns(candidates: DataFrame, chosen: DataFrame | None, key: str, *also: str) -> DataFrame:
    if chosen is None:
        kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in (key, *also))
        return candidates.sparkSession.createDataFrame([], f"{kinds}, turn int")
    order = Window.orderBy("_turn", "_rank")  # no more rows than the targets
    return chosen.select(F.col("_key").alias(key), *(F.col("_stratum").alias(c) for c in also), (F.row_number().over(order) - 1).alias("turn"))


def validation_draw(candidates: DataFrame, key: str, strata: list[str], per_level: int, spacing: float, seed: int, share: float = 0.5) -> DataFrame:
    """key, turn: until every level of every stratum column has per_level samples; each sample counts for all its levels.

    Rounds as in training_draw(): a candidate stands for the level of its own
    that has the fewest samples, and levels that lack most go first. A level is
    done when it is full or has no candidate left. Rows with a null stratum, x
    or y are left out.
    """
    whole = candidates.where(reduce(lambda a, b: a & b, (F.col(s).isNotNull() for s in [*strata, "x", "y"])))
    levels = F.array(*(F.concat_ws("=", F.lit(s), F.col(s).cast("string")) for s in strata))
    rows = whole.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), levels.alias("_levels"), F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"))
    rows, chosen, turn = cut(_squares(rows, spacing)), None, 0
    got: dict[str, int] = {}
    while True:
        count = F.create_map(*(F.lit(v) for pair in got.items() for v in pair)) if got else F.create_map().cast("map<string,int>")
        have = F.transform("_levels", lambda v: F.struct(F.coalesce(F.try_element_at(count, v), F.lit(0)).alias("n"), v.alias("level")))
        open_ = _free(rows, chosen, spacing).withColumn("_need", F.array_min(have)).where(F.col("_need.n") < per_level)
        rank = F.struct(F.col("_need.n").alias("n"), F.col("_hash").alias("hash"), F.col("_key").alias("key"))
        best_of = open_.withColumns({"_rank": rank, "_level": F.col("_need.level")}).groupBy("_level", "_x", "_y").agg(F.min_by(F.struct("_key", "x", "y", "_levels", "_need"), "_rank").alias("_c"), F.min("_rank").alias("_rank"))
        proposals = cut(best_of.select("_level", "_x", "_y", "_rank", "_c.*"))
        lacking = {r[0]: _quota(per_level - r[1], share) for r in proposals.groupBy("_level").agg(F.max("_need.n")).collect()}  # one row a level
        if not lacking:
            break
        winners = cut(_first(_settled(proposals, spacing), "_level", lacking).withColumn("_turn", F.lit(turn)))
        turn += 1
        for r in winners.select(F.explode("_levels").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect():
            got[r["v"]] = got.get(r["v"], 0) + r["n"]
        chosen = winners if chosen is None else chosen.unionByName(winners)
    return _turns(candidates, chosen, key)


def stratified_split(df: DataFrame, key: str, stratum: str, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """df with split: train, val and test by rank of a hash within the stratum; strata of under three rows go to train."""
    # Hashes are even, so their first digits cut a stratum of any size into parts of about 1/4096; ranks are the part's offset and the rank in it.
    digest = F.sha2(F.col(key).cast("string"), 256)
    rows = df.select("*", digest.alias("_h"), F.substring(digest, 1, 3).alias("_b"))
    sizes = rows.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_s", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from"), F.sum("_c").over(Window.partitionBy("_s")).alias("_n"))
    met = rows.join(sizes, rows[stratum].eqNullSafe(sizes["_s"]) & (rows["_b"] == sizes["_p"]))
    i = F.col("_from") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    n = F.col("_n")
    train, val = F.rint(shares[0] * n), F.rint((shares[0] + shares[1]) * n)
    split = F.when((n < 3) | (i <= train), "train").when(i <= val, "val").otherwise("test")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), split.alias("split"))


def weighted_draw(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement by weight: turn, key. Rows of no or negative weight are never drawn.

    Running weights are built in two steps, within buckets of the keys' hashes
    and over the buckets' sums, so that no task holds all rows; a draw looks up
    its bucket among the sums, which are few, and its row within the bucket.
    """
    rows = df.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b"))
    inside = rows.withColumn("_to", F.sum("_w").over(Window.partitionBy("_b").orderBy(key)))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_s"))
    over = Window.orderBy("_b")
    sums = sums.select("_b", F.sum("_s").over(over).alias("_high"), F.coalesce(F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_low"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    hits = df.sparkSession.range(n).select(F.col("id").alias("turn"), F.rand(seed).alias("_u"))
    at = F.col("_u") * F.col("_all")
    hits = hits.join(F.broadcast(sums), (at >= F.col("_low")) & (at < F.col("_high"))).select("turn", "_b", (at - F.col("_low")).alias("_at"))  # BUCKETS rows at most
    met = hits.join(inside, "_b").where((F.col("_at") >= F.col("_to") - F.col("_w")) & (F.col("_at") < F.col("_to")))
    return met.select("turn", key)


def boxes_around(points: DataFrame, size_m: float) -> DataFrame:
    half = size_m / 2
    return points.withColumns({"x0": F.col("x") - half, "y0": F.col("y") - half, "x1": F.col("x") + half, "y1": F.col("y") + half})


def months_of_draw(drawn: DataFrame, months: str) -> DataFrame:
    """month (1 to 12, all of them), n, share_pct of all flights of the drawn rows; 0 without any. months: an array of months a row."""
    got = drawn.select(F.explode(months).alias("month")).groupBy(F.col("month").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    every = drawn.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    n = every.join(got, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.crossJoin(F.broadcast(total)).select("month", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("_all")), F.lit(0.0)).alias("share_pct"))  # total is one row


def stopped_early(drawn: DataFrame, targets: dict[str, int]) -> DataFrame:
    """One row: got, target, stopped_early (fewer rows than the targets ask for)."""
    return drawn.agg(F.count(F.lit(1)).alias("got")).select("got", F.lit(sum(targets.values())).cast("long").alias("target")).withColumn("stopped_early", F.col("got") < F.col("target"))


def draw_report(drawn: DataFrame, stratum: str, targets: dict[str, int]) -> DataFrame:
    """stratum, target, got, is_short."""
    goal = drawn.sparkSession.createDataFrame(list(targets.items()), f"{stratum} string, target long")
    got = drawn.groupBy(stratum).agg(F.count(F.lit(1)).alias("got"))
    return goal.join(got, stratum, "left").select(stratum, "target", F.coalesce("got", F.lit(0).cast("long")).alias("got")).withColumn("is_short", F.col("got") < F.col("target"))


