"""Confusion counts, their metrics, and summaries by sample and stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("iou", "f1", "precision", "recall", "accuracy")
COUNTS = ("tp", "fp", "fn", "tn")


def confusion(reference: Column, predicted: Column, valid: Column | None = None) -> list[Column]:
    """Four counting aggregates over rows with both flags (and valid)."""
    ok = reference.isNotNull() & predicted.isNotNull()
    ok = ok if valid is None else ok & valid
    n = lambda a, b: F.count_if(F.coalesce(ok & a & b, F.lit(False)))
    return [n(reference, predicted).alias("tp"), n(~reference, predicted).alias("fp"), n(reference, ~predicted).alias("fn"), n(~reference, ~predicted).alias("tn")]


def _share(a: Column, b: Column) -> Column:
    """An undefined metric is 1."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / F.nullif(b, F.lit(0)))


def metrics(tp="tp", fp="fp", fn="fn", tn="tn") -> list[Column]:
    tp, fp, fn, tn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    cover = lambda a: F.when(n == 0, F.lit(0.0)).otherwise(100.0 * a / F.nullif(n, F.lit(0)))
    return [
        _share(tp, tp + fp + fn).alias("iou"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(tp + tn, n).alias("accuracy"),
        cover(tp + fn).alias("reference_cover_pct"),
        cover(tp + fp).alias("model_cover_pct"),
    ]


def score_zero_reference(df: DataFrame, mode: str = "score") -> DataFrame:
    """Samples whose reference cover is 0: score, drop or keep them.

    Scored, a correct negative is 1 throughout; a false positive is 0 but for
    its accuracy, 1 - model cover / 100. Without the two cover columns the frame
    is returned as it is.
    """
    reference, model = "lidar_tree_cover_pct", "model_tree_cover_pct"
    if mode not in ("score", "drop", "keep"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "keep" or reference not in df.columns or model not in df.columns:
        return df
    zero = F.coalesce(F.col(reference) == 0, F.lit(False))
    if mode == "drop":
        return df.where(~zero)
    right = zero & (F.col(model) == 0)
    wrong = {m: F.lit(0.0) for m in METRICS} | {"accuracy": 1 - F.col(model) / 100}
    return df.withColumns({m: F.when(right, 1.0).when(zero, wrong[m]).otherwise(F.col(m)) for m in METRICS if m in df.columns})


def summarise(per_sample: DataFrame, by: list[str] | None = None) -> DataFrame:
    """metric, mean, std (one row: null), pooled (from summed counts), n; also by columns. One pass, then an unpivot."""
    by = by or []
    sums = per_sample.groupBy(*by).agg(
        *(f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))), *(F.sum(c).alias(c) for c in COUNTS), F.count(F.lit(1)).alias("n")
    )
    pooled = sums.select("*", *metrics())
    lines = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("mean"), F.col(f"std_{m}").alias("std"), F.col(m).alias("pooled")) for m in METRICS))
    return pooled.select(*by, "n", F.explode(lines).alias("x")).select(*by, "x.*", "n")


def strata_long(per_sample: DataFrame, strata: list[str]) -> DataFrame:
    """stratum, level and the summary of each metric, for every level of every stratum column; null levels are left out."""
    levels = F.array(*(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("level")) for s in strata))
    long = per_sample.select(*METRICS, *COUNTS, F.explode(levels).alias("l")).select("l.*", *METRICS, *COUNTS)
    return summarise(long.where(F.col("level").isNotNull()), ["stratum", "level"])


def difference_classes(reference: Column, predicted: Column) -> Column:
    """TP, FP, FN, TN by pixel, for two arrays of flags."""
    return F.zip_with(reference, predicted, lambda r, p: F.when(r & p, "TP").when(p, "FP").when(r, "FN").otherwise("TN"))
