"""Mixing sources to target weights by pivotal dependent rounding.

A source taken r times over gives each of its documents floor(r) copies and a
fraction f of one more. The fractions are rounded in pairs: of two documents,
probability mass (fraction times words) moves from one to the other, in a
direction drawn so that no expected value changes, until one fraction is 0 or
1. What is left of each chunk, one document at most, goes up a reduction tree
of fixed fan-in, so each source ends with one open document, which is drawn by
its own fraction. The words taken from a source thus miss its target by less
than that document's. Long documents come first, and an open document keeps one draw for
all its pairs: its mass then moves one way and it closes soon, so what is open
at the end is short. Draws come from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundloom.llm.common import as_text, cut, n_words, own, whole_rows

#: The weights by rank of the source, repeating, and the most times a source is taken.
WEIGHTS, MOST = (5, 2, 1), 3
CHUNK, FAN_IN, SEED = 4096, 64, 9

OPEN = "source string, chunk bigint, doc_id bigint, mark bigint, size bigint, p double, draw bigint"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: one row for each source (null is one).

    Sources stop at most times their size, in order of size to weight; the rest
    share what is left by weight. The table of sources is ranked as a whole:
    its rows are sums, one a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    each = each.withColumn("rank", rank).withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)))
    top = most * F.col("source_size")
    order = Window.orderBy(top / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(top).over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = each.withColumn("level", level.cast("double"))
    # The first source, in that order, that its share doesn't fill sets the level of all after it.
    fits = ranked.withColumn("fits", F.col("level") * F.col("weight") <= top)
    first = F.min(F.when(F.col("fits"), F.struct((top / F.col("weight")).alias("k"), F.col("rank").alias("r"), F.col("level").alias("level")))).over(whole)
    out = fits.withColumn("final", first["level"])
    target = F.least(top.cast("double"), F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight"))
    return out.select("source", "source_size", "n_docs", target.alias("target"))


def unit(draw: int, step: int) -> float:
    """A number in [0, 1) from a row's draw and the step of the tree."""
    z = (draw + (step + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ z >> 31) >> 11) / (1 << 53)


def pair(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """New fractions of two documents of s and t words: p*s + q*t stays, one fraction becomes 0 or 1."""
    up, down = min(1 - p, q * t / s), min(p, (1 - q) * t / s)
    if u * (up + down) < down:
        return (1.0, q - up * s / t) if up == 1 - p else (p + up, 0.0)
    return (0.0, q + down * s / t) if down == p else (p - down, 1.0)


def settled(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def rounder(step: int):
    """Rounds rows that come sorted by source and chunk, holding one open row at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                source = None if pd.isna(r.source) else r.source
                row = [source, r.chunk, r.doc_id, r.mark, r.size, settled(r.p) if r.size else 0.0, r.draw]
                if held is not None and (held[0], held[1]) != (row[0], row[1]):
                    out.append(held)
                    held = None
                if held is not None and 0 < row[5] < 1:
                    held[5], row[5] = map(settled, pair(held[5], held[4], row[5], row[4], unit(held[6], step)))
                    if held[5] in (0, 1):
                        out.append(held)
                        held = None
                if held is None and 0 < row[5] < 1:
                    held = row
                else:
                    out.append(row)
            yield frame(out)
        if held is not None:
            yield frame([held])

    def frame(rows: list) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["source", "chunk", "doc_id", "mark", "size", "p", "draw"])
        return f.astype({"chunk": "int64", "doc_id": "Int64", "mark": "int64", "size": "int64", "p": "float64", "draw": "int64"})

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, chunk: int = CHUNK, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """doc_id, mark, size, source_size, target, copies, taken: one row for each row of docs.

    size counts the words of the text (a null text has none); a document without
    words is taken as often as its source's whole part says, 0 words. A null
    source is a source, ranked last. Repeated rows are documents of their own.
    An empty table gives no rows. Only doc_id, text and source are read. A hot
    source is dealt over as many chunks as its documents need. mark is a hash of
    text and source.
    """
    rows = own(docs, "doc_id", "text", "source").withColumn("text", as_text(F.col("text")))
    sizes = cut(rows.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text", "source").alias("mark"), n_words(F.col("text")).alias("size")))
    goal = cut(targets(sizes, weights, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + 1e-9)
    goal_ = goal.withColumn("whole", whole).withColumn("p", F.greatest(times - whole, F.lit(0.0))).withColumn("chunks", F.ceil(F.col("n_docs") / chunk))
    drawn = lambda salt: F.xxhash64("doc_id", "mark", F.lit(seed + salt))
    on = sizes["source"].eqNullSafe(goal_["source"])
    dealt = sizes.join(goal_, on).select(sizes["source"], F.pmod(drawn(0), F.col("chunks")).alias("chunk"), "doc_id", "mark", "size", "p", drawn(1).alias("draw"))
    done, step = None, 0
    deepest = goal_.agg(F.max("chunks")).first()[0] or 1
    level = dealt
    while True:
        ordered = level.repartition("source", "chunk").sortWithinPartitions("source", "chunk", F.col("size").desc(), "draw", "doc_id", "mark")
        rounded = cut(ordered.mapInPandas(rounder(step), OPEN))
        still = (F.col("p") > 0) & (F.col("p") < 1)
        closed = rounded.where(~still)
        if deepest == 1:  # what is open now is one document a source
            closed = rounded.withColumn("p", F.when(still, (F.pmod(drawn(2), F.lit(1 << 40)) / (1 << 40) < F.col("p")).cast("double")).otherwise(F.col("p")))
        done = closed if done is None else done.unionByName(closed)
        if deepest == 1:
            break
        level = rounded.where(still).withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        deepest, step = -(-deepest // fan_in), step + 1
    on = done["source"].eqNullSafe(goal_["source"])
    copies = (F.col("whole") + F.col("p_")).cast("long")
    done = done.withColumnRenamed("p", "p_")
    out = done.join(goal_, on).withColumn("copies", copies)
    return out.select("doc_id", "mark", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """docs as mixed: each row as often as it is taken.

    Rows alike in id, text and source share their copies: each gives the whole
    part of their number, and the first ones, by a hash of all columns, one
    more. Rows alike in all columns are one row with a number.
    """
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    met = whole_rows(docs, "text", "source").join(taken.where("copies > 0"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark")))
    once = met.where("rows = 1").select("row", F.col("copies").alias("n"))
    alike = met.where("rows > 1").withColumn("whole", F.xxhash64("row"))
    sizes = alike.groupBy("of_id", "of_mark", "copies", "rows", "whole").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("times"))
    before = F.sum("times").over(Window.partitionBy("of_id", "of_mark").orderBy("whole")) - F.col("times")
    over = F.greatest(F.lit(0).cast("long"), F.least(F.col("times"), F.col("copies") % F.col("rows") - before))
    more = sizes.select("row", (F.col("times") * F.floor(F.col("copies") / F.col("rows")) + over).alias("n"))
    both = once.unionByName(more).where("n > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
