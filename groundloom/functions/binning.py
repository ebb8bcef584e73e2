"""Bins with the closedness each use needs, and class codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density and elevation edges, class codes, urban classes of the two samplings.
DENSITY_EDGES = (0, 10, 25, 50, 100)
DENSITY_LABELS = ("B1: 0-10", "B2: 10-25", "B3: 25-50", "B4: 50-100")
ELEVATION_EDGES = (0, 200, 500, 900)
TREE, NODATA = 1, 255
URBAN_TRAINING = (1, 2, 3, 4, 5, 6, 7, 9, 10)
URBAN_VALIDATION = tuple(range(1, 12))


def right_closed(value: Column, edges=DENSITY_EDGES, labels=DENSITY_LABELS) -> Column:
    """(a, b] bins, the lowest edge included; outside gives null."""
    out = F.when((value >= edges[0]) & (value <= edges[1]), labels[0])
    for top, label in zip(edges[2:], labels[1:], strict=True):
        out = out.when((value > edges[0]) & (value <= top), label)
    return out


def left_closed(value: Column, edges=DENSITY_EDGES) -> Column:
    """[a, b) bins by number, the last closed; outside gives null."""
    inside = (value >= edges[0]) & (value <= edges[-1])
    out = F.when(inside & (value < edges[1]), 0)
    for i, top in enumerate(edges[2:-1], 1):
        out = out.when(inside & (value < top), i)
    return out.when(inside, len(edges) - 2)


def grid_bin(value: Column, start: Column, step: float) -> Column:
    """Right-closed bins of one step from start; start itself has no bin.

    The quotient may round over an edge, so the bin is set right against the
    edges as they are computed.
    """
    step_ = F.lit(float(step))
    guess = F.ceil((value - start) / step_) - 1
    edge = lambda i: start + i * step_
    right = F.when(value <= edge(guess), guess - 1).when(value > edge(guess + 1), guess + 1).otherwise(guess)
    return F.when(value > start, right.cast("long"))


def to_binary(code: Column, nodata: int = NODATA) -> Column:
    return F.when(code == TREE, 1).when(code == nodata, nodata).otherwise(0)


def bad_codes(values: Column, nodata: int = NODATA) -> Column:
    """The codes of an array that aren't 0, 1 or no data; null if there are none."""
    odd = F.array_except(F.array_distinct(values), F.array(F.lit(0), F.lit(1), F.lit(nodata)).cast("array<int>"))
    return F.when(F.size(odd) > 0, odd)


def normalised(value: Column) -> Column:
    return (F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)) / 255 - 0.5) / 0.5


def relative_difference(other: Column, ours: Column) -> Column:
    """Percent of ours, held to -100 and 100; null where ours is 0."""
    d = 100.0 * (other - ours) / F.nullif(ours, F.lit(0.0))
    return F.when(d.isNotNull(), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), d)))  # least and greatest pass nulls over


def percent_bin(value: Column) -> Column:
    """One-percent bins of -100..100, from 0; the last is closed."""
    return F.least(F.floor(value) + 100, F.lit(199)).cast("long")
