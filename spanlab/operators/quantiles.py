"""Exact quantiles of groups of any size.

A quantile needs two rows of a group's order.  They are found by refinement: rows are counted by cell of
their value, first by sign and binary magnitude, then by equal parts of the cell's range; of each cell only
the one a wanted row lies in is looked into again, until it holds one value or ``most`` rows at most.
So a task sees counts, or the distinct values of one small cell, never a group's values.  The map from value to
cell ascends with the value, ties stay in one cell, and nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .ordered import same

CELLS = 4096
MOST = 65_536


def magnitude(v: Column) -> Column:
    """A whole number that ascends with the value: sign and a quarter of an octave of its size."""
    size = F.floor(F.log2(F.abs(v)) * 4) + 5000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def _part(v: Column, lo: Column, hi: Column) -> Column:
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)  # halves don't overflow; null where they are too small to tell apart
    return F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), (v > lo).cast("long")).cast("long")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], most: int = MOST) -> DataFrame:
    """keys and, by name, each group's quantiles, interpolated linearly between the two nearest rows.

    Nulls and NaN are no values; a group without values has no row.  Infinite values are refused.
    """
    rows = df.select(*keys, F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    by = [*keys, "_all"]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ask = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()))).alias("q")
    asked = sums.select(*by, "_n", "lo", "hi", ask).withColumn("place", F.col("q.p") * (F.col("_n") - 1))
    asked = staged(asked.select(*by, "_n", "lo", "hi", "q.name", "place", F.floor("place").alias("first")))
    if asked.where(F.col("lo").isin(float("-inf")) | F.col("hi").isin(float("inf"))).limit(1).count():
        raise ValueError(f"infinite values in {value}")
    # a row for every wanted row of a group: where it is looked for and its rank there, from 0
    row = F.explode(F.array_distinct(F.array("first", F.least(F.col("first") + 1, F.col("_n") - 1)))).alias("want")
    state = asked.select(*by, row, "lo", "hi", "_n").distinct().select(*by, "want", "lo", "hi", F.col("_n").alias("size"), F.col("want").alias("rank"))
    state, first = staged(state), True
    while True:
        open_ = state.where((F.col("size") > most) & (F.col("lo") < F.col("hi")))
        if open_.limit(1).count() == 0:
            break
        ranges = open_.select(*by, "lo", "hi").distinct()
        inside = rows.alias("l").join(ranges.alias("r"), same("l", "r", by) & F.col("l._v").between(F.col("r.lo"), F.col("r.hi"))).select("l.*", "r.lo", "r.hi")
        cell = magnitude(F.col("_v")) if first else _part(F.col("_v"), F.col("lo"), F.col("hi"))
        cells = inside.groupBy(*by, "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
        upto = F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("upto", upto)
        hit = (F.col("l.rank") < F.col("r.upto")) & (F.col("l.rank") >= F.col("r.upto") - F.col("r.n"))
        found = open_.alias("l").join(cells.alias("r"), same("l", "r", [*by, "lo", "hi"]) & hit)
        found = found.select(*(f"l.{c}" for c in [*by, "want"]), F.col("r.least").alias("lo"), F.col("r.greatest").alias("hi"), F.col("r.n").alias("size"), (F.col("l.rank") - F.col("r.upto") + F.col("r.n")).alias("rank"))
        state = staged(state.where((F.col("size") <= most) | (F.col("lo") >= F.col("hi"))).unionByName(found))
        first = False
    # the values of the cells that are left, counted
    ranges = state.where("lo < hi").select(*by, "lo", "hi").distinct()
    inside = rows.alias("l").join(ranges.alias("r"), same("l", "r", by) & F.col("l._v").between(F.col("r.lo"), F.col("r.hi"))).select("l.*", "r.lo", "r.hi")
    counts = inside.groupBy(*by, "lo", "hi", "_v").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "lo", "hi").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = (F.col("l.rank") < F.col("r.upto")) & (F.col("l.rank") >= F.col("r.upto") - F.col("r.n"))
    some = state.where("lo < hi").alias("l").join(counts.alias("r"), same("l", "r", [*by, "lo", "hi"]) & hit).select(*(f"l.{c}" for c in [*by, "want"]), F.col("r._v").alias("v"))
    values = some.unionByName(state.where("lo >= hi").select(*by, "want", F.col("lo").alias("v")))
    low = asked.alias("l").join(values.alias("r"), same("l", "r", by) & (F.col("l.first") == F.col("r.want"))).select("l.*", F.col("r.v").alias("below"))
    above = F.least(F.col("l.first") + 1, F.col("l._n") - 1) == F.col("r.want")
    both = low.alias("l").join(values.alias("r"), same("l", "r", by) & above).select("l.*", F.col("r.v").alias("above"))
    at = F.col("below") + (F.col("above") - F.col("below")) * (F.col("place") - F.col("first"))
    out = both.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, at)).alias(name) for name in shares))
    return out.drop("_all")
