"""Ordered-sequence operators in two levels, so that no key has to fit one task.

Rows of a key are dealt into buckets of an ordered value (of time, as a rule).  A bucket is solved by
itself; what it needs from before its border is carried over from a table with a row a key and
bucket.  The buckets of a key are as many as its span of time, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of all keys of two aliases, nulls equal to nulls."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def carried(df: DataFrame, keys: Sequence[str], bucket: str, value: Column, how: str = "max", back: bool = False) -> DataFrame:
    """For each key and bucket of ``df`` what all its earlier buckets (``back``: later ones) leave: keys, bucket, carry.

    ``value`` sums a bucket up; ``how`` joins buckets: their max, min or sum, or "last", the nearest that isn't null.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(bucket) if back else F.asc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    join = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    return df.groupBy(*keys, bucket).agg(value.alias("_v")).select(*keys, bucket, join("_v").over(order).alias("carry"))


def with_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str], bucket: str, name: str) -> DataFrame:
    """``df`` with the carried value of each row's key and bucket."""
    joined = df.alias("l").join(carry.alias("r"), same("l", "r", [*keys, bucket]), "left")
    return joined.select("l.*", F.col("r.carry").alias(name))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, values: Sequence[str]) -> DataFrame:
    """Each row with the values of the row before and after it in its key: adds prev_<v> and next_<v>.

    ``bucket`` ascends with ``order``.  Only a bucket's first and last rows look beyond it.
    """
    dealt = df.withColumn("_b", bucket)
    by = Window.partitionBy(*keys, "_b").orderBy(*order)
    row = F.struct(F.lit(1).alias("is"), *values)
    dealt = dealt.withColumn("_p", F.lag(row).over(by)).withColumn("_n", F.lead(row).over(by))
    at = F.struct(*order)
    before = carried(dealt, keys, "_b", F.max_by(row, at), "last")
    after = carried(dealt, keys, "_b", F.min_by(row, at), "last", back=True)
    dealt = with_carry(with_carry(dealt, before, keys, "_b", "_pc"), after, keys, "_b", "_nc")
    prev, follow = F.coalesce("_p", "_pc"), F.coalesce("_n", "_nc")
    return dealt.select(*df.columns, *(prev[v].alias(f"prev_{v}") for v in values), *(follow[v].alias(f"next_{v}") for v in values))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "at") -> DataFrame:
    """Each row's place in its key, from 0."""
    dealt = df.withColumn("_b", bucket)
    own = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    dealt = with_carry(dealt.withColumn("_r", own), carried(dealt, keys, "_b", F.count(F.lit(1)), "sum"), keys, "_b", "_c")
    return dealt.select(*df.columns, (F.col("_r") - 1 + F.coalesce("_c", F.lit(0))).cast("long").alias(name))


def first_of(df: DataFrame, strata: Sequence[str], k: int | Column, order: Column, cell: Column) -> DataFrame:
    """The first ``k`` rows of each stratum in the order of (``cell``, ``order``), without sorting strata.

    ``cell`` cuts the order into some ten thousand parts.  Rows are counted by cell; cells that end before the
    k-th row are taken whole, those behind it not at all, and only the rows of the one cell it lies in are ranked.
    ``k`` may be a column of the stratum's rows.
    """
    dealt = df.withColumn("_cell", cell).withColumn("_k", k if isinstance(k, Column) else F.lit(k))
    cells = dealt.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_k").alias("_most"))
    upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("_upto", upto).where(F.col("_upto") - F.col("_n") < F.col("_most"))
    joined = dealt.alias("l").join(cells.alias("r"), same("l", "r", [*strata, "_cell"]), "inner").select("l.*", "r._n", "r._upto")
    whole = joined.where(F.col("_upto") <= F.col("_k")).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*strata, "_cell").orderBy(order))
    border = joined.where(F.col("_upto") > F.col("_k")).withColumn("_r", rank + F.col("_upto") - F.col("_n")).where(F.col("_r") <= F.col("_k"))
    return whole.unionByName(border.select(*df.columns))
