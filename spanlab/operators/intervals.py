"""Interval operators: cleaning, windows, point-in-interval and overlap joins, union and gaps.

Times are integers (microseconds), so no sum of floats decides which window a point is in.

Point lookups go through a hierarchical index.  Level 0 has cells of ``BUCKET``, each further level cells
``FAN`` times as wide.  An interval is entered at the lowest level at which it touches ``FAN`` + 1 cells at most, whether
it lasts a second or ten years, and a point probes one cell of each level in use, which is one where all
intervals are short.  Point and interval meet at one cell only, so the join is an equi-join on (keys, level,
cell) with an exact filter, and a key with very many intervals is dealt by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried, positions, with_carry

BUCKET = 6 * 3_600_000_000
FAN = 32


def clean(raw: DataFrame, payload: Sequence[str], keep: Column) -> DataFrame:
    """Drops repeated rows on the raw payload first, then the rows that fail ``keep``."""
    return raw.dropDuplicates(list(payload)).where(keep)


def tumbling(segments: DataFrame, lo: str, hi: str, length: int, stride: int | None = None) -> DataFrame:
    """Windows anchored at each segment's start; a partial tail makes none.  Adds k, t0, t1."""
    stride = stride or length
    last = F.floor((F.col(hi) - F.col(lo) - length) / stride).cast("long")
    kept = segments.where(F.col(hi) - F.col(lo) >= length)
    made = kept.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return made.withColumn("t0", F.col(lo) + F.col("k") * stride).withColumn("t1", F.col("t0") + length)


def _widths(bucket: int, fan: int) -> list[int]:
    """Widths of the cells, level by level, as far as 64-bit times go."""
    out = [bucket]
    while out[-1] * fan * fan < 1 << 63:
        out.append(out[-1] * fan)
    return out


def levelled(intervals: DataFrame, lo: str, hi: str, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Intervals with the level each is entered at: adds _level."""
    widths = _widths(bucket, fan)
    level = F.lit(len(widths) - 1)
    for k in reversed(range(len(widths) - 1)):
        level = F.when(F.col(hi) - F.col(lo) <= widths[k] * fan, k).otherwise(level)
    return intervals.where(F.col(lo) <= F.col(hi)).withColumn("_level", level)


def indexed(intervals: DataFrame, lo: str, hi: str, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """A row for every cell an interval is entered in, ``fan`` + 1 at most: adds _level, _cell."""
    width = F.get(F.array(*(F.lit(w).cast("long") for w in _widths(bucket, fan))), F.col("_level"))
    made = levelled(intervals, lo, hi, bucket, fan)
    return made.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def probes(points: DataFrame, levels: DataFrame, at: str, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """A row for every level that ``levels`` has (and level 0) with the point's cell there: adds _level, _cell."""
    widths = _widths(bucket, fan)
    used = levels.agg(F.array_sort(F.array_union(F.collect_set("_level"), F.array(F.lit(0)))).alias("_levels"))  # one row, a dozen levels at most
    width = F.get(F.array(*(F.lit(w).cast("long") for w in widths)), F.col("_level"))
    made = points.crossJoin(F.broadcast(used)).withColumn("_level", F.explode("_levels")).drop("_levels")
    return made.withColumn("_cell", F.floor(F.col(at) / width))


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str, bucket: int = BUCKET, outer: bool = False, fan: int = FAN) -> DataFrame:
    """Points with every interval of equal keys that contains them, both ends included.

    ``outer`` keeps points without interval, with nulls; a point that only intervals of a higher level
    contain has such a row too, so who counts rows of the outer join counts those with an interval.
    Columns other than the keys must have different names on the two sides.
    """
    spread = indexed(intervals, lo, hi, bucket, fan)
    dealt = probes(points, levelled(intervals, lo, hi, bucket, fan), at, bucket, fan)
    condition = F.col(f"p.{at}").between(F.col(f"i.{lo}"), F.col(f"i.{hi}"))
    for k in [*keys, "_level", "_cell"]:
        condition = (F.col(f"p.{k}") == F.col(f"i.{k}")) & condition
    both = dealt.alias("p").join(spread.alias("i"), condition, "left" if outer else "inner")
    if outer:
        both = both.where((F.col("p._level") == 0) | F.col(f"i.{lo}").isNotNull())
    return both.select(*(f"p.{c}" for c in points.columns), *(f"i.{c}" for c in intervals.columns if c not in keys))


def window_sets(segments: DataFrame, intervals: DataFrame, keys: Sequence[str], lo: str, hi: str, ident: str, cls: str, length: int, bucket: int = 4 * BUCKET, fan: int = FAN) -> DataFrame:
    """Windows of segments with the intervals of equal keys that contain their middles: keys, ident, k, t0, mid, t1, classes, bag.

    ``classes`` is sorted and distinct, ``bag`` counts intervals; a window without any has an empty list.  The windows are those
    of ``tumbling``, but they are made after the join: a segment is dealt in pieces, one for each cell of the index in which
    middles of it lie, and meets its intervals as such, so what is shuffled grows with the events and not with their windows.
    Intervals are taken level by level; all levels in use are met in the same way, and joined only if there are several.
    """
    named = intervals.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(cls).alias("_cls")).where("_cls is not null")
    half = length // 2
    kept = segments.where(F.col(hi) - F.col(lo) >= length).select(*keys, ident, F.col(lo).alias("_t"), F.floor((F.col(hi) - F.col(lo)) / length).cast("long").alias("_n"))
    levels = sorted(r[0] for r in levelled(named, "_lo", "_hi", bucket, fan).select("_level").distinct().collect()) or [0]  # a dozen at most
    parts = []
    for level in levels:
        w = _widths(bucket, fan)[level]
        first = F.col("_t") + half
        pieces = kept.withColumn("_cell", F.explode(F.sequence(F.floor(first / w), F.floor((first + (F.col("_n") - 1) * length) / w))))
        upto = lambda at: F.ceil((at - first) / length).cast("long")  # noqa: B023, E731
        pieces = pieces.withColumn("_k0", F.greatest(F.lit(0).cast("long"), upto(F.col("_cell") * w))).withColumn("_k1", F.least(F.col("_n"), upto((F.col("_cell") + 1) * w)) - 1).where("_k0 <= _k1").drop("_n")
        spread = indexed(named, "_lo", "_hi", bucket, fan).where(F.col("_level") == level)
        since = F.expr(f"greatest(p._k0, (greatest(i._lo - p._t - {half}, 0L) + {length - 1}L) div {length}L)")  # windows whose middles it contains
        until = F.expr(f"least(p._k1, (i._hi - p._t - {half}) div {length}L)")
        meets = (F.col("i._hi") >= F.col("p._t") + half) & (since <= until)
        for k in [*keys, "_cell"]:
            meets = (F.col(f"p.{k}") == F.col(f"i.{k}")) & meets
        both = pieces.alias("p").join(spread.alias("i"), meets, "left")
        hit = F.when(F.col("i._lo").isNotNull(), F.struct(since.alias("since"), until.alias("until"), F.col("i._cls").alias("cls")))
        own = both.groupBy(*(F.col(f"p.{c}").alias(c) for c in (*keys, "_cell", ident, "_t", "_k0"))).agg(F.max("p._k1").alias("_last"), F.collect_list(hit).alias("_hits"))
        made = own.withColumn("k", F.explode(F.sequence("_k0", "_last"))).withColumn("mid", F.col("_t") + half + F.col("k") * length)
        made = made.withColumn("_own", F.filter("_hits", lambda x: (x["since"] <= F.col("k")) & (x["until"] >= F.col("k")))["cls"])
        parts.append(made.select(*keys, ident, "k", "_t", "mid", F.sort_array(F.array_distinct("_own")).alias("classes"), F.size("_own").cast("long").alias("bag")))
    out = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        out = out.groupBy(*keys, ident, "k", "_t", "mid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"), F.sum("bag").alias("bag"))
    return out.select(*keys, ident, "k", (F.col("mid") - half).alias("t0"), "mid", (F.col("mid") - half + length).alias("t1"), "classes", "bag")


def shortest(joined: DataFrame, point_keys: Sequence[str], lo: str, hi: str, tie: str, take: Sequence[str]) -> DataFrame:
    """Of the intervals joined to each point the shortest, ties by ``tie``; without a sort."""
    best = F.min_by(F.struct(*take), F.when(F.col(lo).isNotNull(), F.struct(F.col(hi) - F.col(lo), F.col(tie)))).alias("best")
    return joined.groupBy(*point_keys).agg(best).select(*point_keys, *(F.col(f"best.{c}").alias(c) for c in take))


def exclusive(intervals: DataFrame, keys: Sequence[str], lo: str, hi: str, cls: str, ident: str = "event_id", bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Intervals that no interval of another class overlaps; touching ends don't overlap.

    Of two that overlap, one begins inside the other, so two point lookups find all of them: beginnings in
    the other's index and the other's beginnings in one's own.  Both are semi-joins, which make no pairs.
    """
    other = intervals.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col(lo).alias("o_lo"), F.col(hi).alias("o_hi"), F.col(cls).alias("o_cls"))
    hit = (F.col("o_lo") < F.col(hi)) & (F.col(lo) < F.col("o_hi")) & (F.col("o_cls") != F.col(cls))
    for k in keys:
        hit = hit & (F.col(k) == F.col(f"o_{k}"))

    def met(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        theirs = theirs.withColumnsRenamed({"_level": "o_level", "_cell": "o_cell"})
        return mine.join(theirs, hit & (F.col("_level") == F.col("o_level")) & (F.col("_cell") == F.col("o_cell")), "left_semi").select(ident)

    own, others = indexed(intervals, lo, hi, bucket, fan), indexed(other, "o_lo", "o_hi", bucket, fan)
    found = met(probes(intervals, levelled(other, "o_lo", "o_hi", bucket, fan), lo, bucket, fan), others)
    found = found.unionByName(met(own, probes(other, levelled(intervals, lo, hi, bucket, fan), "o_lo", bucket, fan)))
    return intervals.join(found.distinct(), ident, "left_anti")


def merge(intervals: DataFrame, keys: Sequence[str], lo: str, hi: str, bucket: int = BUCKET) -> DataFrame:
    """Union of intervals by key; touching ones merge.  keys, lo, hi, n (intervals merged).

    Islands are made inside buckets of the intervals' beginnings first.  How far all earlier buckets reach tells which
    islands of a bucket go on from before; they join the last island that began before.
    """
    by = Window.partitionBy(*keys, "_b").orderBy(lo, hi)
    before = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0)
    marked = intervals.select(*keys, lo, hi).withColumn("_b", F.floor(F.col(lo) / bucket)).withColumn("_open", opens)
    marked = marked.withColumn("_island", F.sum("_open").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = marked.groupBy(*keys, "_b", "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n"))
    own = with_carry(own, carried(own, keys, "_b", F.max(hi)), keys, "_b", "_reach")
    own = own.withColumn("_start", F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach")), F.col(lo)))
    own = with_carry(own, carried(own, keys, "_b", F.max("_start"), "last"), keys, "_b", "_from")
    return own.withColumn("_start", F.coalesce("_start", "_from")).groupBy(*keys, "_start").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("n").alias("n")).drop("_start")


def gaps(merged: DataFrame, keys: Sequence[str], lo: str, hi: str, first: int, last: int, bucket: int = BUCKET) -> DataFrame:
    """What merged intervals leave free of [first, last), head and tail included: keys, gap_lo, gap_hi."""
    dealt = merged.withColumn("_b", F.floor(F.col(lo) / bucket)).withColumn("_p", F.lag(hi).over(Window.partitionBy(*keys, "_b").orderBy(lo)))
    dealt = with_carry(dealt, carried(dealt, keys, "_b", F.max(hi)), keys, "_b", "_pc")
    before = F.coalesce("_p", "_pc", F.lit(first))
    between = dealt.select(*keys, F.greatest(before, F.lit(first)).alias("gap_lo"), F.least(F.col(lo), F.lit(last)).alias("gap_hi"))
    tail = merged.groupBy(*keys).agg(F.greatest(F.max(hi), F.lit(first)).alias("gap_lo")).select(*keys, "gap_lo", F.lit(last).alias("gap_hi"))
    return between.unionByName(tail).where("gap_lo < gap_hi")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: int, bucket: Column) -> DataFrame:
    """Runs of at least ``least`` consecutive rows with ``flag``: keys, first (position from 0), length.

    ``bucket`` ascends with ``order``.  A run is named by its first row; one that comes over a bucket's border is
    named by the last run that began before.
    """
    placed = positions(df.select(*keys, *order, F.coalesce(flag, F.lit(False)).alias("_f")), keys, order, bucket, "_at").withColumn("_b", bucket)
    by = Window.partitionBy(*keys, "_b").orderBy("_at")
    placed = placed.withColumn("_p", F.lag("_f").over(by))
    placed = with_carry(placed, carried(placed, keys, "_b", F.max_by("_f", "_at"), "last"), keys, "_b", "_pc")
    placed = placed.where("_f").withColumn("_s", F.when(~F.coalesce("_p", "_pc", F.lit(False)), F.col("_at")))
    placed = placed.withColumn("_run", F.last("_s", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = with_carry(placed, carried(placed, keys, "_b", F.max("_s"), "last"), keys, "_b", "_rc")
    made = placed.groupBy(*keys, F.coalesce("_run", "_rc").alias("first")).agg(F.count(F.lit(1)).alias("length"))
    return made.where(F.col("length") >= least)
