"""Sampling and splits: every draw is an order by hash, so it is the same on every partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, unit
from ..sources.shared import staged
from .ordered import first_of
from .quantiles import magnitude


def drop_reasons(df: DataFrame, ladder: Sequence[tuple[str, Column]]) -> DataFrame:
    """One reason a row, the first that holds, else ``kept``; counted."""
    reason = F.lit("kept")
    for name, test in reversed(ladder):
        reason = F.when(test, name).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def span_anchors(merged: DataFrame, keys: Sequence[str], lo: str, hi: str, n: int) -> DataFrame:
    """``n`` anchors at even distances over the joined length of disjoint spans: keys, anchor, at."""
    own, size = Window.partitionBy(*keys), F.col(hi) - F.col(lo)
    spans = merged.withColumn("_before", F.coalesce(F.sum(size).over(own.orderBy(lo).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("_total", F.sum(size).over(own)).withColumn("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    spans = spans.withColumn("_off", F.expr(f"((2 * anchor + 1) * _total) div {2 * n}"))
    return spans.where((F.col("_off") >= F.col("_before")) & (F.col("_off") < F.col("_before") + size)).select(*keys, "anchor", (F.col(lo) + F.col("_off") - F.col("_before")).alias("at"))


def weighted_requests(spans: DataFrame, keys: Sequence[str], lo: str, hi: str, want: str, seed: str, window: int, batch: int) -> DataFrame:
    """Pieces of spans drawn by length without replacement, until they supply ``want`` anchors a key.

    Spans are cut into pieces of ``window``; a piece supplies ``batch`` anchors, the last one what is left.  A piece's key is
    -log(u) over its length with u from a hash, and the least keys are taken: so at every draw each piece left is taken in
    proportion to its length.  keys, start, length, n, rank; a key with too few pieces gives all it has.
    """
    pieces, most = spans.where((F.col(lo) < F.col(hi)) & (F.col(want) > 0)), F.expr(f"({want} + {batch - 1}) div {batch}")

    def piece(k: Column) -> Column:
        start = F.col(lo) + k * window
        length = F.least(F.lit(window).cast("long"), F.col(hi) - start)
        return F.struct((-F.log(unit(F.concat_ws("|", F.lit(seed), *keys, start))) / length).alias("_o"), start.alias("start"), length.alias("length"))

    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"({hi} - {lo} - 1) div {window}")), piece)
    least = F.slice(F.sort_array(cut), F.lit(1), most.cast("int"))  # of one span no more can be taken
    pieces = pieces.select(*keys, want, F.explode(least).alias("_p")).select(*keys, want, "_p.start", "_p.length", "_p._o")
    taken = first_of(pieces, keys, most, F.struct("_o", "start"), magnitude(F.col("_o")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "start")).cast("long")  # over the pieces taken
    taken = taken.withColumn("rank", rank)
    return taken.select(*keys, "start", "length", F.least(F.lit(batch).cast("long"), F.col(want) - (F.col("rank") - 1) * batch).alias("n"), "rank")


def interval_points(df: DataFrame, lo: str, hi: str, margin: int, spacing: int, most: int) -> DataFrame:
    """Evenly spaced times inside [lo + margin, hi - margin], min(most, span // spacing + 1) of them."""
    df = df.where(F.col(hi) - F.col(lo) >= 2 * margin).withColumn("_span", F.col(hi) - F.col(lo) - 2 * margin)
    df = df.withColumn("_n", F.least(F.lit(most).cast("long"), F.expr(f"_span div {spacing} + 1")))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return df.withColumn("at", F.expr(f"{lo} + {margin} + ((2 * i + 1) * _span) div (2 * _n)"))


def rarity_sample(df: DataFrame, classes: str, keys: Sequence[str], order: Column, cap: int) -> DataFrame:
    """Per key the ``cap`` rows whose rarest class is rarest; rows without class come last."""
    seen = df.select(F.explode(classes).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    table = seen.agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("_freq"))  # one entry a class of a closed vocabulary
    rare = F.coalesce(F.array_min(F.transform(classes, lambda c: F.element_at("_freq", c))), F.lit(10**9)).cast("long")
    ranked = df.crossJoin(F.broadcast(table)).withColumn("rarity", rare).drop("_freq").withColumn("_o", order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("rarity", "_o"))
    return ranked.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_o", "_r")  # a task keeps a key's first rows before the shuffle


LEVELS = 64


def water_fill(capacity: DataFrame, key: str, cap: str, target: int) -> DataFrame:
    """Even integer shares of ``target`` limited by capacity: adds ``share``.

    Every group gets up to a level, the highest at which the shares still fit; what is left goes one
    each to the first groups by key that have room.  The level is searched for by sums at ``LEVELS`` levels at
    a time, one aggregation each, and the first groups are found by counting key ranges, so no task sees all groups.
    """
    df = capacity.where(F.col(cap) > 0)
    row = df.agg(F.sum(cap).alias("all"), F.max(cap).alias("most")).first()
    if (row["all"] or 0) <= target:
        return df.select(*capacity.columns, F.col(cap).cast("long").alias("share"))
    low, high, spent = 0, int(row["most"]), 0  # the level is at least low and below high
    while high - low > 1:
        tried = sorted({low + (high - low) * k // LEVELS for k in range(1, LEVELS)} - {low})
        sums = df.agg(*(F.sum(F.least(F.col(cap), F.lit(x))).alias(f"s{x}") for x in tried)).first()
        fits = [x for x in tried if sums[f"s{x}"] <= target]
        low, high = max([low, *fits]), min([high, *(x for x in tried if sums[f"s{x}"] > target)])
        spent = sums[f"s{low}"] if fits else spent
    level, room = F.lit(low).cast("long"), df.where(F.col(cap) > low)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(room.select(key).repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))
    more = first_of(ranged, [], int(target - spent), F.col(key), F.col("_p")).select(key, F.lit(1).alias("_more"))
    out = df.join(more, key, "left")
    return out.select(*(out[c] for c in capacity.columns), (F.least(F.col(cap), level) + F.coalesce("_more", F.lit(0))).cast("long").alias("share"))


def stratified_sample(df: DataFrame, stratum: str, shares: DataFrame, order: Column) -> DataFrame:
    """Without replacement ``share`` rows a stratum, in hash order; ``shares(stratum, share)``.

    The order is cut by its first four digits, so a stratum is counted, not sorted.
    """
    wanted = df.withColumn("_o", order).join(shares.select(stratum, "share"), stratum)
    return first_of(wanted, [stratum], F.col("share"), F.col("_o"), F.substring("_o", 1, 4)).select(*df.columns)


def case_split(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """Each distinct key in ``val`` (the first round(n * share) in hash order) or ``train``.

    The hash at which ``val`` ends is found from counts by its first characters, so no key is
    ranked but those of the one cell in which it lies.
    """
    keys = df.select(key).distinct().withColumn("_d", draw(seed, F.col(key))).withColumn("_cell", F.substring("_d", 1, 4))
    cells = keys.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536
    order = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_upto", F.sum("_n").over(order)).withColumn("_most", F.round(F.sum("_n").over(Window.partitionBy(F.lit(1))) * share))
    placed = keys.join(cells, "_cell")
    within = F.row_number().over(Window.partitionBy("_cell").orderBy("_d"))
    edge = (F.col("_upto") > F.col("_most")) & (F.col("_upto") - F.col("_n") < F.col("_most"))
    sure = placed.where(~edge).select(key, F.when(F.col("_upto") <= F.col("_most"), "val").otherwise("train").alias("split"))
    close = placed.where(edge).withColumn("_r", F.col("_upto") - F.col("_n") + within).select(key, F.when(F.col("_r") <= F.col("_most"), "val").otherwise("train").alias("split"))
    return sure.unionByName(close)


def split_cost(counts: DataFrame, split: DataFrame, key: str, cls: str, n: str, share: float, floor: int) -> DataFrame:
    """Squared relative deviation of each class's share in ``val``, 1000 for each class under ``floor``."""
    val = F.coalesce(F.sum(F.when(F.col("split") == "val", F.col(n))), F.lit(0))
    per = counts.join(split, key).groupBy(cls).agg(F.sum(n).alias("total"), val.alias("val"))
    cost = F.sum(F.pow(F.col("val") / (share * F.col("total")) - 1, F.lit(2))) + 1000 * F.count_if(F.col("val") < floor)
    return per.agg(F.round(cost, 6).alias("cost"), F.count(F.lit(1)).alias("classes"))


BITS = 256  # sides that one digest gives


def _trial_sums(rows: DataFrame, key: str, cls: str, n: str, trials: int, lanes: int, sides: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """trial, cls, own (the class's sum over the keys on a trial's side), total.

    A batch of keys becomes a matrix of sides, keys by trials, and one of counts, keys by classes; their
    product has the batch's sums of all trials.  ``sides`` makes the first matrix out of digests, ``lanes`` trials each.
    """
    per_key = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.collect_list(F.struct(F.col(cls).cast("string").alias("cls"), F.col(n).cast("double").alias("n"))).alias("all"))  # a row a class
    kind = rows.schema[cls].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048).to_pylist()
                names = sorted({x["cls"] for r in batch for x in r["all"]}, key=lambda c: (c is not None, c or ""))
                place = {c: j for j, c in enumerate(names)}
                counts = np.zeros((len(batch), len(names)))
                for i, r in enumerate(batch):
                    for x in r["all"]:
                        counts[i, place[x["cls"]]] += x["n"] or 0.0
                for first in range(0, trials, lanes):
                    side = sides([f"{first // lanes}|{r['key']}" for r in batch])[:, : trials - first]
                    own, t = side.T.astype(float) @ counts, side.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + t), len(names))), pa.array(names * t, pa.string()), pa.array(own.reshape(-1)), pa.array(np.tile(counts.sum(axis=0), t))], names=["trial", "cls", "own", "total"])

    made = per_key.mapInArrow(sums, "trial long, cls string, own double, total double")
    return made.groupBy("trial", F.col("cls").cast(kind).alias(cls)).agg(F.sum("own").alias("own"), F.sum("total").alias("total"))


def bit_sides(keys: list[str]) -> np.ndarray:
    """A side for each key and each of ``BITS`` trials: the bits of sha256(key), the highest first."""
    return np.unpackbits(np.array([np.frombuffer(hashlib.sha256(k.encode()).digest(), np.uint8) for k in keys]), axis=1)


def fold_trials(counts: DataFrame, key: str, cls: str, n: str, trials: int) -> DataFrame:
    """Objective of hash-drawn two-fold splits: worst log ratio of a class and half the size skew.

    A key is in the second fold of trial t where bit t mod ``BITS`` of sha256("<t div BITS>|<key>") is set.
    """
    per = _trial_sums(counts, key, cls, n, trials, BITS, bit_sides).withColumn("a", F.col("total") - F.col("own"))
    worst = F.max(F.abs(F.log((F.col("a") + 1) / (F.col("own") + 1))))
    skew = F.abs(F.sum("a") - F.sum("own")) / F.sum("total")
    return per.groupBy("trial").agg((worst + 0.5 * skew).alias("objective"))


def holdout_trials(durations: DataFrame, key: str, family: str, seconds: str, share: float, trials: int) -> DataFrame:
    """Hash-drawn holdouts judged by how far each family's share of the duration is from ``share``.

    A key is held out in trial t where the 16 bits at t mod 16 of sha256("holdout|<t div 16>|<key>") are below the share of 65,536.
    trial, objective (the worst distance), missing (families without any held-out duration).
    """
    cut = int(share * 65_536)

    def held(keys: list[str]) -> np.ndarray:
        return np.array([np.frombuffer(hashlib.sha256(f"holdout|{k}".encode()).digest(), ">u2") for k in keys]) < cut

    per = _trial_sums(durations, key, family, seconds, trials, 16, held)
    return per.groupBy("trial").agg(F.max(F.abs(F.col("own") / F.col("total") - share)).alias("objective"), F.count_if(F.col("own") == 0).alias("missing"))


WORKING = 4096  # rows of either side that one search works on
PAIRS = 1024  # swaps found between all rows that one further search works on
CANDIDATES = 64


def _costs(v: np.ndarray, target: np.ndarray, floor: int) -> np.ndarray:
    """What each class adds to the cost of a split whose ``val`` sums are ``v``."""
    x = v / target - 1
    return x * x + 1000.0 * (v < floor)


def _least_costs(target: np.ndarray, total: np.ndarray, floor: int, whole: bool) -> np.ndarray:
    """The least that each class can add to the cost, whichever rows are in ``val``; ``whole`` where counts are whole numbers."""
    tried = np.stack([np.floor(target), np.ceil(target), np.full(len(target), float(floor))] if whole else [target, np.full(len(target), float(floor))])
    return np.where(tried <= total, _costs(tried, target, floor), np.inf).min(axis=0)


def best_swaps(m: np.ndarray, val: np.ndarray, target: np.ndarray, floor: int, rest: np.ndarray | float = 0.0, least: float = 0.0) -> tuple[np.ndarray, float]:
    """From a split (``val`` marks its rows of ``m``) swaps of two rows until none lowers the cost; the split and its cost.

    A step weighs every row by what its own move would change, and tries the ``CANDIDATES`` best of either side
    against each other; only where none of these helps are all pairs tried, in blocks, so the end is an optimum of all swaps.
    ``rest`` is the sum of ``val`` rows that aren't in ``m``; no cost is below ``least``.
    """
    val = val.copy()
    cost = lambda v: _costs(v, target, floor).sum(axis=-1)
    sums = rest + m[val].sum(axis=0)
    now = float(cost(sums))
    while val.any() and not val.all() and now > least * (1 + 1e-9):
        inside, outside = np.flatnonzero(val), np.flatnonzero(~val)
        out = inside[np.argsort(cost(sums - m[inside]), kind="stable")[:CANDIDATES]]
        into = outside[np.argsort(cost(sums + m[outside]), kind="stable")[:CANDIDATES]]
        tried = cost(sums - m[out][:, None] + m[into][None])
        i, j = np.unravel_index(int(tried.argmin()), tried.shape)
        best, pair, gain = float(tried[i, j]), (out[i], into[j]), min(1e-12, 1e-9 * now)
        if best >= now - gain:
            step = max(1, 2_000_000 // max(len(outside), 1))
            for at in range(0, len(inside), step):
                some = inside[at : at + step]
                tried = cost(sums - m[some][:, None] + m[outside][None])
                i, j = np.unravel_index(int(tried.argmin()), tried.shape)
                if tried[i, j] < best:
                    best, pair = float(tried[i, j]), (some[i], outside[j])
        if best >= now - gain:
            break
        val[pair[0]], val[pair[1]], now = False, True, best
        sums = sums - m[pair[0]] + m[pair[1]]
    return val, now


def _count_vectors(counts: DataFrame, key: str, cls: str, n: str) -> tuple[DataFrame, np.ndarray, int]:
    """_key, m (its counts in the order of the classes' names), staged; the classes' totals; how many keys there are."""
    each = counts.groupBy(F.col(key).alias("_key"), F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("_c")).agg(F.sum(F.col(n).cast("double")).alias("_n"))
    each = staged(each.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias("_all")))  # an entry a class
    totals = each.select(F.explode("_all").alias("_c", "_n")).groupBy("_c").agg(F.sum("_n").alias("_n")).where("_n > 0").orderBy("_c").collect()  # a row a class
    m = F.array(*(F.coalesce(F.element_at("_all", F.lit(r[0])), F.lit(0.0)) for r in totals)) if totals else F.array().cast("array<double>")
    return each.select("_key", m.alias("m")), np.array([r[1] for r in totals]), each.count()


def _val_sums(rows: DataFrame, classes: int, *by: str) -> dict:
    """Sums of the count vectors of ``rows`` by class, keyed by ``by``: a row each."""
    sums = rows.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.get("m", F.lit(c))), F.lit(0.0)) for c in range(classes))).alias("_s"))
    return {tuple(r[b] for b in by): np.array(r["_s"]) for r in sums.collect()}


def _searched(rows: DataFrame, sums: dict, target: np.ndarray, floor: int, least: float) -> DataFrame:
    """k, cost, _key, moved: for each k, a task's work, the rows (k, _key, m, val) that ``best_swaps`` moves; one that isn't moved where none is."""

    def search(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.array([str(x) for x in table["_key"].to_pylist()]), kind="stable")))
        k, m, val = table["k"][0].as_py(), np.array(table["m"].to_pylist(), float), np.array(table["val"].to_pylist(), bool)
        start = sums.get((k,), np.zeros(m.shape[1]))
        end, cost = best_swaps(m, val, target, floor, start - m[val].sum(axis=0), least)
        moved = end != val
        told = np.flatnonzero(moved) if moved.any() else np.zeros(1, int)
        return pa.table({"k": pa.array([k] * len(told), pa.int32()), "cost": pa.array([cost] * len(told)), "_key": table["_key"].take(pa.array(told)), "moved": pa.array(moved[told])})

    kind = rows.schema["_key"].dataType.simpleString()
    return staged(rows.select("k", "_key", "m", "val").groupBy("k").applyInArrow(search, f"k int, cost double, _key {kind}, moved boolean"))


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``rows`` (_key, m, val) with the keys of ``moves`` on the other side."""
    both = rows.alias("l").join(moves.select("_key", F.lit(True).alias("_m")).alias("r"), F.col("l._key").eqNullSafe(F.col("r._key")), "left")
    return staged(both.select("l._key", "l.m", (F.col("l.val") != F.col("r._m").isNotNull()).alias("val")))


def _better_pairs(rows: DataFrame, sums: np.ndarray, target: np.ndarray, least: np.ndarray, floor: int) -> DataFrame:
    """For each count vector that ``val`` rows (_key, m, val) have its best swap with a ``train`` row, where it lowers the cost: v, val_key, train_key, gain.

    Keys of equal counts are one.  A swap helps only if it takes each class's sum to where what the class adds to the cost,
    with the least of all others, is below the present cost: so the counts of the two differ by a step in a box, which is narrow near the end
    of a search.  The vectors meet in cells as wide as the box, so only pairs that may help, and some near them, are weighed.
    """
    now = float(_costs(sums, target, floor).sum())
    slack = np.maximum(now - (least.sum() - least), 0.0)
    reach = target * np.sqrt(slack) * (1 + 1e-6) + 1e-6
    lo, hi = target - reach - sums, target + reach - sums
    row = rows.agg(*(f(F.get("m", F.lit(c))).alias(f"{name}{c}") for c in range(len(sums)) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    spread = np.array([(row[f"hi{c}"] or 0.0) - (row[f"lo{c}"] or 0.0) + 1 for c in range(len(sums))])
    by = [int(c) for c in np.argsort((hi - lo) / spread, kind="stable")[:3]]  # a vector of val is in eight cells at most
    side = lambda mark, name: rows.where(mark).groupBy(F.col("m").alias(name)).agg(F.min("_key").alias(f"{name}_key"))
    v, t = side(F.col("val"), "v"), side(~F.col("val"), "t")
    for c in by:
        w, x = float(hi[c] - lo[c]), F.get("v", F.lit(c))
        v = v.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((x + float(lo[c])) / w), F.floor((x + float(hi[c])) / w))))
        t = t.withColumn(f"_c{c}", F.floor(F.get("t", F.lit(c)) / w))
    met, cost = F.lit(True), F.lit(0.0)
    for c in range(len(sums)):
        step = F.get("t", F.lit(c)) - F.get("v", F.lit(c))
        at = F.lit(float(sums[c])) - F.get("v", F.lit(c)) + F.get("t", F.lit(c))
        off = at / float(target[c]) - 1
        met, cost = met & step.between(float(lo[c]), float(hi[c])), cost + off * off + F.when(at < floor, 1000.0).otherwise(0.0)
    pairs = v.join(t, [f"_c{c}" for c in by]).where(met).withColumn("gain", F.lit(now) - cost).where(F.col("gain") > min(1e-9, 1e-6 * now))
    best = pairs.groupBy("v", "v_key").agg(F.max(F.struct("gain", "t", "t_key")).alias("_b"))
    return best.select("v", F.col("v_key").alias("val_key"), F.col("_b.t_key").alias("train_key"), F.col("_b.gain").alias("gain"))


def _whole(counts: DataFrame, n: str) -> bool:
    return counts.schema[n].dataType.typeName() in ("byte", "short", "integer", "long")


def swap_search(counts: DataFrame, key: str, cls: str, n: str, share: float, floor: int, restarts: int = 4) -> DataFrame:
    """Split of the keys, ``val`` or ``train``, at a local optimum of ``split_cost`` under swaps of two keys.

    Each restart begins at a hash-drawn split of all keys, and a task swaps among the first ``WORKING`` keys of either side, which are
    all keys of a table that has no more; the others stay and count by their sums.  The best restart is kept.  Unless it has the least
    cost that any split can have, its swaps between all keys are weighed by ``_better_pairs``, the best of them searched
    over again, until none is left.  So neither the driver nor a task holds more than some thousand keys.
    """
    vectors, total, keys = _count_vectors(counts, key, cls, n)
    size, target = int(keys * share + 0.5), share * total
    if not len(total):
        return vectors.select(F.col("_key").alias(key), F.lit("train").alias("split"))
    least = _least_costs(target, total, floor, _whole(counts, n))
    dealt = vectors.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))
    dealt = dealt.withColumn("_d", F.sha2(F.concat_ws("|", F.col("k").cast("string"), F.col("_key").cast("string")), 256))
    dealt = dealt.withColumn("_u", F.translate("_d", "0123456789abcdef", "fedcba9876543210"))  # the same order from its end
    val = first_of(dealt, ["k"], size, F.col("_d"), F.substring("_d", 1, 4))
    inside = first_of(dealt, ["k"], min(size, WORKING), F.col("_d"), F.substring("_d", 1, 4)).withColumn("val", F.lit(True))
    outside = first_of(dealt, ["k"], min(keys - size, WORKING), F.col("_u"), F.substring("_u", 1, 4)).withColumn("val", F.lit(False))
    found = _searched(inside.unionByName(outside), _val_sums(val, len(total), "k"), target, floor, float(least.sum()))
    best = found.orderBy("cost", "k").first()
    own = val.where(F.col("k") == best["k"]).select("_key", F.lit(True).alias("_v"))
    start = vectors.alias("l").join(own.alias("r"), F.col("l._key").eqNullSafe(F.col("r._key")), "left").select("l.*", F.col("r._v").isNotNull().alias("val"))
    split = _moved(start, found.where((F.col("k") == best["k"]) & F.col("moved")))
    while max(size, keys - size) > WORKING:
        sums = _val_sums(split.where("val"), len(total)).get((), np.zeros(len(total)))
        if float(_costs(sums, target, floor).sum()) <= float(least.sum()) * (1 + 1e-9):
            break
        top = staged(_better_pairs(split, sums, target, least, floor).orderBy(F.desc("gain"), "val_key").limit(PAIRS))
        some = top.select(F.col("val_key").alias("_key")).unionByName(top.select(F.col("train_key").alias("_key"))).distinct()
        work = split.alias("l").join(some.alias("r"), F.col("l._key").eqNullSafe(F.col("r._key")), "left_semi").withColumn("k", F.lit(0))
        moves = _searched(work, {(0,): sums}, target, floor, float(least.sum())).where("moved")
        if moves.isEmpty():
            break
        split = _moved(split, moves)
    return split.select(F.col("_key").alias(key), F.when(F.col("val"), "val").otherwise("train").alias("split"))


def improving_swaps(counts: DataFrame, split: DataFrame, key: str, cls: str, n: str, share: float, floor: int) -> DataFrame:
    """For each ``val`` key that some swap with a ``train`` key moves out at a gain the best such gain: none at an optimum.

    All pairs that may help are weighed, see ``_better_pairs``; at the least cost that any split can have there are none.
    A split far from an optimum has many.
    """
    vectors, total, _ = _count_vectors(counts, key, cls, n)
    sides = split.select(F.col(key).alias("_key"), (F.col("split") == "val").alias("_v")).alias("r")
    rows = vectors.alias("l").join(sides, F.col("l._key").eqNullSafe(F.col("r._key")), "left").select("l.*", F.coalesce("r._v", F.lit(False)).alias("val"))
    target = share * total
    sums = _val_sums(rows.where("val"), len(total)).get((), np.zeros(len(total))) if len(total) else total
    least = _least_costs(target, total, floor, _whole(counts, n)) if len(total) else total
    named = F.col("_key").cast("string").alias("key")
    if float(_costs(sums, target, floor).sum()) <= float(least.sum()) * (1 + 1e-9):
        return rows.where(F.lit(False)).select(named, F.lit(0.0).alias("gain"))
    found = _better_pairs(rows, sums, target, least, floor).select(F.col("v").alias("m"), "gain")
    return rows.where("val").join(found, "m").select(named, "gain")


def systematic(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every ``step``-th row of each key, the first included."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_at", at).where(F.col("_at") % step == 0).drop("_at")


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered in ``copy`` from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))


def protected_cap(df: DataFrame, protected: Column, order: Column, cap: int) -> DataFrame:
    """All protected rows and the first ``cap`` others in hash order."""
    common = df.where(~protected).withColumn("_o", order)
    return df.where(protected).unionByName(first_of(common, [], cap, F.col("_o"), F.substring("_o", 1, 4)).drop("_o"))
