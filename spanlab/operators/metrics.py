"""Evaluation operators: F1, thresholds on a grid, two-fold scoring, AUC, cuts, paired statistics.

Thresholds are tuned without joining rows to the grid: scores are first counted per grid cell,
then a running sum over at most ``GRID`` cells gives the counts at every cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 91  # cuts 0.05 to 0.95 in steps of 0.01
LOW, STEP = 5, 100


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), 0 where nothing was to be found or was found."""
    whole = 2 * tp + fp + fn
    return F.when(whole == 0, F.lit(0.0)).otherwise(2 * tp / whole)


def confusion(df: DataFrame, keys: Sequence[str], hit: Column, y: Column) -> DataFrame:
    """tp, fp, fn, tn by key."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(*keys).agg(n(hit & (y == 1)).alias("tp"), n(hit & (y == 0)).alias("fp"), n(~hit & (y == 1)).alias("fn"), n(~hit & (y == 0)).alias("tn"))


def cut_counts(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """keys, cut (hundredths), tp, fp, fn, tn at all GRID cuts; a row counts at the cuts <= round(p, 6)."""
    cell = F.least(F.floor(F.round((F.round(p, 6) - LOW / STEP) * STEP, 6)), F.lit(GRID - 1)).cast("int")
    cells = df.groupBy(*keys, F.greatest(cell, F.lit(-1)).alias("cell")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))) if keys else df.sparkSession.range(GRID).select(F.col("id").cast("int").alias("cell"))
    every = grid.join(cells.where("cell >= 0"), [*keys, "cell"], "left").na.fill(0, ["pos", "n"])
    totals = cells.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    up = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("tp", F.sum("pos").over(up)).withColumn("hits", F.sum("n").over(up))
    every = every.join(totals, list(keys)) if keys else every.crossJoin(F.broadcast(totals))
    return every.select(*keys, (F.col("cell") + LOW).alias("cut"), "tp", (F.col("hits") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("all_pos") - F.col("hits") + F.col("tp")).alias("tn"))


def best_cut(counts: DataFrame, keys: Sequence[str], objective: Column) -> DataFrame:
    """keys, cut, best: the lowest cut of the best objective."""
    scored = counts.withColumn("_o", F.round(objective, 12))
    best = F.max(F.struct(F.col("_o"), (-F.col("cut")).alias("c"))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, (-F.col("b.c")).alias("cut"), F.col("b._o").alias("best"))


def tune_f1(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    return best_cut(cut_counts(df, keys, p, y), keys, f1(F.col("tp"), F.col("fp"), F.col("fn")))


def tune_accuracy(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    every = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return best_cut(cut_counts(df, keys, p, y), keys, (F.col("tp") + F.col("tn")) / every)


def two_fold(df: DataFrame, keys: Sequence[str], cls: str, p: str, y: str, fold: str) -> DataFrame:
    """Macro-F1 with cuts tuned on one fold and scored on the other, averaged; classes measurable in both folds only.

    keys, honest, n_classes.
    """
    counts = cut_counts(df, [*keys, cls, fold], p, y)
    cuts = best_cut(counts, [*keys, cls, fold], f1(F.col("tp"), F.col("fp"), F.col("fn"))).select(*keys, cls, (1 - F.col(fold)).alias(fold), "cut")
    scored = counts.join(cuts, [*keys, cls, fold, "cut"]).withColumn("score", f1(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("seen", F.col("tp") + F.col("fn"))
    per = scored.groupBy(*keys, cls).agg(F.avg("score").alias("score"), F.min("seen").alias("seen"), F.count(F.lit(1)).alias("folds")).where("seen > 0 and folds = 2")
    return per.groupBy(*keys).agg(F.avg("score").alias("honest"), F.count(F.lit(1)).alias("n_classes"))


CELLS = 256


def sums_below(per: DataFrame, keys: Sequence[str], value: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``below_<c>``, the sum of each column over the rows of a lower value, one row a value.

    Without keys the values are dealt into ``CELLS`` cells by their quantiles; rows are summed up
    inside a cell, and only the cells' sums are gone through in one place.
    """
    cell = F.lit(0)
    if not keys:
        cuts = per.agg(F.percentile_approx(value, [k / CELLS for k in range(1, CELLS)], 10_000)).first()[0]
        if cuts:
            cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(value)))
    per = per.withColumn("_cell", cell)
    past = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    own, whole = past(Window.partitionBy(*keys, "_cell").orderBy(value)), past(Window.partitionBy(*keys).orderBy("_cell"))
    none = F.lit(0).cast("long")
    cells = per.groupBy(*keys, "_cell").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    cells = cells.select(*keys, "_cell", *(F.coalesce(F.sum(f"_{c}").over(whole), none).alias(f"_{c}") for c in columns))
    for c in columns:
        per = per.withColumn(f"below_{c}", F.coalesce(F.sum(c).over(own), none))
    per = per.join(cells, [*keys, "_cell"])
    return per.select(*(c for c in per.columns if not c.startswith(("_", "below_"))), *((F.col(f"below_{c}") + F.col(f"_{c}")).alias(f"below_{c}") for c in columns))


def auc(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """Mann-Whitney by average ranks, ties one half; rows without score or label are left out.

    Rows are counted per distinct score before anything is ranked, so ties cost nothing.
    """
    kept = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    per = kept.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = sums_below(per, keys, score, ["n"]).withColumn("rank", F.col("below_n") + (F.col("n") + 1) / 2)
    P, N = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    value = (F.sum(F.col("rank") * F.col("pos")) - P * (P + 1) / 2) / F.when(P * N > 0, P * N)
    return ranked.groupBy(*keys).agg(value.alias("auc"), P.alias("positives"), N.alias("negatives"))


def balanced_cut(df: DataFrame, score: str, y: str) -> DataFrame:
    """The lowest observed value at which ``score >= value`` has the best balanced accuracy; rows without score or label are left out."""
    kept = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    per = kept.groupBy(F.col(score).alias("cut")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(per.agg(F.sum("pos").alias("all_pos"), F.sum(F.col("n") - F.col("pos")).alias("all_neg")))  # one row
    per = sums_below(per, [], "cut", ["pos", "n"]).crossJoin(totals)
    missed, dropped = F.col("below_pos"), F.col("below_n") - F.col("below_pos")
    value = F.round(((F.col("all_pos") - missed) / F.col("all_pos") + dropped / F.col("all_neg")) / 2, 12)
    best = per.agg(F.max(F.struct(value.alias("v"), (-F.col("cut")).alias("c"))).alias("b"))
    return best.select((-F.col("b.c")).alias("cut"), F.col("b.v").alias("balanced"))


def paired(df: DataFrame, keys: Sequence[str], a: str, b: str, sigmas: float) -> DataFrame:
    """keys, n, delta (mean of b - a), se, armed (delta > sigmas * se); se is null for a single row."""
    d = F.col(b) - F.col(a)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta"), F.when(F.count(F.lit(1)) > 1, F.sqrt(F.var_samp(d) / F.count(F.lit(1)))).alias("se"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return out.withColumn("armed", F.coalesce((F.col("delta") > sigmas * F.col("se")).cast("int"), F.lit(0)))
