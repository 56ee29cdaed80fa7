"""Audits: queries of violating rows, checks on their number, reconciliation, ordinals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


class AuditError(ValueError):
    """A check on a table failed."""


def must_be_empty(violations: DataFrame, what: str) -> None:
    """Raises with up to five of the violating rows."""
    if rows := violations.limit(5).collect():
        raise AuditError(f"{what}: {[r.asDict() for r in rows]}")


def exclude(df: DataFrame, held_out: DataFrame, keys: Sequence[str], what: str = "held-out rows") -> DataFrame:
    """Anti-join that must remove something: no exclusion at all means the keys don't fit.

    One job joins, counts what goes as the rows pass, and writes what stays; the count is checked before anyone reads it.
    """
    marked = df.join(held_out.select(*keys).distinct().withColumn("_held", F.lit(True)), list(keys), "left")
    return observed(marked, {"held": F.count_if(F.col("_held").isNotNull())}, lambda n: f"no {what} were found to exclude" if not n["held"] else None, F.col("_held").isNull()).drop("_held")


def observed(df: DataFrame, counts: Mapping[str, Column], wrong: Callable[[dict], str | None], keep: Column | None = None) -> DataFrame:
    """``df`` written once, with ``counts`` taken from its rows in the same pass; what ``wrong`` says of them is an error.

    ``keep`` filters the rows behind the counts.
    """
    seen = Observation()
    passed = df.observe(seen, *(c.alias(name) for name, c in counts.items()))
    out = staged(passed if keep is None else passed.where(keep))
    if (problem := wrong(seen.get)) is not None:
        raise AuditError(problem)
    return out


def digest_problems(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``expected(key, sha256, size)`` against ``found`` of the same columns: key and its problems, none for a file as it should be."""
    both = expected.alias("e").join(found.select(F.col(key).alias("_k"), F.col("sha256").alias("_s"), F.col("size").alias("_n")), F.col(f"e.{key}") == F.col("_k"), "left")
    gone = F.col("_k").isNull()
    tests = [F.when(gone, "missing"), F.when(~gone & ~F.col("sha256").eqNullSafe(F.col("_s")), "sha256 differs"), F.when(~gone & ~F.col("size").eqNullSafe(F.col("_n")), "size differs")]
    return both.select(F.col(f"e.{key}").alias(key), F.array_compact(F.array(*tests)).alias("problems"))


def threshold_problems(classes: Column, values: Column, tuned_on: Column, sha256: Column, against: Column, own: Column, version: Column, understood: int) -> Column:
    """What is wrong with thresholds that stand by position beside classes, first things first.

    A version that isn't one or isn't understood; no classes; another number of values; a value outside 0 to 1 or no
    number; thresholds tuned on another file, or against other thresholds than the file's own.
    """
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | ~v.between(0, 1))
    differ = (F.size(against) != F.size(own)) | F.exists(F.arrays_zip(against.alias("a"), own.alias("b")), lambda x: F.abs(x["a"] - x["b"]) > 1e-9)
    yes = lambda test, what: F.when(F.coalesce(test, F.lit(True)), what)
    return F.array_compact(
        F.array(
            yes(version < 1, "no version"),
            yes(version > understood, "version not understood"),
            yes(F.size(classes) < 1, "no classes"),
            yes(F.size(values) != F.size(classes), "another number of values"),
            yes(bad, "value out of range"),
            yes(~tuned_on.eqNullSafe(sha256), "tuned on another file"),
            yes(differ, "tuned against other thresholds"),
        )
    )


def dependent(direct: DataFrame, derived: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys whose score against all references at once isn't the best of the scores against each, or that one side lacks.

    ``direct(keys, score)``, ``derived(keys, score)``; anything derived from single references needs this to be empty.
    """
    best = derived.groupBy(*keys).agg(F.max("score").alias("_best"))
    both = direct.join(best, list(keys), "full_outer")
    return both.where(F.coalesce(F.abs(F.col("score") - F.col("_best")) > tolerance, F.lit(True))).select(*keys, "score", F.col("_best").alias("best"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a split, which should have none."""
    return a.select(key).intersect(b.select(key))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """side (both, missing in b, extra in b), n."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").otherwise("both")
    return left.join(right, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def ordinal(df: DataFrame, key: str, run: int = 4096) -> DataFrame:
    """Adds ``i``, the row's place from 1 in the order of an integer key, counted in two levels.

    Rows are numbered inside runs of key values; only the runs' sizes are summed in one place.
    """
    dealt = df.withColumn("_run", F.floor(F.col(key) / run))
    sizes = dealt.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_run").orderBy(key))
    return dealt.withColumn("_own", own).join(before, "_run").withColumn("i", F.col("_own") + F.col("_before")).drop("_run", "_own", "_before")
