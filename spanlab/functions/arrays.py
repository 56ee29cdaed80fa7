"""Array functions: frame reductions, lists in English, index arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def english_list(items: Column) -> Column:
    """"A", "A and B", "A, B and C"."""
    n = F.size(items)
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(items, n - 1)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return total(xs) / F.when(F.size(xs) > 0, F.size(xs))


def top_mean(xs: Column, k: int) -> Column:
    """Mean of the k largest, of all where there are fewer."""
    return mean(F.slice(F.sort_array(xs, asc=False), 1, k))


def trimmed_mean(xs: Column, share: float) -> Column:
    """Mean without floor(n * share) values at each end."""
    cut = F.floor(F.size(xs) * F.lit(share)).cast("int")
    return mean(F.slice(F.sort_array(xs), cut + 1, F.size(xs) - 2 * cut))


def noisy_or(xs: Column) -> Column:
    return 1 - F.aggregate(xs, F.lit(1.0), lambda a, x: a * (1 - x))


def quantile(xs: Column, q: float) -> Column:
    """Quantile with linear interpolation between the neighbours."""
    ordered, at = F.sort_array(xs), F.lit(q) * (F.size(xs) - 1)
    lo, hi = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - F.floor(at))


AGGREGATORS = {
    "mean": mean,
    "max": F.array_max,
    "q75": lambda xs: quantile(xs, 0.75),
    "q90": lambda xs: quantile(xs, 0.9),
    "trim10": lambda xs: trimmed_mean(xs, 0.1),
    "trim20": lambda xs: trimmed_mean(xs, 0.2),
    "top3": lambda xs: top_mean(xs, 3),
    "top5": lambda xs: top_mean(xs, 5),
    "noisy_or": noisy_or,
}


def bin_centres(n: Column, wanted: Column) -> Column:
    """Indices of evenly spaced bin centres among n; all where n is not larger."""
    return F.when(n <= wanted, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), wanted - 1), lambda i: F.floor((i + 0.5) * n / wanted).cast("int")))


def ends_kept(n: int, k: int) -> list[int]:
    """k of n indices, both ends among them; rounding half to even, gaps filled in order."""
    if k >= n:
        return list(range(n))
    picked = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]
    spare = (i for i in range(n) if i not in picked)
    while len(picked) < k:
        picked = sorted([*picked, next(spare)])
    return picked


def centred_slice(xs: Column, at: Column, width: int) -> Column:
    """``width`` elements around place ``at`` (from 0), slid inwards at the ends."""
    start = F.greatest(F.lit(1), F.least(at - width // 2 + 1, F.size(xs) - width + 1))
    return F.slice(xs, start.cast("int"), width)
