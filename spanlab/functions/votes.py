"""Votes over answers in the order they came in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_answer(text: Column) -> Column:
    """Trimmed, lower case, dots at the end off."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\.+$", "")


def leader(answers: Column) -> Column:
    """The most frequent of an array's answers, the first to come on ties, and its share: struct(answer, share)."""
    counted = F.transform(F.array_distinct(answers), lambda a, i: F.struct(F.size(F.filter(answers, lambda b: b == a)).alias("n"), (-i).alias("first"), a.alias("answer")))
    top = F.array_max(counted)
    return F.struct(top["answer"].alias("answer"), (top["n"] / F.size(answers)).alias("share"))


def early_vote(answers: Column, seconds: Column, threshold: float, most: int, budget: float) -> Column:
    """A vote that stops when the answers agree, after ``most`` of them, or when ``seconds`` have used up ``budget``.

    From the second answer on, the vote stops as soon as the leader's share reaches ``threshold``; an answer is
    asked for only while those before it took less than ``budget``.  struct(answer, confidence, calls, agreed, curtailed), null without
    an answer.  ``answers`` holds a key's first answers, normalised and in order, and is short: the fold
    looks at each prefix.
    """
    offered = F.least(F.size(answers), F.lit(most))
    spent = lambda i: F.aggregate(F.slice(seconds, F.lit(1), i - 1), F.lit(0.0), lambda a, x: a + x)  # noqa: E731  before answer i
    upto = lambda n: F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    allowed = F.when(offered > 0, F.size(F.filter(upto(offered), lambda i: spent(i) < budget))).otherwise(0)
    states = F.transform(upto(allowed), lambda i: F.struct(i.alias("calls"), leader(F.slice(answers, F.lit(1), i)).alias("top")))
    agreed = F.get(F.filter(states, lambda s: (s["calls"] >= 2) & (s["top"]["share"] >= threshold)), F.lit(0))
    end = F.coalesce(agreed, F.element_at(states, -1))
    result = F.struct(end["top"]["answer"].alias("answer"), end["top"]["share"].alias("confidence"), end["calls"].alias("calls"), agreed.isNotNull().alias("agreed"), (agreed.isNull() & (allowed < offered)).alias("curtailed"))
    return F.when(allowed > 0, result)
