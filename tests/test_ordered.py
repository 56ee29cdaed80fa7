"""Interval index, two-level windows, exact quantiles, counted top rows, early votes, weighted draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.operators import intervals, ordered, sampling
from spanlab.operators.quantiles import quantiles

SECOND, YEAR = 1_000_000, 31_557_600_000_000


def test_the_index_stays_small_for_every_length(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50 * YEAR), int(SECOND * (10 * YEAR / SECOND) ** rng.random())) for k in range(300)]
    iv = spark.createDataFrame([(k, a, a + n) for k, a, n in rows] + [(300, 0, 10 * YEAR), (301, -5 * YEAR, 5 * YEAR), (302, 7, 7)], "id long, a long, b long")
    sizes = [r["count"] for r in intervals.indexed(iv, "a", "b").groupBy("id").count().collect()]
    assert len(sizes) == 303 and max(sizes) <= intervals.FAN + 1 < 64


def test_lookups_of_mixed_lengths_match_brute_force(spark):
    rng = random.Random(2)
    spans = [(i, rng.randrange(2), lo := rng.randrange(-2000, 60_000), lo + rng.choice([0, 3, 40, 900, 30_000]), "xyz"[i % 3]) for i in range(120)]
    points = [(j, rng.randrange(3), rng.randrange(-3000, 95_000)) for j in range(150)] + [(200 + i, k, t) for i, k, lo, hi, _ in spans[:20] for t in (lo, hi)]
    p = spark.createDataFrame(points, "p long, k int, t long")
    s = spark.createDataFrame(spans, "i long, k int, lo long, hi long, cls string")
    got = [(r.p, r.t, r.i) for r in intervals.range_join(p, s, ["k"], "t", "lo", "hi", bucket=8, fan=2).collect()]
    want = [(j, t, i) for j, k, t in points for i, q, lo, hi, _ in spans if q == k and lo <= t <= hi]
    assert sorted(got) == sorted(want)
    outer = intervals.range_join(p, s, ["k"], "t", "lo", "hi", bucket=8, fan=2, outer=True)
    kept = {(r.p, r.t) for r in outer.collect()}
    assert kept == {(j, t) for j, _, t in points} and outer.where("i is not null").count() == len(want)
    alone = {r.i for r in intervals.exclusive(s, ["k"], "lo", "hi", "cls", "i", bucket=8, fan=2).collect()}
    meets = lambda a, b: a[1] == b[1] and a[4] != b[4] and b[2] < a[3] and a[2] < b[3]
    assert alone == {a[0] for a in spans if not any(meets(a, b) for b in spans)}


def merged(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + 1]
        else:
            out.append([a, b, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bucket", [3, 50, 100_000])
def test_islands_over_bucket_borders(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice([1, 2, None]), a := rng.randrange(600), a + rng.choice([0, 1, 2, 4, 90])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    m = intervals.merge(df, ["k"], "a", "b", bucket)
    want = {(k, *x) for k in (1, 2, None) for x in merged([(a, b) for q, a, b in rows if q == k])}
    assert {(r.k, r.a, r.b, r.n) for r in m.collect()} == want
    free = {(r.k, r.gap_lo, r.gap_hi) for r in intervals.gaps(m, ["k"], "a", "b", 10, 700, bucket).collect()}
    inside = lambda k, t: any(a <= t < b for q, a, b, _ in want if q == k)
    assert {(k, t) for k, lo, hi in free for t in range(lo, hi)} == {(k, t) for k in (1, 2, None) for t in range(10, 700) if not inside(k, t)}


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_runs_and_neighbours_over_bucket_borders(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.randrange(2), t, i, rng.choice([None, 0.0, 1.0, 2.0])) for i, t in enumerate(sorted(rng.randrange(80) for _ in range(120)))]
    df = spark.createDataFrame(rows, "k int, t long, i long, v double").repartition(3)
    cell = F.floor(F.col("t") / bucket)
    got = {(r.k, r.first, r.length) for r in intervals.runs(df, ["k"], ["t", "i"], F.col("v") > 0, 2, cell).collect()}
    near = {r.i: (r.prev_v, r.next_v) for r in ordered.neighbours(df, ["k"], ["t", "i"], cell, ["v"]).collect()}
    place = {r.i: r.at for r in ordered.positions(df, ["k"], ["t", "i"], cell).collect()}
    want = set()
    for k in (0, 1):
        own = [(i, v) for q, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])) if q == k]
        start = None
        for n, (i, v) in enumerate([*own, (None, None)]):
            if v and start is None:
                start = n
            elif not v and start is not None:
                want |= {(k, start, n - start)} if n - start >= 2 else set()
                start = None
            if i is not None:
                assert place[i] == n
                assert near[i] == (own[n - 1][1] if n else None, own[n + 1][1] if n + 1 < len(own) else None)
    assert got == want


def test_a_single_key_is_dealt_over_many_tasks(spark):
    """Only tables with a row a bucket are ordered by key alone; what holds intervals is dealt by key and bucket."""
    plan = intervals.merge(spark.range(10).selectExpr("1 as k", "id as a", "id + 1 as b"), ["k"], "a", "b", 3)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any("_b#" in x for x in exchanges)
    sorts = [x for x in plan.splitlines() if "Window [" in x and "_b#" not in x]
    assert not sorts


@pytest.mark.parametrize("most", [1, 5, 100_000])
def test_quantiles_are_exact(spark, most):
    rng = random.Random(most)
    odd = [0.0, -0.0, 1e-300, -1e300, 1e300, 5e-324, 2.0]
    rows = [(g, v) for g in ("a", None) for v in [rng.choice([rng.gauss(0, 1), rng.random() * 10 ** rng.randrange(-20, 20), 7.0, *odd]) for _ in range(400)]]
    rows += [("one", 3.5), ("same", 2.0), ("same", 2.0), ("none", None), ("nan", float("nan"))]
    shares = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p90": 0.9, "hi": 1.0}
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, most).collect()}
    assert set(got) == {"a", None, "one", "same"}
    for g, r in got.items():
        own = [v for q, v in rows if q == g]
        for name, p in shares.items():
            assert r[name] == pytest.approx(float(np.quantile(own, p)), rel=1e-12, abs=1e-320)
    with pytest.raises(ValueError, match="infinite"):
        quantiles(spark.createDataFrame([(float("inf"),)], "v double"), [], "v", {"mid": 0.5})


def test_top_rows_are_those_of_a_full_ranking(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 10 else "cold", rng.randrange(40), rng.randrange(30)) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, g string, v long, k long")
    got = {r.i for r in ordered.first_of(df, ["g"], 45, F.struct("v", "i"), F.col("v") / 10).collect()}
    want = {i for g in ("hot", "cold") for i, *_ in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))[:45]}
    assert got == want
    assert ordered.first_of(df, [], 0, F.col("i"), F.lit(0)).count() == 0 and ordered.first_of(df, [], 9999, F.col("i"), F.lit(0)).count() == 600


def test_longer_spans_are_drawn_more_often(spark):
    """Inclusion in proportion to length at the first draw; no piece twice; budgets met."""
    spans = spark.createDataFrame([(c, lo, lo + n, 3) for c in range(2000) for lo, n in ((0, 10), (100, 30), (200, 60))], "c long, lo long, hi long, want long")
    rows = sampling.weighted_requests(spans, ["c"], "lo", "hi", "want", "s", 1000, 3).collect()
    assert len(rows) == 2000 and all(r.n == 3 for r in rows)
    share = {s: sum(r.start == s for r in rows) / 2000 for s in (0, 100, 200)}
    assert all(abs(share[s] - w) < 4 * math.sqrt(w * (1 - w) / 2000) for s, w in ((0, 0.1), (100, 0.3), (200, 0.6)))
    rows = sampling.weighted_requests(spark.createDataFrame([(1, 0, 25, 7), (2, 0, 5, 99), (3, 4, 4, 5)], "c long, lo long, hi long, want long"), ["c"], "lo", "hi", "want", "s", 10, 3).collect()
    one = [r for r in rows if r.c == 1]
    assert sorted((r.start, r.length) for r in one) == [(0, 10), (10, 10), (20, 5)] and [r.n for r in sorted(one, key=lambda r: r["rank"])] == [3, 3, 1]
    assert [(r.start, r.length, r.n) for r in rows if r.c == 2] == [(0, 5, 3)]


def sampled(answers, seconds, threshold, most, budget):
    """The vote restated: one answer at a time."""
    got, spent, best = [], 0.0, None
    for a, s in list(zip(answers, seconds, strict=True))[:most]:
        if spent >= budget:
            return (*best, len(got), False, True) if got else None
        got.append(a)
        spent += s
        order = sorted(set(got), key=got.index)
        top = max(order, key=lambda x: (got.count(x), -order.index(x)))
        best = (top, got.count(top) / len(got))
        if len(got) >= 2 and best[1] >= threshold:
            return (*best, len(got), True, False)
    return (*best, len(got), False, False) if got else None


def test_votes_stop_when_they_agree(spark):
    from spanlab.functions.votes import early_vote, normal_answer

    rng = random.Random(6)
    cases = [([rng.choice("abc") for _ in range(n)], [rng.choice([1.0, 5.0, 20.0]) for _ in range(n)]) for n in range(8) for _ in range(12)]
    df = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(cases)], "i long, a array<string>, s array<double>")
    for threshold, most, budget in ((0.6, 5, 30.0), (1.0, 3, 1e9), (0.5, 1, 1e9), (0.7, 7, 0.0)):
        got = {r.i: r.v for r in df.select("i", early_vote(F.col("a"), F.col("s"), threshold, most, budget).alias("v")).collect()}
        for i, (a, s) in enumerate(cases):
            want = sampled(a, s, threshold, most, budget)
            assert (got[i] and tuple(got[i])) == (want and pytest.approx(want)), (a, s)
    assert spark.createDataFrame([(" Yes.. ",)], "t string").select(normal_answer(F.col("t")).alias("n")).first().n == "yes"
