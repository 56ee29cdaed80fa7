"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from spanlab.functions import arrays, text
from spanlab.operators import audit, intervals, metrics, rules, sampling

HOUR = 3_600_000_000


def test_tumbling_windows_stay_inside(spark):
    seg = spark.createDataFrame([(1, 0, 10), (2, 5, 8), (3, 0, 3)], "id int, a long, b long")
    rows = intervals.tumbling(seg, "a", "b", 4).orderBy("id", "k").collect()
    assert [(r.id, r.t0, r.t1) for r in rows] == [(1, 0, 4), (1, 4, 8)]


def test_range_join_meets_once_across_buckets(spark):
    points = spark.createDataFrame([(1, 7), (1, 20), (2, 7), (1, 99)], "k int, t long")
    spans = spark.createDataFrame([(1, "x", 0, 20), (1, "y", 7, 7), (2, "z", 8, 9)], "k int, name string, lo long, hi long")
    got = {(r.k, r.t, r.name) for r in intervals.range_join(points, spans, ["k"], "t", "lo", "hi", bucket=5, outer=True).collect()}
    assert got == {(1, 7, "x"), (1, 7, "y"), (1, 20, "x"), (2, 7, None), (1, 99, None)}


def test_shortest_wins_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 5, 0, 10), (1, 3, 4, 8), (1, 2, 4, 8)], "p int, id int, lo long, hi long")
    assert [r.id for r in intervals.shortest(rows, ["p"], "lo", "hi", "id", ["id"]).collect()] == [2]


def test_touching_intervals_merge_and_gaps_are_the_rest(spark):
    iv = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 8, 9), (2, 3, 5)], "k int, a long, b long")
    merged = intervals.merge(iv, ["k"], "a", "b")
    assert {(r.k, r.a, r.b, r.n) for r in merged.collect()} == {(1, 0, 6, 2), (1, 8, 9, 1), (2, 3, 5, 1)}
    assert {(r.k, r.gap_lo, r.gap_hi) for r in intervals.gaps(merged, ["k"], "a", "b", 0, 10).collect()} == {(1, 6, 8), (1, 9, 10), (2, 0, 3), (2, 5, 10)}


def test_exclusive_has_no_other_class(spark):
    iv = spark.createDataFrame([(1, 1, "x", 0, 10), (2, 1, "y", 5, 15), (3, 1, "x", 20, 30), (4, 1, "x", 25, 35)], "event_id int, k int, cls string, a long, b long")
    assert {r.event_id for r in intervals.exclusive(iv, ["k"], "a", "b", "cls", bucket=7).collect()} == {3, 4}


def filled(capacities, target):
    """Water filling by giving out one unit at a time."""
    shares = dict.fromkeys(capacities, 0)
    left = min(target, sum(capacities.values()))
    while left:
        open_ = sorted(k for k, c in capacities.items() if shares[k] < c)
        each = max(1, left // len(open_))
        for k in open_:
            give = min(each, capacities[k] - shares[k], left)
            if each == 1 and give:
                give = 1
            shares[k] += give
            left -= give
    return shares


def test_water_fill_levels(spark):
    rng = random.Random(3)
    for _ in range(4):
        capacities = {i: rng.randint(1, 30) for i in range(rng.randint(1, 12))}
        target = rng.randint(0, 200)
        df = spark.createDataFrame(list(capacities.items()), "k int, cap long")
        got = {r.k: r.share for r in sampling.water_fill(df, "k", "cap", target).collect()}
        assert sum(got.values()) == min(target, sum(capacities.values()))
        assert all(got[k] <= c for k, c in capacities.items())
        open_ = [got[k] for k, c in capacities.items() if got[k] < c]
        assert not open_ or max(got.values()) - min(open_) <= 1


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_grid_equals_trying_every_cut(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random(), 6), rng.randint(0, 1)) for _ in range(200)] + [(0.5, 1), (0.05, 0), (0.95, 1)]
    got = metrics.tune_f1(spark.createDataFrame(rows, "p double, y int").withColumn("c", F.lit(0)), ["c"], "p", "y").first()

    def f1(cut):
        tp = sum(1 for p, y in rows if p >= cut / 100 and y)
        fp = sum(1 for p, y in rows if p >= cut / 100 and not y)
        fn = sum(1 for p, y in rows if p < cut / 100 and y)
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0

    best = max(range(5, 96), key=lambda c: (round(f1(c), 12), -c))
    assert (got.cut, round(got.best, 9)) == (best, round(f1(best), 9))


def test_all_zero_class_takes_the_lowest_cut(spark):
    df = spark.createDataFrame([(0, 0.4, 0), (0, 0.6, 0)], "c int, p double, y int")
    assert metrics.tune_f1(df, ["c"], "p", "y").first().cut == 5


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.0, 0), (None, 1)], "s double, y int")
    assert metrics.auc(df, [], "s", "y").first().auc == pytest.approx(0.875)


def test_paired_single_row_has_no_error(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 4.0)], "k string, x double, z double")
    got = {r.k: (r.delta, r.se, r.armed) for r in metrics.paired(df, ["k"], "x", "z", 1).collect()}
    assert got["a"] == (1.0, None, 0) and got["b"][0] == 2.0 and got["b"][2] == 1


def test_frame_aggregators(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.5, 0.3],)], "ps array<double>")
    got = df.select(*(f(F.col("ps")).alias(k) for k, f in arrays.AGGREGATORS.items())).first()
    assert got["mean"] == pytest.approx(0.45) and got["max"] == 0.9 and got["top3"] == pytest.approx(1.7 / 3) and got["top5"] == pytest.approx(0.45)
    assert got["q75"] == pytest.approx(0.6) and got["noisy_or"] == pytest.approx(1 - 0.9 * 0.1 * 0.5 * 0.7)


def test_lists_and_indices(spark):
    lists = [[], ["a"], ["a", "b"], ["a", "b", "c"]]
    df = spark.createDataFrame([(x,) for x in lists], "xs array<string>")
    assert [r.e for r in df.select(arrays.english_list(F.col("xs")).alias("e")).collect()] == ["", "a", "a and b", "a, b and c"]
    assert arrays.ends_kept(64, 5)[0] == 0 and arrays.ends_kept(64, 5)[-1] == 63 and arrays.ends_kept(3, 9) == [0, 1, 2]


def test_text_normalisation(spark):
    df = spark.createDataFrame([("  Answer: \"Yes, it is.\"\nmore",), ("\n \n",), ("I cannot say",), (None,)], "t string")
    assert [r.s for r in df.select(text.sanitized(F.col("t")).alias("s")).collect()] == ["Yes, it is.", None, None, None]
    odd = {"response - two\twords ": "two words", "A: x": "x", "a-b": "b", "Unfortunately, no": None, "unable to tell": None, "I'm not sure": None, "it is there": "it is there", "iron": "iron", "\r\n'quoted'\rrest": "quoted", "w " * 30: "w " * 23 + "w", "Answer:": None}
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.sanitized(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == odd
    assert [r.f for r in df.select(text.finalized(F.col("t"), "None").alias("f")).collect()][1::2] == ["None", "None"]


@pytest.mark.parametrize(
    ("question", "intent"),
    [("Is a needle driver present?", "tool_presence"), ("Can you identify the organ?", "organ"), ("Can you confirm scissors are used?", "tool_presence"), ("What phase of the procedure is this?", "task"), ("Which forceps is used in this step?", "tool_identity"), ("How long does this step take?", "unknown_open"), ("", "unknown_open"), (None, "unknown_open")],
)
def test_intents(spark, question, intent):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(rules.intent(F.col("q")).alias("i")).first().i == intent


def test_audits(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.side, r.n) for r in audit.reconcile(a, b, "k").collect()} == {("missing", 1), ("both", 1), ("extra", 1)}
    assert [r.k for r in audit.exclude(a, b, ["k"]).collect()] == [1]
    with pytest.raises(audit.AuditError):
        audit.exclude(a, spark.createDataFrame([(9,)], "k int"), ["k"])
    with pytest.raises(audit.AuditError):
        audit.must_be_empty(a, "rows")
    assert [r.i for r in audit.ordinal(spark.createDataFrame([(5,), (1,), (9000,)], "k long"), "k").orderBy("k").collect()] == [1, 2, 3]


def test_samples_do_not_depend_on_partitioning(spark):
    from spanlab.functions.hashing import draw

    df = spark.range(200).withColumn("g", F.col("id") % 3)
    shares = spark.createDataFrame([(0, 5), (1, 100), (2, 0)], "g long, share long")
    take = lambda n: {r.id for r in sampling.stratified_sample(df.repartition(n), "g", shares, draw("s", F.col("id"))).collect()}
    assert take(1) == take(7) and len(take(1)) == 5 + 67


def test_swap_search_ends_where_no_swap_helps(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", c, rng.randrange(1, 30)) for i in range(20) for c in "xyz" if rng.random() < 0.8]
    counts = spark.createDataFrame(rows, "k string, cls string, n long")
    split = {r.k: r.split for r in sampling.swap_search(counts, "k", "cls", "n", 0.25, 5).collect()}
    total = {c: sum(n for _, d, n in rows if d == c) for c in "xyz"}

    def cost(val):
        own = {c: sum(n for k, d, n in rows if d == c and k in val) for c in "xyz"}
        return sum((own[c] / (0.25 * total[c]) - 1) ** 2 + 1000 * (own[c] < 5) for c in "xyz")

    val = {k for k, s in split.items() if s == "val"}
    assert len(split) == 20 and len(val) == 5
    best = cost(val)
    assert all(cost(val - {a} | {b}) >= best - 1e-9 for a in val for b in set(split) - val)
    assert best <= min(cost(set(rng.sample(sorted(split), 5))) for _ in range(50))


def test_case_split_takes_the_first_hashes(spark):
    from spanlab.functions.hashing import draw

    df = spark.range(1000).withColumn("k", F.col("id") % 203)
    got = {r.k: r.split for r in sampling.case_split(df, "k", "s", 0.2).collect()}
    order = [r.k for r in df.select("k").distinct().orderBy(draw("s", F.col("k"))).collect()]
    assert got == {k: "val" if i < 41 else "train" for i, k in enumerate(order)}
    assert sampling.case_split(df.limit(0), "k", "s", 0.2).count() == 0


def test_forms(spark):
    from spanlab.functions import forms

    df = spark.createDataFrame([("case_012/part3/000045.jpg", "grasper", 3.0, ["a", "b", "c"]), ("x", "brush", float("nan"), []), (None, None, None, None)], "p string, n string, x double, xs array<string>")
    a, b, c = df.select(forms.parsed_name(F.col("p")).alias("p"), forms.plural(F.col("n")).alias("n"), forms.valid_threshold(F.col("x") / 3).alias("v"), forms.capped_list(F.col("xs"), 2).alias("l")).collect()
    assert tuple(a.p) == (12, 3, 45) and a.n == "graspers" and a.v and a.l == "a, b +1 more"
    assert tuple(b.p) == (None, None, None) and b.n is None and not b.v and b.l == "" and not c.v
    with pytest.raises(Exception, match="unknown name"):
        df.select(forms.mapped(F.col("n"), {"brush": None})).collect()


def test_ranks_in_two_levels(spark):
    rng = random.Random(4)
    rows = [(rng.choice([rng.random() * 10 ** rng.randrange(6), float(rng.randrange(40))]), rng.randrange(2)) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1), (1.0, None)], "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    import bisect

    neg.sort()
    expected = sum((bisect.bisect_left(neg, p) + bisect.bisect_right(neg, p)) / 2 for p in pos) / len(pos) / len(neg)
    assert metrics.auc(df, [], "s", "y").first().auc == pytest.approx(expected)
    got = metrics.balanced_cut(df, "s", "y").first()
    value = lambda c: round((sum(p >= c for p in pos) / len(pos) + sum(n < c for n in neg) / len(neg)) / 2, 12)
    best = max((value(c), -c) for c in sorted({s for s, _ in rows})[:: 1])
    assert (got.balanced, got.cut) == pytest.approx((best[0], -best[1]))
    assert metrics.auc(df.limit(0), [], "s", "y").first().auc is None


def test_harvested_names_of_another_form_fail(spark):
    from spanlab.functions import records

    case = lambda path: spark.createDataFrame([(path,)], "path string").select(records.harvested_case(F.col("path")).alias("case")).collect()[0].case
    assert case("a/pseudo_case_7_part1_w0001_f00.jpg") == "case_007"
    with pytest.raises(Exception, match="no case in case_7.jpg"):
        case("case_7.jpg")


def test_names_and_settings_of_odd_texts(spark):
    from spanlab.functions import records

    df = spark.createDataFrame([("CASE_9-x-Part 07.mp4",), ("case_9.mp4",), (None,)], "n string")
    got = [r.v and tuple(r.v) for r in df.select(records.video_name(F.col("n")).alias("v")).collect()]
    assert got == [("CASE_9", "7"), None, None]
    df = spark.createDataFrame([('{"a": null, "b": 2}',), ("{",), ("",)], "t string")
    assert [r.s for r in df.select(records.settings(F.col("t"), {"a": "1"}).alias("s")).collect()] == [{"a": "1", "b": "2"}, {"a": "1"}, {"a": "1"}]


def test_replies_and_polarity(spark):
    from spanlab.functions import forms

    said = {"Yes.": "Yes", "no; really": "No", "*Yes* it is": None, "1 yes": None, "yes-man": None, "": None, " YES , so": "Yes", "nothing": None}
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", forms.polarity_of(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in got} == said
    two = F.array(F.lit("a"), F.lit("b"))
    replies = {"Answer 2.": ("b", "choice"), "answer2": ("b", "choice"), " Answer 1- x": ("a", "choice"), "Answer 3": (None, "unparseable"), "Answer 0:": (None, "unparseable"), "": (None, "unparseable"), "Answer 2 x": (None, "suppressed"), "blue": (None, "suppressed")}
    df = spark.createDataFrame([(t,) for t in replies], "t string")
    assert {r.t: tuple(r.j) for r in df.select("t", forms.judged(F.col("t"), two).alias("j")).collect()} == replies
    assert tuple(df.where("t = 'blue'").select(forms.judged(F.col("t"), two, free=True).alias("j")).first().j) == ("blue", "freetext")
    with pytest.raises(Exception, match="no part number: 2.5"):
        spark.createDataFrame([("2.5",)], "t string").select(forms.part_number(F.col("t"))).collect()
    clip = spark.createDataFrame([("a  b\nc d",)], "t string").select(forms.clipped(F.col("t"), 5).alias("c"), forms.clipped(F.col("t"), 7).alias("d")).first()
    assert tuple(clip) == ("a b …", "a b c d")


def test_templates_take_only_their_slots(spark):
    from spanlab.functions import forms

    df = spark.createDataFrame([("click", 3), ("error", None)], "tool string, n int")
    made = forms.rendered("Is  {tool} seen {n} times?", {"tool": F.col("tool"), "n": F.coalesce("n", F.lit(0)).cast("string")}, {"tool": ("click", "error")})
    assert [r.q for r in df.select(made.alias("q")).collect()] == ["Is click seen 3 times?", "Is error seen 0 times?"]
    for slot, what in ((F.lit("scalpel"), "tool can't be scalpel"), (F.lit(None).cast("string"), "tool can't be null")):
        with pytest.raises(Exception, match=what):
            df.select(forms.rendered("{tool}", {"tool": slot}, {"tool": ("click",)})).collect()
    with pytest.raises(ValueError, match="slots"):
        forms.rendered("{tool}", {"thing": F.lit("x")}, {})
    with pytest.raises(Exception, match="n can't be"):
        df.select(forms.rendered("{n}", {"n": F.lit(" ")}, {})).collect()


FORCEPS, SCISSORS, DRIVER, SEALER = "cadiere forceps", "monopolar curved scissors", "needle driver", "vessel sealer"
ALL_THREE = [FORCEPS, SCISSORS, DRIVER]
# Question, classes in view (None: not measured), task, scores, still, answer.
ANSWERS = [
    ("Is tissue being cut?", [SEALER], None, {}, None, "Yes"),
    ("Is tissue being cut?", ["stapler"], None, {}, None, "Yes"),
    ("Is tissue being cut?", [SCISSORS], None, {}, True, "No"),
    ("Is tissue not being cut?", [FORCEPS], None, {}, None, "Yes"),
    ("Is suturing taking place?", [], "suturing", {}, None, "Yes"),
    ("Is suturing taking place?", [DRIVER], None, {}, None, "Yes"),
    ("Is suturing taking place?", [FORCEPS], "other", {}, None, "No"),
    ("Is there no needle driver?", [DRIVER], None, {}, None, "No"),
    ("Is a scalpel used?", [FORCEPS], None, {}, None, "Yes"),
    ("Are no tools installed?", [], None, {}, None, "Yes"),
    ("Are any instruments in use?", [], None, {FORCEPS: 0.7}, None, "Yes"),
    ("Are any instruments in use?", [], None, {c: 0.7 for c in (*ALL_THREE, SEALER)}, None, "No"),
    ("How many instruments are there?", list(rules.TOOLS[:7]), None, {}, None, "Seven"),
    ("How many instruments are there?", None, None, {}, None, "Three"),
    ("How many forceps are there?", [FORCEPS, "prograsp forceps", DRIVER], None, {}, None, "Two"),
    ("How many forceps are there?", [], None, {}, None, "One"),
    ("What is the purpose of the scissors?", [], None, {}, None, "To cut and dissect tissue during the surgery."),
    ("What are forceps used for?", [], None, {}, None, "To grasp and hold tissues or objects during the surgery."),
    ("Why was it done?", [], None, {}, None, "To manipulate and control tissue during the surgery."),
    ("Which forceps is in use?", [DRIVER], None, {}, None, "Cadiere Forceps"),
    ("Which forceps is in use?", [FORCEPS, "prograsp forceps"], None, {"prograsp forceps": 0.9, FORCEPS: 0.2}, None, "ProGrasp Forceps"),
    ("Which instruments are in use?", ALL_THREE, None, {}, None, "Cadiere Forceps, Monopolar Curved Scissors and Needle Driver"),
    ("Which instrument does not appear?", ["tip-up fenestrated grasper"], None, {}, None, "Clip Applier"),
    ("What organ is shown?", [], "uterine horn", {}, None, "Uterine horn"),
    ("What organ is shown?", [], None, {}, None, "Tissue"),
    ("What task is performed?", [], "other", {}, None, "Surgical activity"),
    ("What task is performed?", [], None, {}, None, "The procedure involves surgical instruments."),
    ("Is rectal artery/vein dissection taking place?", [], "rectal artery/vein", {}, None, "Yes"),
    ("Is the uterine horn shown?", [], "suturing", {}, None, "No"),
    ("Is the uterine horn shown?", [], None, {}, None, "Yes"),
    ("Is this an open surgery?", [], None, {}, None, "No"),
    ("Is this not a robotic procedure?", [], None, {}, None, "No"),
    ("Is the light not bright?", [], None, {}, None, "No"),
    ("", [], None, {}, None, "The procedure involves surgical instruments."),
    (None, None, None, None, None, "The procedure involves surgical instruments."),
]


def test_answers(spark):
    from spanlab.operators import answers

    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(ANSWERS)], "i int, q string, tools array<string>, task string, scores map<string,double>, still boolean")
    got = {r.i: r.a for r in df.select("i", answers.answered(F.col("q"), F.col("tools"), F.col("task"), F.col("scores"), F.col("still")).alias("a")).collect()}
    assert {ANSWERS[i][0]: a for i, a in got.items() if a != ANSWERS[i][5]} == {}
    broken = spark.createDataFrame([("Is tissue being cut?", "{oops"), ("How many tools?", "[1]"), ("Is it on?", None)], "q string, r string")
    assert [r.a for r in broken.select(answers.answered_from(F.col("q"), F.col("r")).alias("a")).collect()] == ["No", "Three", "Yes"]
    table = answers.phrase_table()
    assert table["staplers"] == ("stapler",) and "cadiere forcepss" not in table and table["clip appliers"] == ("clip applier",)
    says = [(ALL_THREE, "suturing", "Cadiere forceps, monopolar curved scissors and needle driver are in use during suturing."), ([DRIVER], None, "Needle driver is in use in this procedure."), ([], "other", "The procedure involves surgical activity."), ([], None, "The procedure involves surgical instruments.")]
    df = spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(says)], "i int, tools array<string>, task string")
    assert [r.s for r in df.orderBy("i").select(answers.sentence(F.col("tools"), F.col("task")).alias("s")).collect()] == [x[2] for x in says]


def test_level_of_a_million_groups(spark):
    """Equal shares, the rest to the first keys, and no window over all groups."""
    groups = spark.range(1_000_000).selectExpr("id as k", "1 + id % 997 as cap")
    out = sampling.water_fill(groups, "k", "cap", 123_456_789)
    a = out.where("share > cap or share < 0").count(), out.agg(F.sum("share")).first()[0]
    assert a == (0, 123_456_789)
    full = out.where("share < cap").agg(F.min("share"), F.max("share"), F.max(F.when(F.col("share") == 149, F.col("k")))).first()
    low = out.where("share < cap").groupBy("share").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("share").collect()
    assert full[1] - full[0] <= 1 and len(low) == 2 and low[1].b < low[0].a or len(low) == 1 or low[1].b <= low[0].a
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or "rangepartitioning" not in plan


def test_sides_are_bits_of_digests(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(f"k{i}", c, rng.randrange(1, 9)) for i in range(30) for c in "xy" if rng.random() < 0.8]
    got = {r.trial: r.objective for r in sampling.fold_trials(spark.createDataFrame(rows, "k string, c string, n long"), "k", "c", "n", 300).collect()}
    import math

    def side(t, k):
        return int.from_bytes(hashlib.sha256(f"{t // 256}|{k}".encode()).digest(), "big") >> (255 - t % 256) & 1

    for t in (0, 1, 7, 8, 255, 256, 299):
        sums = {c: [sum(n for k, d, n in rows if d == c and side(t, k) == s) for s in (0, 1)] for c in "xy"}
        want = max(abs(math.log((a + 1) / (b + 1))) for a, b in sums.values()) + 0.5 * abs(sum(a - b for a, b in sums.values())) / sum(a + b for a, b in sums.values())
        assert got[t] == pytest.approx(want)
    assert len(got) == 300


def test_swaps_of_ten_thousand_cases(spark):
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.integers(0, 40, (10_000, 5)) * rng.integers(0, 2, (10_000, 5))
    val = np.zeros(10_000, bool)
    val[:2000] = True
    start = time.process_time()
    end, cost = sampling.best_swaps(m.astype(float), val, 0.2 * m.sum(axis=0), 5)
    assert time.process_time() - start < 60 and end.sum() == 2000 and cost < 1e-7
    counts = spark.createDataFrame([(i, c, int(x)) for i, row in enumerate(m[:40].tolist()) for c, x in zip("abcde", row)], "k long, c string, n long")
    split = sampling.swap_search(counts, "k", "c", "n", 0.25, 5)
    assert sampling.improving_swaps(counts, split, "k", "c", "n", 0.25, 5).count() == 0
    worst = split.withColumn("split", F.when(F.col("k") < 10, "val").otherwise("train"))
    assert sampling.improving_swaps(counts, worst, "k", "c", "n", 0.25, 5).count() > 0


def test_policies_allow_known_intents_only(spark):
    assert rules.known_intents(("purpose", "tasks", "count")) == ("purpose", "count") and rules.known_intents(()) == ()
    df = spark.createDataFrame([("Two", "Three", "count"), ("Two", "Three", "tasks")], "b string, d string, i string")
    got = df.select(rules.arbitrated(F.lit("per_intent"), F.col("b"), F.col("d"), F.col("i"), F.lit(1), ("count", "tasks")).alias("a")).collect()
    assert [r.a for r in got] == ["Three", "Two"]


def test_audits_in_one_pass(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    kept = audit.observed(df, {"n": F.count(F.lit(1)), "twos": F.count_if(F.col("x") == 2)}, lambda c: None if c == {"n": 10, "twos": 3} else str(c), F.col("x") != 2)
    assert kept.count() == 7
    with pytest.raises(audit.AuditError, match="n is 10"):
        audit.observed(df, {"n": F.count(F.lit(1))}, lambda c: f"n is {c['n']}")
    direct = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1)], "k string, score double")
    derived = spark.createDataFrame([("a", 0.9), ("a", 0.1), ("b", 0.4), ("d", 1.0)], "k string, score double")
    assert {r.k for r in audit.dependent(direct, derived, ["k"]).collect()} == {"b", "c", "d"}
    rows = [([], None, None, None, None, 1), (["a"], [float("nan")], "s", [0.5], [0.5], 1), (["a"], [0.2], "s", [0.5], [0.5], 0), (["a"], [0.2], "s", [0.4], [0.5], 2), (["a"], [0.2], "s", [0.5], [0.5], 1)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, classes array<string>, v array<double>, tuned string, against array<double>, own array<double>, version int")
    got = [r.p for r in t.orderBy("i").select(audit.threshold_problems(F.col("classes"), F.col("v"), F.col("tuned"), F.lit("s"), F.col("against"), F.col("own"), F.col("version"), 1).alias("p")).collect()]
    assert got == [["no classes", "another number of values", "value out of range", "tuned on another file", "tuned against other thresholds"], ["value out of range"], ["no version"], ["version not understood", "tuned against other thresholds"], []]


def test_phrases_match_a_plain_scan(spark):
    from spanlab.operators.phrases import phrase_join

    rng = random.Random(4)
    phrases = sorted({" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)})
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "A, b-C!", "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame([(p.upper(), i) for i, p in enumerate(phrases)], "phrase string, cls long")
    got = sorted((r.id, r["at"], r.phrase.lower(), r.cls) for r in phrase_join(df, "id", "t", table, "phrase").collect())
    want = []
    for i, t in enumerate(texts):
        words, at = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split(), 0
        while at < len(words):
            hit = max((p.split(" ") for p in phrases if words[at : at + len(p.split(" "))] == p.split(" ")), key=len, default=None)
            if hit:
                want.append((i, at, " ".join(hit), phrases.index(" ".join(hit))))
            at += len(hit or [0])
    assert got == sorted(want)
    with pytest.raises(Exception, match="more than 2 words"):
        phrase_join(df, "id", "t", table, "phrase", lengths=2).collect()
