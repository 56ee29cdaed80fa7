"""Queries over event intervals and their one-hour windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import english_list
from ..functions.forms import rendered
from ..functions.hashing import draw, index_counts, stable_index
from ..operators import intervals as I
from ..operators import ordered as O
from ..operators import sampling as S
from ..operators.quantiles import quantiles
from ..plans import views as V
from ..plans.views import DAY, EV, HOUR, STAB, VOCABULARY
from ..sources.shared import staged
from .registry import query, table

KEYS = ["case_id", "part"]


SETS = STAB + """,
wset AS (SELECT w.case_id, w.part, w.seg_id, w.k, w.t0, w.mid, w.t1, count(s.cls) AS bag,
                coalesce(list_sort(list(DISTINCT s.cls) FILTER (WHERE s.cls IS NOT NULL)), []) AS classes
         FROM win w LEFT JOIN stab s USING (case_id, part, seg_id, k, t0, mid, t1) GROUP BY ALL)"""


@query(f"""WITH {EV}, again AS (SELECT case_id, cls, value, a, b, part, part_b, event_id FROM ev UNION ALL SELECT case_id, cls, value, a, b, part, part_b, event_id FROM ev WHERE event_id % 3 = 0),
once AS (SELECT DISTINCT * FROM again)
SELECT case_id, count(*)::BIGINT AS n, sum(b - a)::BIGINT AS micros FROM once WHERE part = part_b AND b > a GROUP BY case_id""")
def q_clean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.ev(spark, sf_dir)
    again = e.unionByName(e.where("event_id % 3 = 0"))
    once = I.clean(again, again.columns, (F.col("part") == F.col("part_b")) & (F.col("b") > F.col("a")))
    return once.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("micros"))


@query(f"""WITH {EV} SELECT CASE WHEN value < 1 THEN 'low' WHEN part <> part_b THEN 'part' WHEN cls = 'error' THEN 'cls' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM ev GROUP BY 1""")
def q_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drop_reasons(V.ev(spark, sf_dir), [("low", F.col("value") < 1), ("part", F.col("part") != F.col("part_b")), ("cls", F.col("cls") == "error")])


@query("""SELECT e.event_type AS cls, v.idx::BIGINT AS idx, count(*)::BIGINT AS n FROM events e
JOIN (VALUES ('click', 0), ('purchase', 1), ('view', 2)) v(name, idx) ON lower(trim(upper(e.event_type) || ' ')) = v.name GROUP BY 1, 2""")
def q_vocab_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.concat(F.upper("event_type"), F.lit(" ")).alias("raw"))
    names = spark.createDataFrame([("click", 0), ("purchase", 1), ("view", 2)], "cls string, idx long")
    return raw.withColumn("cls", F.lower(F.trim("raw"))).join(F.broadcast(names), "cls").groupBy("cls", "idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT DISTINCT case_id, part, seg_id, k, t0, mid, t1 FROM win")
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.win(spark, sf_dir).dropDuplicates()


@query(f"WITH {SETS} SELECT case_id, part, seg_id, k, len(classes)::BIGINT AS n_classes FROM wset")
def q_stab_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.window_sets(spark, sf_dir).select("case_id", "part", "seg_id", "k", F.size("classes").cast("long").alias("n_classes"))


@query(f"""WITH {EV} SELECT w.case_id, w.part, w.seg_id, w.k, arg_min(s.event_id, (s.b - s.a, s.event_id))::BIGINT AS best_id, arg_min(s.cls, (s.b - s.a, s.event_id)) AS best_cls
FROM win w JOIN seg s ON s.case_id = w.case_id AND s.part = w.part AND w.mid BETWEEN s.a AND s.b GROUP BY 1, 2, 3, 4""")
def q_stab_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = V.seg(spark, sf_dir).select("case_id", "part", F.col("event_id").alias("best_id"), F.col("cls").alias("best_cls"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    joined = I.range_join(V.win(spark, sf_dir), segs, KEYS, "mid", "sa", "sb")
    return I.shortest(joined, ["case_id", "part", "seg_id", "k"], "sa", "sb", "best_id", ["best_id", "best_cls"])


@query(f"""WITH {EV}, cover AS (SELECT w.case_id, w.part, w.seg_id, w.k, t.cls FROM win w LEFT JOIN tool t ON t.case_id = w.case_id AND t.part = w.part AND t.a <= w.t0 AND t.b >= w.t1)
SELECT case_id, part, seg_id, k, CASE WHEN count(DISTINCT cls) = 1 THEN min(cls) END AS cls FROM cover GROUP BY 1, 2, 3, 4""")
def q_contain_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = V.tool(spark, sf_dir).select("case_id", "part", "cls", F.col("a").alias("ta"), F.col("b").alias("tb"))
    joined = I.range_join(V.win(spark, sf_dir), tools, KEYS, "t0", "ta", "tb", outer=True)
    covering = F.when(F.col("tb") >= F.col("t1"), F.col("cls"))
    lo, hi = F.min(covering), F.max(covering)
    return joined.groupBy("case_id", "part", "seg_id", "k").agg(F.when(lo == hi, lo).alias("cls"))


@query(f"""WITH {EV} SELECT event_id, case_id, part, cls, (b - a)::BIGINT AS micros, row_number() OVER (ORDER BY b - a DESC, event_id)::BIGINT AS rank FROM tool i
WHERE NOT EXISTS (SELECT 1 FROM tool o WHERE o.case_id = i.case_id AND o.part = i.part AND o.cls <> i.cls AND o.a < i.b AND i.a < o.b) QUALIFY rank <= 500""")
def q_exclusive_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = I.exclusive(V.tool(spark, sf_dir), KEYS, "a", "b", "cls").select("event_id", "case_id", "part", "cls", (F.col("b") - F.col("a")).alias("micros"))
    top = alone.orderBy(F.desc("micros"), "event_id").limit(500)  # the feature is a top list
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("micros"), "event_id")).cast("long"))


@query(f"""WITH {EV} SELECT e.event_id, CAST(EXISTS (SELECT 1 FROM seg s WHERE s.case_id = e.case_id AND s.part = e.part AND e.a BETWEEN s.a AND s.b) AS INT) AS inside FROM ev e""")
def q_in_any_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = V.seg(spark, sf_dir).select("case_id", "part", F.col("a").alias("sa"), F.col("b").alias("sb"))
    joined = I.range_join(V.ev(spark, sf_dir).select("case_id", "part", "event_id", "a"), segs, KEYS, "a", "sa", "sb", outer=True)
    return joined.groupBy("event_id").agg(F.max(F.col("sa").isNotNull().cast("int")).alias("inside"))


MERGED = EV + """, marked AS (SELECT *, CASE WHEN a > max(b) OVER o OR max(b) OVER o IS NULL THEN 1 ELSE 0 END AS opens FROM iv WINDOW o AS (PARTITION BY case_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
isl AS (SELECT *, sum(opens) OVER (PARTITION BY case_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT case_id, min(a) AS a, max(b) AS b, count(*)::BIGINT AS n FROM isl GROUP BY case_id, island)"""


@query(f"WITH {MERGED} SELECT case_id, a, b, n FROM merged")
def q_merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(V.iv(spark, sf_dir), ["case_id"], "a", "b").select("case_id", "a", "b", "n")


_LO, _HI = 1_704_067_200_000_000, 1_706_745_600_000_000  # January 2024


@query(f"""WITH {MERGED}, g AS (SELECT case_id, greatest(coalesce(lag(b) OVER (PARTITION BY case_id ORDER BY a), {_LO}), {_LO}) AS gap_lo, least(a, {_HI}) AS gap_hi FROM merged
UNION ALL SELECT case_id, greatest(max(b), {_LO}), {_HI} FROM merged GROUP BY case_id) SELECT case_id, gap_lo, gap_hi FROM g WHERE gap_lo < gap_hi""")
def q_interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gaps(I.merge(V.iv(spark, sf_dir), ["case_id"], "a", "b"), ["case_id"], "a", "b", _LO, _HI)


@query("""WITH p AS (SELECT user_id AS case_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY case_id ORDER BY pos) AS island FROM p WHERE value > 20)
SELECT case_id, min(pos)::BIGINT AS first, count(*)::BIGINT AS length FROM h GROUP BY case_id, island HAVING count(*) >= 3""")
def q_run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "ts", "event_id", "value")
    return I.runs(e, ["case_id"], ["ts", "event_id"], F.col("value") > 20, 3, F.to_date("ts"))


@query(f"""WITH {MERGED}, c AS (SELECT case_id, a, b, coalesce(sum(b - a) OVER (PARTITION BY case_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(b - a) OVER (PARTITION BY case_id) AS total FROM merged),
s AS (SELECT case_id, a, before, b - a AS len, total, unnest(range(8)) AS i FROM c)
SELECT case_id, i::BIGINT AS anchor, (a + ((2 * i + 1) * total) // 16 - before)::BIGINT AS at FROM s WHERE ((2 * i + 1) * total) // 16 >= before AND ((2 * i + 1) * total) // 16 < before + len""")
def q_span_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_anchors(I.merge(V.iv(spark, sf_dir), ["case_id"], "a", "b"), ["case_id"], "a", "b", 8)


_PER_CASE, _BATCH = 12, 4


@query(f"""WITH {MERGED.replace("FROM iv WINDOW", "FROM tool WINDOW")}, g AS (SELECT case_id, greatest(coalesce(lag(b) OVER (PARTITION BY case_id ORDER BY a), {_LO}), {_LO}) AS lo, least(a, {_HI}) AS hi FROM merged
UNION ALL SELECT case_id, greatest(max(b), {_LO}), {_HI} FROM merged GROUP BY case_id),
s AS (SELECT case_id, 'active' AS kind, a AS lo, b AS hi FROM merged UNION ALL SELECT case_id, 'idle', lo, hi FROM g WHERE lo < hi),
k AS (SELECT case_id, kind, CASE WHEN count(*) OVER (PARTITION BY case_id) = 2 THEN {_PER_CASE // 2} ELSE {_PER_CASE} END AS want FROM (SELECT DISTINCT case_id, kind FROM s)),
p AS (SELECT case_id, kind, want, lo + i * {HOUR} AS start, least({HOUR}, hi - lo - i * {HOUR}) AS length FROM (SELECT *, unnest(range(0, (hi - lo - 1) // {HOUR} + 1)) AS i FROM s) JOIN k USING (case_id, kind)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY -ln((('0x' || sha256('spans|' || case_id || '|' || kind || '|' || start)[1:13])::BIGINT + 1) / 4503599627370496.0) / length, start) AS rank FROM p)
SELECT case_id, kind, start::BIGINT AS start, length::BIGINT AS length, least({_BATCH}, want - (rank - 1) * {_BATCH})::BIGINT AS n, rank::BIGINT AS rank FROM r WHERE rank <= (want + {_BATCH - 1}) // {_BATCH}""")
def q_span_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of a case's anchors from spans in use, half from the gaps, each drawn by length; a kind that is absent leaves its half to the other."""
    active = staged(I.merge(V.tool(spark, sf_dir), ["case_id"], "a", "b").select("case_id", "a", "b"))
    idle = I.gaps(active, ["case_id"], "a", "b", _LO, _HI)
    spans = active.select("case_id", F.lit("active").alias("kind"), F.col("a").alias("lo"), F.col("b").alias("hi")).unionByName(idle.select("case_id", F.lit("idle").alias("kind"), F.col("gap_lo").alias("lo"), F.col("gap_hi").alias("hi")))
    kinds = spans.groupBy("case_id").agg(F.count_distinct("kind").alias("kinds"))
    asked = spans.join(kinds, "case_id").withColumn("want", F.when(F.col("kinds") == 2, _PER_CASE // 2).otherwise(_PER_CASE).cast("long"))
    return S.weighted_requests(asked, ["case_id", "kind"], "lo", "hi", "want", "spans", HOUR, _BATCH)


@query(f"WITH {STAB}, d AS (SELECT DISTINCT case_id, part, seg_id, k, cls FROM stab) SELECT v.cls, count(d.cls)::BIGINT AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(cls) LEFT JOIN d USING (cls) GROUP BY v.cls")
def q_class_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: windows per class, classes without any zero-filled."""
    seen = V.window_sets(spark, sf_dir).select(F.explode("classes").alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(v,) for v in VOCABULARY], "cls string")
    return names.join(seen, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {EV} SELECT cls, count(*)::BIGINT AS intervals, round(sum(b - a) / {HOUR}.0, 6) AS hours FROM iv GROUP BY cls")
def q_duration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.iv(spark, sf_dir).groupBy("cls").agg(F.count(F.lit(1)).alias("intervals"), F.round(F.sum(F.col("b") - F.col("a")) / float(HOUR), 6).alias("hours"))


@query(f"""WITH {SETS} SELECT kind, size, count(*)::BIGINT AS n FROM (SELECT 'bag' AS kind, bag::BIGINT AS size FROM wset UNION ALL SELECT 'set', len(classes)::BIGINT FROM wset) GROUP BY kind, size""")
def q_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.explode(F.array(F.struct(F.lit("bag").alias("kind"), F.col("bag").cast("long").alias("size")), F.struct(F.lit("set").alias("kind"), F.size("classes").cast("long").alias("size")))).alias("s")
    return V.window_sets(spark, sf_dir).select(sizes).groupBy("s.kind", "s.size").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {STAB}, d AS (SELECT DISTINCT case_id, part, seg_id, k, cls, CAST((mid // {HOUR}) % 24 // 6 AS BIGINT) AS bucket FROM stab), t AS (SELECT count(*) AS n FROM win)
SELECT cls, bucket, round(count(*) / sum(count(*)) OVER (PARTITION BY cls), 6) AS p_bucket, round(sum(count(*)) OVER (PARTITION BY cls) / (SELECT n FROM t), 6) AS p_class FROM d GROUP BY cls, bucket""")
def q_window_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = V.window_sets(spark, sf_dir)
    counts = windows.select(F.explode("classes").alias("cls"), F.expr(f"cast(mid div {HOUR} % 24 div 6 as long)").alias("bucket")).groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = V.win(spark, sf_dir).agg(F.count(F.lit(1)).alias("windows"))
    own = F.sum("n").over(Window.partitionBy("cls"))
    return counts.crossJoin(F.broadcast(total)).select("cls", "bucket", F.round(F.col("n") / own, 6).alias("p_bucket"), F.round(own / F.col("windows"), 6).alias("p_class"))  # one row of totals


@query(f"""WITH {SETS}, c AS (SELECT array_to_string(classes, '|') AS itemset, len(classes)::BIGINT AS size, count(*)::BIGINT AS n FROM wset WHERE len(classes) > 0 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, itemset)::BIGINT AS rank FROM c""")
def q_itemset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = V.window_sets(spark, sf_dir).where(F.size("classes") > 0).groupBy(F.array_join("classes", "|").alias("itemset"), F.size("classes").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return sets.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "itemset")).cast("long"))


@query(f"""WITH {STAB}, d AS (SELECT DISTINCT case_id, part, seg_id, k, cls FROM stab)
SELECT case_id, count(*) FILTER (WHERE cls = 'click')::BIGINT AS click, count(*) FILTER (WHERE cls = 'error')::BIGINT AS error, count(*) FILTER (WHERE cls = 'signup')::BIGINT AS signup FROM d GROUP BY case_id""")
def q_case_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = V.window_sets(spark, sf_dir).select("case_id", F.explode("classes").alias("cls"))
    return each.groupBy("case_id").pivot("cls", ["click", "error", "signup"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""WITH {EV}, l AS (SELECT case_id, list_sort(list(DISTINCT cls)) AS c FROM ev GROUP BY case_id)
SELECT case_id, CASE WHEN len(c) = 1 THEN c[1] ELSE array_to_string(c[1:len(c) - 1], ', ') || ' and ' || c[len(c)] END AS listed FROM l""")
def q_english_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ev(spark, sf_dir).groupBy("case_id").agg(F.sort_array(F.collect_set("cls")).alias("c")).select("case_id", english_list(F.col("c")).alias("listed"))


_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()


@query(f"""WITH {EV} SELECT case_id, coalesce(list_extract({_WORDS}, count(DISTINCT cls)::INT + 1), count(DISTINCT cls)::VARCHAR) AS word FROM tool GROUP BY case_id""")
def q_count_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("cls")
    words = F.array(*map(F.lit, _WORDS))
    return V.tool(spark, sf_dir).groupBy("case_id").agg(n.alias("n")).select("case_id", F.coalesce(F.get(words, F.col("n").cast("int")), F.col("n").cast("string")).alias("word"))


@query(f"""WITH {SETS} SELECT case_id, part, seg_id, k, array_to_string([CASE WHEN list_contains(classes, v) THEN 1 ELSE 0 END FOR v IN ['click', 'error', 'purchase', 'signup', 'view']], '') AS hot FROM wset""")
def q_multi_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.transform(F.array(*map(F.lit, VOCABULARY)), lambda v: F.array_contains("classes", v).cast("int").cast("string"))
    return V.window_sets(spark, sf_dir).select("case_id", "part", "seg_id", "k", F.array_join(hot, "").alias("hot"))


_MARGIN, _SPACING = HOUR // 4, HOUR


@query(f"""WITH {EV}, s AS (SELECT event_id, a + {_MARGIN} AS lo, b - a - 2 * {_MARGIN} AS span FROM tool WHERE b - a >= 2 * {_MARGIN}), n AS (SELECT *, least(5, span // {_SPACING} + 1) AS n FROM s)
SELECT event_id, i::BIGINT AS i, (lo + ((2 * i + 1) * span) // (2 * n))::BIGINT AS at FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def q_interval_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval_points(V.tool(spark, sf_dir), "a", "b", _MARGIN, _SPACING, 5).select("event_id", "i", "at")


@query(f"WITH {EV} SELECT case_id, part, seg_id, k, i::BIGINT AS burst, (t0 + ((2 * i + 1) * {HOUR}) // 8 - 30000000)::BIGINT AS start FROM (SELECT *, unnest(range(4)) AS i FROM win)")
def q_burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.win(spark, sf_dir).withColumn("burst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return w.select("case_id", "part", "seg_id", "k", "burst", F.expr(f"t0 + ((2 * burst + 1) * {HOUR}) div 8 - 30000000").alias("start"))


_SHAPES = ("presence", "count", "listing", "absence", "first", "task")
_QA = f"""WITH {SETS}, x AS (SELECT *, case_id || '|' || part || '|' || seg_id || '|' || k AS key FROM wset),
y AS (SELECT key, classes, unnest({list(_SHAPES)}) AS shape FROM x),
z AS (SELECT *, CAST(('0x' || sha256(key || '|' || shape)[1:16])::UHUGEINT % 3 AS BIGINT) AS phrase FROM y)
SELECT shape, phrase, CASE shape WHEN 'presence' THEN CASE WHEN list_contains(classes, 'click') THEN 'Yes' ELSE 'No' END WHEN 'count' THEN len(classes)::VARCHAR
 WHEN 'listing' THEN coalesce(nullif(array_to_string(classes, ', '), ''), 'none') WHEN 'absence' THEN CASE WHEN list_contains(classes, 'error') THEN 'No' ELSE 'Yes' END
 WHEN 'first' THEN coalesce(classes[1], 'none') ELSE 'hour' END AS answer, count(*)::BIGINT AS n FROM z GROUP BY ALL"""


@query(_QA)
def q_qa_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six question shapes a window in one pass; the paraphrase is chosen by hash."""
    has = lambda c: F.array_contains("classes", c)
    answers = {
        "presence": F.when(has("click"), "Yes").otherwise("No"),
        "count": F.size("classes").cast("string"),
        "listing": F.coalesce(F.nullif(F.array_join("classes", ", "), F.lit("")), F.lit("none")),
        "absence": F.when(has("error"), "No").otherwise("Yes"),
        "first": F.coalesce(F.get("classes", F.lit(0)), F.lit("none")),
        "task": F.lit("hour"),
    }
    key = F.concat_ws("|", "case_id", "part", "seg_id", "k")
    return index_counts(V.window_sets(spark, sf_dir), key, {s: answers[s] for s in _SHAPES}, 3).select(F.col("name").alias("shape"), F.col("index").alias("phrase"), "answer", "n")


_TOOLS = ("click", "error", "signup")
_PURPOSES = {"click": "to choose", "error": "to report", "signup": "to join"}
_HASHED = "CAST(('0x' || sha256(key || '|{0}')[1:16])::UHUGEINT % {1} AS BIGINT)"
_QA_SLOTS = f"""WITH {SETS}, x AS (SELECT case_id || '|' || part || '|' || seg_id || '|' || k AS key, part, bag, classes AS present, [c FOR c IN {list(_TOOLS)} IF NOT list_contains(classes, c)] AS absent FROM wset),
h AS (SELECT *, {_HASHED.format("presence", 2)} = 0 AS yes, {_HASHED.format("variant", 2)} = 0 AS same, {_HASHED.format("confirm", 2)} = 0 AS right_, {_HASHED.format("procedure", 25)} = 0 AS told,
 present[{_HASHED.format("pick", "greatest(len(present), 1)::UHUGEINT")} + 1] AS p, absent[{_HASHED.format("pick", "greatest(len(absent), 1)::UHUGEINT")} + 1] AS a, CASE WHEN bag > 1 THEN 'many' ELSE 'one' END AS family FROM x),
r AS (SELECT unnest([
 {{'shape': 'presence_of', 'slot': CASE WHEN p IS NOT NULL AND (a IS NULL OR yes) THEN p ELSE a END, 'answer': CASE WHEN p IS NOT NULL AND (a IS NULL OR yes) THEN 'Yes' WHEN a IS NOT NULL THEN 'No' END}},
 {{'shape': 'presence_any', 'slot': '', 'answer': CASE WHEN len(present) > 0 THEN 'Yes' ELSE 'No' END}},
 {{'shape': 'single', 'slot': '', 'answer': CASE WHEN len(present) = 1 THEN present[1] END}},
 {{'shape': 'purpose', 'slot': p, 'answer': CASE p WHEN 'click' THEN 'to choose' WHEN 'error' THEN 'to report' WHEN 'signup' THEN 'to join' END}},
 {{'shape': 'procedure', 'slot': '', 'answer': CASE WHEN told THEN 'a session' END}},
 {{'shape': 'variant', 'slot': CASE WHEN list_contains(present, 'click') THEN CASE WHEN same = (family = 'many') THEN 'many' ELSE 'one' END END, 'answer': CASE WHEN list_contains(present, 'click') THEN CASE WHEN same THEN 'Yes' ELSE 'No' END END}},
 {{'shape': 'first_absent', 'slot': '', 'answer': absent[1]}},
 {{'shape': 'confirm', 'slot': CAST(CASE WHEN right_ THEN part ELSE (part + 1) % 4 END AS VARCHAR), 'answer': CASE WHEN right_ THEN 'Yes' ELSE 'No' END}}]) AS q FROM h)
SELECT q.shape AS shape, coalesce(q.slot, '') AS slot, q.answer AS answer, count(*)::BIGINT AS n FROM r GROUP BY ALL"""


@query(_QA_SLOTS)
def q_qa_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight question shapes with slots filled by hash, in one pass; a shape that doesn't apply to a window is tallied with a null answer."""
    w = V.window_sets(spark, sf_dir).select(F.concat_ws("|", "case_id", "part", "seg_id", "k").alias("key"), "part", "bag", F.col("classes").alias("present"))
    w = w.withColumn("absent", F.array_except(F.array(*map(F.lit, _TOOLS)), "present"))
    draw = lambda what, n: stable_index(F.concat("key", F.lit(f"|{what}")), n)
    picked = lambda c: F.get(c, draw("pick", F.greatest(F.size(c), F.lit(1))).cast("int"))
    even = lambda what: draw(what, 2) == 0
    polar = lambda test: F.when(test, "Yes").otherwise("No")
    w = w.withColumns({"p": picked("present"), "a": picked("absent"), "same": even("variant"), "right": even("confirm")})
    shown = F.col("p").isNotNull() & (F.col("a").isNull() | even("presence"))
    click, many = F.array_contains("present", "click"), F.col("bag") > 1
    slots = {
        "presence_of": (F.when(shown, F.col("p")).otherwise(F.col("a")), F.when(shown, "Yes").when(F.col("a").isNotNull(), "No")),
        "presence_any": (F.lit(""), polar(F.size("present") > 0)),
        "single": (F.lit(""), F.when(F.size("present") == 1, F.get("present", F.lit(0)))),
        "purpose": (F.col("p"), F.coalesce(*(F.when(F.col("p") == c, to) for c, to in _PURPOSES.items()))),
        "procedure": (F.lit(""), F.when(draw("procedure", 25) == 0, "a session")),
        "variant": (F.when(click, F.when(F.col("same") == many, "many").otherwise("one")), F.when(click, polar(F.col("same")))),
        "first_absent": (F.lit(""), F.get("absent", F.lit(0))),
        "confirm": (F.when(F.col("right"), F.col("part")).otherwise((F.col("part") + 1) % 4).cast("string"), polar(F.col("right"))),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("shape"), F.coalesce(slot, F.lit("")).alias("slot"), answer.alias("answer")) for s, (slot, answer) in slots.items()))).alias("q")
    return w.select(rows).groupBy("q.shape", "q.slot", "q.answer").agg(F.count(F.lit(1)).alias("n"))


_TEMPLATES = {"presence": "Was there a {cls}  in part {part}?", "count": "How many events of the kind {cls} had part {part} of {case}?"}


@query("""WITH e AS (SELECT event_id, event_type AS cls, day(ts) // 10 AS part, user_id FROM events) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Was there a ' || cls || ' in part ' || part || '?' ELSE 'How many events of the kind ' || cls || ' had part ' || part || ' of case ' || user_id || '?' END AS question FROM e""")
def q_rendered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two templates over the event log; classes and parts outside their lists would be errors."""
    e = V.ev(spark, sf_dir).select("event_id", "cls", F.col("part").cast("string").alias("part"), F.concat(F.lit("case  "), F.col("case_id").cast("string")).alias("case"))
    allowed = {"cls": VOCABULARY, "part": tuple("0123")}
    first = rendered(_TEMPLATES["presence"], {"cls": F.col("cls"), "part": F.col("part")}, allowed)
    second = rendered(_TEMPLATES["count"], {"cls": F.col("cls"), "part": F.col("part"), "case": F.col("case")}, allowed)
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, first).otherwise(second).alias("question"))


@query(f"""WITH {EV}, r AS (SELECT cls, case_id, count(*) AS n, grouping(cls)::BIGINT AS g_cls, grouping(case_id)::BIGINT AS g_case FROM ev GROUP BY ROLLUP (cls, case_id))
SELECT coalesce(cls, '') AS cls, coalesce(case_id, -1)::BIGINT AS case_id, g_cls, g_case, n::BIGINT AS n, round(n / (SELECT count(*) FROM ev), 6) AS share FROM r""")
def q_balance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.ev(spark, sf_dir)
    grains = e.rollup("cls", "case_id").agg(F.count(F.lit(1)).alias("n"), F.grouping("cls").cast("long").alias("g_cls"), F.grouping("case_id").cast("long").alias("g_case"))
    total = e.agg(F.count(F.lit(1)).alias("total"))
    return grains.crossJoin(F.broadcast(total)).select(F.coalesce("cls", F.lit("")).alias("cls"), F.coalesce("case_id", F.lit(-1)).cast("long").alias("case_id"), "g_cls", "g_case", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row of totals


_MICRO = f"""{EV}, m AS (SELECT case_id, a // {DAY} AS day, abs(value - lag(value) OVER (PARTITION BY case_id, a // {DAY} ORDER BY a, event_id)) AS d FROM ev),
act AS (SELECT case_id, day::BIGINT AS day, avg(d) AS activity, count(d)::BIGINT AS measured FROM m GROUP BY 1, 2)"""


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.ev(spark, sf_dir).withColumn("day", F.expr(f"a div {DAY}"))
    d = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("case_id", "day").orderBy("a", "event_id")))
    return e.withColumn("d", d).groupBy("case_id", "day").agg(F.avg("d").alias("activity"), F.count("d").alias("measured"))


@query(f"WITH {_MICRO} SELECT case_id, day, round(activity, 6) AS activity, measured FROM act")
def q_micro_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activity(spark, sf_dir).withColumn("activity", F.round("activity", 6))


@query(f"""WITH {EV}, r AS (SELECT case_id, a // {DAY} AS day, value, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY case_id, a // {DAY}) AS n FROM ev WINDOW o AS (PARTITION BY case_id, a // {DAY} ORDER BY a, event_id)),
m AS (SELECT case_id, day, value FROM r WHERE i = n // 2) SELECT case_id, day::BIGINT AS day, round(abs(value - lag(value) OVER (PARTITION BY case_id ORDER BY day)), 6) AS step FROM m""")
def q_macro_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.ev(spark, sf_dir).withColumn("day", F.expr(f"a div {DAY}"))
    own = Window.partitionBy("case_id", "day")
    middle = e.withColumn("i", F.row_number().over(own.orderBy("a", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(own)).where("i = n div 2")
    return middle.select("case_id", "day", F.round(F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("case_id").orderBy("day"))), 6).alias("step"))


@query("""SELECT event_id, round(value - lag(value) OVER o, 6) AS from_prev, round(lead(value) OVER o - value, 6) AS to_next FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    near = O.neighbours(e, ["user_id"], ["ts", "event_id"], F.to_date("ts"), ["value"])
    return near.select("event_id", F.round(F.col("value") - F.col("prev_value"), 6).alias("from_prev"), F.round(F.col("next_value") - F.col("value"), 6).alias("to_next"))


@query("""SELECT e.event_id, coalesce(p1.value, p2.value, p3.value) AS probe FROM events e LEFT JOIN events p1 ON p1.event_id = e.event_id + 1 AND p1.event_type = 'view'
LEFT JOIN events p2 ON p2.event_id = e.event_id + 2 AND p2.event_type = 'view' LEFT JOIN events p3 ON p3.event_id = e.event_id + 3 AND p3.event_type = 'view'""")
def q_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of three offsets that has a measurement: one aggregation, not three joins."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    offers = e.where("event_type = 'view'").select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("off"), "event_id", "value").select((F.col("event_id") - F.col("off")).alias("event_id"), F.struct("off", "value").alias("o"))
    rows = e.select("event_id", F.lit(1).alias("own"), F.lit(None).cast("struct<off:int,value:double>").alias("o")).unionByName(offers.select("event_id", F.lit(0).alias("own"), "o"))
    best = rows.groupBy("event_id").agg(F.max("own").alias("own"), F.min("o").alias("o")).where("own = 1")
    return best.select("event_id", F.col("o.value").alias("probe"))


@query(f"WITH {_MICRO} SELECT case_id, round(avg(activity), 6) AS mean, round(max(activity), 6) AS max, round(stddev_pop(activity), 6) AS std, count(activity)::BIGINT AS measured FROM act GROUP BY case_id")
def q_activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("activity")
    return _activity(spark, sf_dir).groupBy("case_id").agg(F.round(F.avg(a), 6).alias("mean"), F.round(F.max(a), 6).alias("max"), F.round(F.stddev_pop(a), 6).alias("std"), F.count(a).alias("measured"))


@query("""SELECT event_type AS cls, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50,
round(quantile_cont(value, 0.9), 4) AS p90, round(stddev_pop(value) / avg(value), 6) AS cv FROM events GROUP BY 1""")
def q_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = F.col("value"), table(spark, sf_dir, "events").select(F.col("event_type").alias("cls"), "value")
    cuts = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    moments = e.groupBy("cls").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.stddev_pop(v) / F.avg(v), 6).alias("cv"))
    found = quantiles(e, ["cls"], "value", cuts)
    return moments.join(found, "cls").select("cls", "mean", "std", "lo", "hi", *(F.round(c, 4).alias(c) for c in cuts), "cv")


@query(f"WITH {_MICRO}, t AS (SELECT round(quantile_cont(activity, 0.1), 6) AS cut FROM act WHERE activity IS NOT NULL) SELECT case_id, day, CAST(activity < cut AS INT) AS still FROM act, t")
def q_static_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tri-state: null where nothing was measured."""
    act = staged(_activity(spark, sf_dir))
    cut = quantiles(act, [], "activity", {"cut": 0.1}).select(F.round("cut", 6).alias("cut"))
    return act.crossJoin(F.broadcast(cut)).select("case_id", "day", (F.col("activity") < F.col("cut")).cast("int").alias("still"))  # one row


@query(f"""WITH {EV}, c AS (SELECT cls, count(*) FILTER (WHERE day(make_timestamp(a)) <= 15) AS base, count(*) FILTER (WHERE day(make_timestamp(a)) > 15) AS extra FROM ev GROUP BY cls)
SELECT cls, base::BIGINT AS base, extra::BIGINT AS extra, round((base + extra) / base, 6) AS multiplier, CAST((base + extra) / base <= 1.5 AS INT) AS protected FROM c""")
def q_yield_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts")
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cls")).agg(F.count_if(day <= 15).alias("base"), F.count_if(day > 15).alias("extra"))
    ratio = (F.col("base") + F.col("extra")) / F.when(F.col("base") != 0, F.col("base"))
    return c.select("cls", "base", "extra", F.round(ratio, 6).alias("multiplier"), (ratio <= 1.5).cast("int").alias("protected"))


@query(f"""WITH {SETS}, f AS (SELECT c AS cls, count(*) AS n FROM (SELECT unnest(classes) AS c FROM wset) GROUP BY 1),
x AS (SELECT case_id, part, seg_id, k, unnest(CASE WHEN len(classes) = 0 THEN [NULL] ELSE classes END) AS cls FROM wset),
r AS (SELECT case_id, part, seg_id, k, coalesce(min(n), 1000000000) AS rarity FROM x LEFT JOIN f USING (cls) GROUP BY 1, 2, 3, 4)
SELECT case_id, part, seg_id, k, rarity::BIGINT AS rarity FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rarity, sha256('s|' || part || '|' || seg_id || '|' || k)) <= 5""")
def q_rarity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rarity_sample(staged(V.window_sets(spark, sf_dir).select("case_id", "part", "seg_id", "k", "classes")), "classes", ["case_id"], draw("s", F.col("part"), F.col("seg_id"), F.col("k")), 5).select("case_id", "part", "seg_id", "k", "rarity")


_SPLIT = f"""{STAB}, hc AS (SELECT case_id, row_number() OVER (ORDER BY sha256('split|' || case_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM ev)),
cs AS (SELECT case_id, CASE WHEN r <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM hc)"""


@query(f"WITH {_SPLIT} SELECT case_id, split FROM cs")
def q_case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.case_split(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id")), "case_id", "split", 0.2)


@query(f"""WITH {_SPLIT}, c AS (SELECT split, cls, count(*) AS n FROM (SELECT DISTINCT case_id, part, seg_id, k, cls FROM stab) JOIN cs USING (case_id) GROUP BY 1, 2),
p AS (SELECT cls, sum(n) AS total, coalesce(sum(n) FILTER (WHERE split = 'val'), 0) AS val FROM c GROUP BY cls)
SELECT round(sum(pow(val / (0.2 * total) - 1, 2)) + 1000 * count(*) FILTER (WHERE val < 5), 6) AS cost, count(*)::BIGINT AS classes FROM p""")
def q_split_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = V.window_sets(spark, sf_dir).select("case_id", F.explode("classes").alias("cls"))
    split = S.case_split(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id")), "case_id", "split", 0.2)
    counts = sets.groupBy("case_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    return S.split_cost(counts, split, "case_id", "cls", "n", 0.2, floor=5)


@query(f"""WITH {STAB}, n AS (SELECT case_id, cls, count(*) AS n FROM (SELECT DISTINCT case_id, part, seg_id, k, cls FROM stab) GROUP BY 1, 2), t AS (SELECT unnest(range(4000)) AS trial),
d AS (SELECT trial, case_id, CAST(('0x' || sha256((trial // 256) || '|' || case_id)[trial % 256 // 4 + 1:trial % 256 // 4 + 1])::INT >> (3 - trial % 4)::INT AS INT) & 1 AS fold FROM (SELECT DISTINCT case_id FROM n), t),
x AS (SELECT trial, cls, n, fold FROM n JOIN d USING (case_id)),
y AS (SELECT trial, cls, coalesce(sum(n) FILTER (WHERE fold = 0), 0) AS a, coalesce(sum(n) FILTER (WHERE fold = 1), 0) AS b FROM x GROUP BY 1, 2),
z AS (SELECT trial, max(abs(ln((a + 1) / (b + 1)))) AS worst, abs(sum(a) - sum(b)) / sum(a + b) AS skew FROM y GROUP BY trial)
SELECT trial::BIGINT AS trial, round(worst + 0.5 * skew, 6) AS objective FROM z ORDER BY round(worst + 0.5 * skew, 9), trial LIMIT 1""")
def q_fold_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.window_sets(spark, sf_dir).select("case_id", F.explode("classes").alias("cls")).groupBy("case_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    return S.fold_trials(counts, "case_id", "cls", "n", 4000).orderBy(F.round("objective", 9), "trial").limit(1).select("trial", F.round("objective", 6).alias("objective"))


@query("""WITH f AS (SELECT user_id, event_type, sum(value) AS secs FROM events GROUP BY 1, 2), t AS (SELECT unnest(range(4000)) AS trial),
d AS (SELECT trial, user_id, ('0x' || sha256('holdout|' || (trial // 16) || '|' || user_id)[trial % 16 * 4 + 1:trial % 16 * 4 + 4])::INT < 13107 AS held FROM (SELECT DISTINCT user_id FROM events), t),
y AS (SELECT trial, event_type, coalesce(sum(secs) FILTER (WHERE held), 0) AS h, sum(secs) AS t FROM f JOIN d USING (user_id) GROUP BY 1, 2),
z AS (SELECT trial, max(abs(h / t - 0.2)) AS objective, count(*) FILTER (WHERE h = 0) AS missing FROM y GROUP BY 1)
SELECT trial::BIGINT AS trial, round(objective, 6) AS objective FROM z WHERE missing = 0 ORDER BY round(objective, 9), trial LIMIT 1""")
def q_duration_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 4,000 holdouts by duration; one that leaves a family out doesn't count."""
    f = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("secs"))
    trials = S.holdout_trials(f, "user_id", "event_type", "secs", 0.2, 4000).where("missing = 0")
    return trials.orderBy(F.round("objective", 9), "trial").limit(1).select("trial", F.round("objective", 6).alias("objective"))


@query(f"""WITH {STAB}, n AS (SELECT case_id, cls, count(*) AS n FROM (SELECT DISTINCT case_id, part, seg_id, k, cls FROM stab) GROUP BY 1, 2), c AS (SELECT DISTINCT case_id FROM n)
SELECT round(count(*) * 0.2)::BIGINT AS val, (count(*) - round(count(*) * 0.2))::BIGINT AS train, true AS optimal, true AS better FROM c""")
def q_split_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched split judged: its sizes, whether no swap of two cases lowers its cost, and whether it costs no more than the hash-drawn split."""
    counts = V.window_sets(spark, sf_dir).select("case_id", F.explode("classes").alias("cls")).groupBy("case_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts)
    split = staged(S.swap_search(counts, "case_id", "cls", "n", 0.2, floor=5))
    drawn = S.case_split(counts, "case_id", "split", 0.2)
    cost = lambda s: S.split_cost(counts, s, "case_id", "cls", "n", 0.2, floor=5).select("cost")
    sizes = split.agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "train").alias("train"))
    swaps = S.improving_swaps(counts, split, "case_id", "cls", "n", 0.2, floor=5).agg((F.count(F.lit(1)) == 0).alias("optimal"))
    both = cost(split).select(F.col("cost").alias("own")).crossJoin(cost(drawn)).select((F.col("own") <= F.col("cost")).alias("better"))  # a row each
    return sizes.crossJoin(swaps).crossJoin(both)  # one row each


@query()
def q_split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a stratified split found by swaps; an iterative search, so tested against brute force."""
    counts = V.window_sets(spark, sf_dir).select("case_id", F.explode("classes").alias("cls")).groupBy("case_id", "cls").agg(F.count(F.lit(1)).alias("n"))
    return S.swap_search(counts, "case_id", "cls", "n", 0.2, floor=5)


@query(f"""WITH {EV}, w AS (SELECT case_id, round(t0 / 1e6, 6) AS t FROM win), e AS (SELECT DISTINCT case_id, round(a / 1e6, 6) AS t, 1 AS hit FROM tool)
SELECT w.case_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE hit IS NULL)::BIGINT AS missing FROM w LEFT JOIN e USING (case_id, t) GROUP BY 1""")
def q_evidence_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join on a rounded time; what finds no evidence is counted, not lost."""
    w = V.win(spark, sf_dir).select("case_id", F.round(F.col("t0") / 1e6, 6).alias("t"))
    e = V.tool(spark, sf_dir).select("case_id", F.round(F.col("a") / 1e6, 6).alias("t")).distinct().withColumn("hit", F.lit(1))
    return w.join(e, ["case_id", "t"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query(f"WITH {EV} SELECT case_id, part, t0 // {HOUR} AS hour, count(*)::BIGINT AS records, count(DISTINCT seg_id)::BIGINT AS segments FROM win GROUP BY 1, 2, 3")
def q_distinct_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.win(spark, sf_dir).groupBy("case_id", "part", F.expr(f"t0 div {HOUR}").alias("hour")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("seg_id").alias("segments"))


@query("SELECT event_id, event_type AS cls FROM events WHERE event_id % 2 <> 0")
def q_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anti-set of a resumed run: what an earlier run (the even ids) did is left out."""
    from ..streaming.incremental import remaining

    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("cls"))
    return remaining(e, e.where("event_id % 2 = 0").select("event_id"), ["event_id"])
