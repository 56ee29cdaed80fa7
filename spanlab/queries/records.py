"""Queries over records: class names, file names, evidence against answers, payoffs, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as X
from ..functions.arrays import english_list
from ..functions.hashing import stable_index
from ..functions.text import words_only
from ..operators import intervals as I
from ..operators import sampling as S
from ..operators.answers import evidence_verdict
from ..operators.rules import TOOLS
from ..plans import views as V
from ..sources.files import last_timings
from ..sources.intervals_csv import part_label
from .registry import query, table


def _values(rows: list[tuple]) -> str:
    """Rows as the VALUES of SQL."""
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_CLASSES = [(i, t, X.DISPLAY.get(t), X.PURPOSE[t]) for i, t in enumerate(TOOLS)]
_TASKS = [(i, t, X.TASK_ORGAN.get(t), name) for i, (t, name) in enumerate(X.TASK_NAME.items())]


@query(f"""WITH c(i, cls, display, purpose) AS ({_values(_CLASSES)}), t(i, task, organ, name) AS ({_values(_TASKS)})
SELECT event_id, cls, coalesce(display, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(cls, ' ')], ' ')) AS display, CASE WHEN event_id % 3 = 0 THEN 'To grasp and hold tissues or objects during the surgery.' ELSE purpose END AS purpose, organ, name FROM events JOIN c ON c.i = event_id % 12 JOIN t ON t.i = event_id % 8""")
def q_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda rows, n: F.get(F.array(*(F.lit(r[1]) for r in rows)), (F.col("event_id") % n).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", at(_CLASSES, 12).alias("cls"), at(_TASKS, 8).alias("task"))
    asked = F.when(F.col("event_id") % 3 == 0, "forceps").otherwise("thing")
    return e.select("event_id", "cls", X.class_display(F.col("cls")).alias("display"), X.purpose(asked, F.col("cls")).alias("purpose"), X.entry_of(F.col("task"), X.TASK_ORGAN).alias("organ"), X.entry_of(F.col("task"), X.TASK_NAME).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN printf('case_%03d', user_id) END AS video_case, CASE WHEN event_id % 5 <> 0 THEN (event_id % 4)::VARCHAR END AS video_part, printf('case_%03d', user_id) AS shard,
printf('case_%03d', user_id) AS harvested, 'case_' || (900 + event_id % 100) AS numbered FROM events""")
def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of file names, written and read back."""
    case, part = F.format_string("case_%03d", "user_id"), F.col("event_id") % 4
    video = F.when(F.col("event_id") % 5 == 0, F.concat(case, F.lit("_video.mp4"))).otherwise(F.concat(case, F.format_string("_video_part_%03d.mp4", part)))
    e = table(spark, sf_dir, "events").select(
        "event_id",
        X.video_name(video).alias("v"),
        X.shard_case(F.concat(F.lit("x_part0/"), case, F.format_string("_part%d.npz", part))).alias("shard"),
        X.harvested_case(F.format_string("a/pseudo_case_%d_part%d_w%04d_f%02d.jpg", "user_id", part, "event_id", part)).alias("harvested"),
        X.numbered_case(F.format_string("VID%02d", F.col("event_id") % 100), 900).alias("numbered"),
    )
    return e.select("event_id", F.col("v.case").alias("video_case"), F.col("v.part").alias("video_part"), "shard", "harvested", "numbered")


MARKERS = {"steel": "mega", "brass": "large", "copper": "large"}
@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_name), 'steel') THEN 'mega' WHEN regexp_matches(lower(p_type || ' ' || p_name), 'brass|copper') THEN 'large' END AS family FROM part""")
def q_family_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.family_of(F.concat_ws(" ", "p_type", "p_name"), MARKERS).alias("family"))


@query(r"""WITH q AS (SELECT p_partkey, 'Is the ' || CASE p_size % 4 WHEN 0 THEN 'mega' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'enlarged' ELSE '' END || ' ' || p_name || CASE WHEN p_size > 40 THEN ' or mega' ELSE '' END || ' used?' AS question FROM part),
h AS (SELECT p_partkey, regexp_matches(lower(question), '(^|[^a-z0-9])large([^a-z0-9]|$)') AS l, regexp_matches(lower(question), '(^|[^a-z0-9])mega([^a-z0-9]|$)') AS m FROM q)
SELECT p_partkey, CASE WHEN l AND NOT m THEN 'large' WHEN m AND NOT l THEN 'mega' END AS family FROM h""")
def q_family_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one family a question names; part names bring words of their own."""
    k = F.col("p_size") % 4
    word = F.when(k == 0, "mega").when(k == 1, "LARGE").when(k == 2, "enlarged").otherwise("")
    question = F.concat(F.lit("Is the "), word, F.lit(" "), "p_name", F.when(F.col("p_size") > 40, " or mega").otherwise(""), F.lit(" used?"))
    return table(spark, sf_dir, "part").select("p_partkey", X.family_asked(F.split(words_only(question), " "), {"large": "large", "mega": "mega"}).alias("family"))


_PROBES = ("Is a MEGA needle driver used?", "Was the large one taken?", "Is a click driver used?", "Do we see an error here?", "Are there sign-ups?", "Is it the driver?")
_PROBE_SQL = "[" + ", ".join("'" + q + "'" for q in _PROBES) + "]"
_HASH = "CAST(('0x' || sha256(key || '|{0}')[1:16])::UHUGEINT % {1} AS INT)"


@query(f"""WITH {V.STAB}, d AS (SELECT w.case_id, w.part, w.seg_id, w.k, coalesce(list(DISTINCT s.cls) FILTER (WHERE s.cls IS NOT NULL), []) AS classes FROM win w LEFT JOIN stab s USING (case_id, part, seg_id, k) GROUP BY ALL),
x AS (SELECT *, case_id || '|' || part || '|' || seg_id || '|' || k AS key FROM d),
r AS (SELECT CASE WHEN {_HASH.format("lens", 3)} = 0 THEN 'other' WHEN {_HASH.format("lens", 3)} = 1 THEN 'variant_presence_polar' ELSE 'tool_presence_polar' END AS intent, {_HASH.format("q", len(_PROBES))} AS q,
 CASE WHEN {_HASH.format("a", 5)} < 2 THEN 'yes' WHEN {_HASH.format("a", 5)} < 4 THEN 'no' END AS polar, CASE WHEN k % 7 <> 0 THEN classes END AS tools, [NULL, 'mega', 'large'][seg_id % 3 + 1] AS family, seg_id % 2 = 0 AS decided FROM x),
v AS (SELECT *, CASE WHEN q = 0 THEN 'mega' WHEN q = 1 THEN 'large' END AS asked, CASE WHEN q = 2 THEN 'click' WHEN q = 3 THEN 'error' END AS name FROM r),
e AS (SELECT *, CASE intent WHEN 'variant_presence_polar' THEN CASE WHEN decided AND family IS NOT NULL AND asked IS NOT NULL THEN family = asked END WHEN 'tool_presence_polar' THEN CASE WHEN name IS NOT NULL AND tools IS NOT NULL THEN list_contains(tools, name) END END AS says FROM v)
SELECT intent, CASE WHEN says IS NULL OR polar IS NULL THEN 'undecidable' WHEN says = (polar = 'yes') THEN 'agrees' ELSE 'contradicts' END AS verdict, count(*)::BIGINT AS n FROM e GROUP BY 1, 2""")
def q_evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about windows of the event log against what the windows show, by two lenses; other intents decide nothing."""
    w = V.window_sets(spark, sf_dir).select("part", "seg_id", "k", "classes", F.concat_ws("|", "case_id", "part", "seg_id", "k").alias("key"))
    draw = lambda what, n: stable_index(F.concat("key", F.lit(f"|{what}")), n)
    w = w.withColumns({"lens": draw("lens", 3), "said": draw("a", 5)})
    lens, said = F.col("lens"), F.col("said")
    intent = F.when(lens == 0, "other").when(lens == 1, "variant_presence_polar").otherwise("tool_presence_polar")
    answer = F.when(said < 2, "Yes.").when(said < 4, " no").otherwise("Perhaps")
    question = F.get(F.array(*map(F.lit, _PROBES)), draw("q", len(_PROBES)).cast("int"))
    family = F.get(F.array(F.lit(None), F.lit("Mega"), F.lit("large")), (F.col("seg_id") % 3).cast("int"))
    r = w.select(intent.alias("intent"), question.alias("question"), answer.alias("answer"), F.when(F.col("k") % 7 != 0, F.col("classes")).alias("tools"), family.alias("family"), (F.col("seg_id") % 2 == 0).alias("decided"))
    verdict = evidence_verdict(F.col("intent"), F.col("question"), F.col("answer"), F.col("tools"), F.col("family"), F.col("decided"), ("click", "error", "signup"))
    return r.groupBy("intent", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS names FROM events GROUP BY 1), t AS (SELECT user_id, names[1:3] AS n FROM s)
SELECT user_id, CASE WHEN len(n) = 1 THEN n[1] ELSE array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] END AS listed FROM t""")
def q_top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return names.select("user_id", english_list(F.slice("names", 1, 3)).alias("listed"))


@query("""WITH l AS (SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click'), m AS (SELECT max_by(user_id, event_id) AS u, max(event_id) AS e FROM l)
SELECT 'decode' AS stage, u + 0.5::DOUBLE AS seconds FROM m UNION ALL SELECT 'answer', (e % 60)::DOUBLE FROM m""")
def q_last_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage seconds of the last timing line of a log."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "click", F.format_string("timings decode=%d.5 answer=%d", "user_id", F.col("event_id") % 60)).otherwise(F.concat(F.lit("note "), "event_type"))
    return last_timings(e.select("event_id", line.alias("line")), "event_id", "line").select(F.explode("stages").alias("stage", "seconds"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'intro' ELSE (event_id % 7) || '.0' END AS part FROM events")
def q_part_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 7).cast("string")
    k = F.col("event_id") % 4
    written = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".00"))).when(k == 2, F.concat(F.lit(" "), n, F.lit(". "))).otherwise(" intro ")
    return table(spark, sf_dir, "events").select("event_id", part_label(written).alias("part"))


DEFAULTS = {"mode": "fallback", "weight": "0.5"}


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'fallback' END AS mode, CASE WHEN s_suppkey % 5 = 1 THEN s_nationkey::VARCHAR ELSE '0.5' END AS weight, CASE WHEN s_suppkey % 5 = 1 THEN s_acctbal::INT::VARCHAR END AS extra FROM supplier""")
def q_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under each row's own settings: some override, some add, some are broken, no object, or absent; halves go to the even number."""
    k = F.col("s_suppkey") % 5
    over = F.concat(F.lit('{"mode": "'), "s_name", F.lit('", "weight": null}'))
    more = F.concat(F.lit('{"weight": '), F.col("s_nationkey").cast("string"), F.lit(', "extra": "'), F.rint("s_acctbal").cast("int").cast("string"), F.lit('"}'))
    text = F.when(k == 0, over).when(k == 1, more).when(k == 2, F.concat(F.lit("{"), "s_name")).when(k == 3, F.concat(F.lit('["'), "s_name", F.lit('"]')))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", X.settings(text, DEFAULTS).alias("s"))
    return s.select("s_suppkey", *(F.try_element_at("s", F.lit(c)).alias(c) for c in ("mode", "weight", "extra")))


@query(f"""WITH ev AS (SELECT user_id AS case_id, event_id, event_type AS cls, value, epoch_us(ts) AS a, (epoch_us(ts) + round(value * 100)::BIGINT * {V.HALF_HOUR_CENT})::BIGINT AS b FROM events),
log AS (SELECT case_id, cls AS mounted, a AS lo, b AS hi FROM ev WHERE event_id % 3 = 0 AND b > a AND case_id % 5 <> 0),
d AS (SELECT *, case_id IN (SELECT case_id FROM log) AS known, EXISTS (SELECT 1 FROM log WHERE log.case_id = ev.case_id AND mounted = cls AND a BETWEEN lo AND hi) AS there FROM ev WHERE event_id % 3 <> 0)
SELECT CASE WHEN value < 5 THEN 'low_confidence' WHEN NOT known THEN 'unresolved_window' WHEN NOT there THEN 'unmounted' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM d GROUP BY 1""")
def q_detection_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections against the log of what was mounted: one reason each; only those that pass the first test are looked up."""
    e = V.ev(spark, sf_dir).select("case_id", "event_id", "cls", "value", "a", "b")
    log = e.where("event_id % 3 = 0 and b > a and case_id % 5 <> 0").select("case_id", "cls", F.col("a").alias("lo"), F.col("b").alias("hi"))
    d = e.where("event_id % 3 <> 0").drop("b")
    there = I.range_join(d.where("value >= 5"), log, ["case_id", "cls"], "a", "lo", "hi").select("event_id", F.lit(True).alias("there")).distinct()
    known = log.select("case_id", F.lit(True).alias("known")).distinct()
    j = d.join(known, "case_id", "left").join(there, "event_id", "left")
    return S.drop_reasons(j, [("low_confidence", F.col("value") < 5), ("unresolved_window", F.col("known").isNull()), ("unmounted", F.col("there").isNull())])


@query("""WITH k AS (SELECT l_orderkey, count(*) AS m, count(*) FILTER (WHERE l_returnflag = 'N') AS k FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, m, k, least(m - k, 2) AS e, 2 * k / (m + 3) AS score FROM k WHERE m <= 4),
p AS (SELECT m, k, e, avg(score) AS mean FROM o WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT o.m::BIGINT AS m, count(*)::BIGINT AS n, count(p.mean)::BIGINT AS known, round(avg(p.mean), 6) AS value FROM o LEFT JOIN p ON p.m = o.m AND p.k = o.k AND p.e = o.e WHERE l_orderkey % 2 = 1 GROUP BY 1""")
def q_payoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by (named m, right k, extra e at most two), learnt on even orders, and what naming m is worth by it on odd ones."""
    right = F.count_if(F.col("l_returnflag") == "N")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m"), right.alias("k")).where("m <= 4")
    o = o.withColumn("e", F.least(F.col("m") - F.col("k"), F.lit(2).cast("long"))).withColumn("score", 2 * F.col("k") / (F.col("m") + 3))
    payoff = o.where("l_orderkey % 2 = 0").groupBy("m", "k", "e").agg(F.avg("score").alias("mean"))
    said = o.where("l_orderkey % 2 = 1").join(payoff, ["m", "k", "e"], "left")
    return said.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.count("mean").alias("known"), F.round(F.avg("mean"), 6).alias("value"))
