"""Queries over the probability cube: frame reductions, decisions, thresholds, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import AGGREGATORS, bin_centres, ends_kept, mean, noisy_or, quantile, top_mean, trimmed_mean
from ..operators import metrics as M
from ..plans import views as V
from ..plans.views import CUBE
from .registry import query, table

CUTS = (0.5, 0.52, 0.48, 0.55)


def _wide(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """vec_id, label, g, fold, ms: class means of a vector in class order; narrow, no shuffle."""
    xs = lambda c: F.array(*(1 / (1 + F.exp(-4 * F.get("embedding", F.lit(c * 16 + f if second else f * 4 + c)).cast("double"))) for f in range(16)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 20).alias("g"), (F.col("vec_id") % 20 % 2).alias("fold"), F.array(*(mean(xs(c)) for c in range(4))).alias("ms"))


def _argmax(ms: Column) -> Column:
    """Place of the largest (rounded, so both engines agree), the lowest on ties."""
    rounded = F.transform(ms, lambda x: F.round(x, 9))
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("long")


WIDE = CUBE + """, wide AS (SELECT vec_id, label, g, fold, list(round(m, 9) ORDER BY c) AS r, list(m ORDER BY c) AS ms FROM clip GROUP BY ALL),
wide2 AS (SELECT vec_id, label, g, fold, list(round(m, 9) ORDER BY c) AS r, list(m ORDER BY c) AS ms FROM clip2 GROUP BY ALL)"""
ARG = "list_position(r, list_max(r)) - 1"


@query(f"WITH {CUBE} SELECT vec_id, c, round(m, 6) AS mean FROM clip")
def q_frame_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clips(spark, sf_dir).select("vec_id", "c", F.round(mean(F.col("ps")), 6).alias("mean"))


@query(f"""WITH {CUBE}, s AS (SELECT vec_id, c, list_sort(ps) AS u, list_reverse_sort(ps) AS d FROM clip)
SELECT vec_id, c, round(d[1], 6) AS mx, round(list_avg(u[2:15]), 6) AS trim10, round(list_avg(u[4:13]), 6) AS trim20, round(list_avg(d[1:3]), 6) AS top3, round(list_avg(d[1:5]), 6) AS top5,
round(1 - list_product([1 - x FOR x IN d]), 6) AS noisy_or FROM s""")
def q_frame_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("ps")
    return V.clips(spark, sf_dir).select("vec_id", "c", F.round(F.array_max(p), 6).alias("mx"), F.round(trimmed_mean(p, 0.1), 6).alias("trim10"), F.round(trimmed_mean(p, 0.2), 6).alias("trim20"), F.round(top_mean(p, 3), 6).alias("top3"), F.round(top_mean(p, 5), 6).alias("top5"), F.round(noisy_or(p), 6).alias("noisy_or"))


@query(f"WITH {CUBE} SELECT vec_id, c, round(quantile_cont(p, 0.75), 6) AS q75, round(quantile_cont(p, 0.9), 6) AS q90 FROM cube GROUP BY 1, 2")
def q_frame_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.clips(spark, sf_dir).select("vec_id", "c", F.round(quantile(F.col("ps"), 0.75), 6).alias("q75"), F.round(quantile(F.col("ps"), 0.9), 6).alias("q90"))


@query(f"""WITH {CUBE}, e AS (SELECT a.vec_id, a.c, a.f, (a.p + b.p) / 2 AS p FROM cube a JOIN cube2 b USING (vec_id, c, f))
SELECT vec_id, c, round(list_avg(list_reverse_sort(list(p))[1:5]), 6) AS top5 FROM e GROUP BY 1, 2""")
def q_ensemble_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the models in each frame, then over the five best frames."""
    both = V.clips(spark, sf_dir).select("vec_id", "c", "ps").join(V.clips(spark, sf_dir, second=True).select("vec_id", "c", F.col("ps").alias("ps2")), ["vec_id", "c"])
    return both.select("vec_id", "c", F.round(top_mean(F.zip_with("ps", "ps2", lambda a, b: (a + b) / 2), 5), 6).alias("top5"))


@query(f"""WITH {CUBE}, l AS (SELECT vec_id, c, avg(ln(p / (1 - p))) AS x FROM cube GROUP BY 1, 2), s AS (SELECT vec_id, c, exp(x - max(x) OVER o) / sum(exp(x)) OVER o * exp(max(x) OVER o) AS p, x FROM l WINDOW o AS (PARTITION BY vec_id))
SELECT vec_id, (arg_max(c, (round(x, 9), -c)))::BIGINT AS top, round(max(p), 6) AS p_top FROM s GROUP BY vec_id""")
def q_softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = lambda c: mean(F.array(*(4 * F.get("embedding", F.lit(f * 4 + c)).cast("double") for f in range(16))))
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(logits(c) for c in range(4))).alias("xs"))
    top = F.array_max("xs")
    exps = F.transform("xs", lambda x: F.exp(x - top))
    return df.select("vec_id", _argmax(F.col("xs")).alias("top"), F.round(1 / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x), 6).alias("p_top"))


@query(f"WITH {WIDE} SELECT vec_id, array_to_string([i FOR i IN range(4) IF round(ms[i + 1], 6) >= {list(CUTS)}[i + 1]], ',') AS present FROM wide")
def q_threshold_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.array_compact(F.array(*(F.when(F.round(F.get("ms", F.lit(c)), 6) >= cut, F.lit(c)) for c, cut in enumerate(CUTS))))
    return _wide(spark, sf_dir).select("vec_id", F.array_join(F.transform(present, lambda c: c.cast("string")), ",").alias("present"))


@query(f"""WITH {WIDE}, h AS (SELECT vec_id, [i FOR i IN range(4) IF round(ms[i + 1], 6) >= 0.56] AS hard, [i FOR i IN range(4) IF round(ms[i + 1], 6) >= 0.5] AS soft FROM wide)
SELECT vec_id, array_to_string(CASE WHEN len(hard) > 0 THEN hard WHEN len(soft) BETWEEN 1 AND 3 THEN soft ELSE [] END, ',') AS credible FROM h""")
def q_soft_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    at_least = lambda cut: F.array_compact(F.array(*(F.when(F.round(F.get("ms", F.lit(c)), 6) >= cut, F.lit(str(c))) for c in range(4))))
    df = _wide(spark, sf_dir).select("vec_id", at_least(0.56).alias("hard"), at_least(0.5).alias("soft"))
    chosen = F.when(F.size("hard") > 0, F.col("hard")).when(F.size("soft").between(1, 3), F.col("soft")).otherwise(F.array().cast("array<string>"))
    return df.select("vec_id", F.array_join(chosen, ",").alias("credible"))


@query(f"""WITH {CUBE} SELECT vec_id, c, count(*) FILTER (WHERE round(p, 6) >= 0.6)::BIGINT AS n, coalesce(string_agg(CASE WHEN round(p, 6) >= 0.6 THEN f::VARCHAR END, ',' ORDER BY f), '') AS frames, round(max(p), 6) AS max_conf FROM cube GROUP BY 1, 2""")
def q_detection_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.filter(F.transform("ps", lambda p, i: F.struct(i.alias("f"), F.round(p, 6).alias("p"))), lambda x: x["p"] >= 0.6)
    return V.clips(spark, sf_dir).select("vec_id", "c", F.size(hits).cast("long").alias("n"), F.array_join(F.transform(hits, lambda x: x["f"].cast("string")), ",").alias("frames"), F.round(F.array_max("ps"), 6).alias("max_conf"))


@query(f"WITH {CUBE} SELECT vec_id, c, arg_max(f, (round(p, 9), -f))::BIGINT AS frame, round(max(p), 6) AS p FROM cube GROUP BY 1, 2")
def q_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.transform("ps", lambda x: F.round(x, 9))
    return V.clips(spark, sf_dir).select("vec_id", "c", (F.array_position(r, F.array_max(r)) - 1).cast("long").alias("frame"), F.round(F.array_max("ps"), 6).alias("p"))


def _sets(ms: str) -> Column:
    return F.array_compact(F.array(*(F.when(F.round(F.get(ms, F.lit(c)), 6) >= 0.5, F.lit(str(c))) for c in range(4))))


@query(f"""WITH {WIDE}, j AS (SELECT a.vec_id, [i::VARCHAR FOR i IN range(4) IF round(a.ms[i + 1], 6) >= 0.5] AS x, [i::VARCHAR FOR i IN range(4) IF round(b.ms[i + 1], 6) >= 0.5] AS y,
greatest(abs(a.ms[1] - b.ms[1]), abs(a.ms[2] - b.ms[2]), abs(a.ms[3] - b.ms[3]), abs(a.ms[4] - b.ms[4])) AS w FROM wide a JOIN wide2 b USING (vec_id))
SELECT vec_id, array_to_string([i FOR i IN x IF list_contains(y, i)], ',') AS both_present, array_to_string([i FOR i IN x IF NOT list_contains(y, i)], ',') AS only_a, array_to_string([i FOR i IN y IF NOT list_contains(x, i)], ',') AS only_b,
round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE len([i FOR i IN x IF list_contains(y, i)]) / (len(x) + len(y) - len([i FOR i IN x IF list_contains(y, i)])) END, 6) AS agreement, round(w, 6) AS widest FROM j""")
def q_jaccard_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two models' class sets; two empty sets agree fully."""
    j = _wide(spark, sf_dir).select("vec_id", _sets("ms").alias("x"), "ms").join(_wide(spark, sf_dir, second=True).select("vec_id", _sets("ms").alias("y"), F.col("ms").alias("ms2")), "vec_id")
    union = F.size(F.array_union("x", "y"))
    text = lambda a: F.array_join(a, ",")
    widest = F.array_max(F.zip_with("ms", "ms2", lambda a, b: F.abs(a - b)))
    return j.select("vec_id", text(F.array_intersect("x", "y")).alias("both_present"), text(F.array_except("x", "y")).alias("only_a"), text(F.array_except("y", "x")).alias("only_b"), F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / union), 6).alias("agreement"), F.round(widest, 6).alias("widest"))


@query(f"WITH {WIDE}, t AS (SELECT vec_id, ms[1] / (ms[1] + ms[2]) AS p FROM wide) SELECT vec_id, round(p, 6) AS p_first, CASE WHEN round(greatest(p, 1 - p), 6) >= 0.55 THEN CASE WHEN p >= 0.5 THEN 'first' ELSE 'second' END END AS decided FROM t")
def q_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    t = _wide(spark, sf_dir).select("vec_id", (F.get("ms", F.lit(0)) / (F.get("ms", F.lit(0)) + F.get("ms", F.lit(1)))).alias("p"))
    return t.select("vec_id", F.round(p, 6).alias("p_first"), F.when(F.round(F.greatest(p, 1 - p), 6) >= 0.55, F.when(p >= 0.5, "first").otherwise("second")).alias("decided"))


@query(f"""WITH {WIDE}, t AS (SELECT round(greatest(ms[1] / (ms[1] + ms[2]), ms[2] / (ms[1] + ms[2])), 6) AS conf, CAST((ms[1] >= ms[2]) = (label % 2 = 0) AS INT) AS ok FROM wide), g AS (SELECT 50 + unnest(range(21)) AS cut),
s AS (SELECT cut, count(*) AS n, avg(ok) AS acc FROM g JOIN t ON conf >= cut / 100.0 GROUP BY cut)
SELECT coalesce((SELECT min(cut) FROM s WHERE acc > 0.6), (SELECT arg_max(cut, (round(acc, 9), -cut)) FROM s))::BIGINT AS cut, round((SELECT acc FROM s WHERE s.cut = coalesce((SELECT min(cut) FROM s WHERE acc > 0.6), (SELECT arg_max(cut, (round(acc, 9), -cut)) FROM s))), 6) AS accuracy""")
def q_abstain_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First cutoff whose accuracy passes 0.6, else the best; counted per grid cell, not per cutoff and row."""
    a, b = F.get("ms", F.lit(0)), F.get("ms", F.lit(1))
    conf = F.round(F.greatest(a / (a + b), b / (a + b)), 6)
    t = _wide(spark, sf_dir).select(F.least(F.floor(F.round(conf * 100, 4)), F.lit(70)).cast("long").alias("cut"), ((a >= b) == (F.col("label") % 2 == 0)).cast("int").alias("ok"))
    cells = spark.range(50, 71).select(F.col("id").alias("cut")).join(t.groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("ok")), "cut", "left").na.fill(0)
    up = Window.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 21 rows
    swept = cells.select("cut", (F.sum("ok").over(up) / F.nullif(F.sum("n").over(up), F.lit(0))).alias("acc")).where("acc is not null")
    first = F.min(F.when(F.col("acc") > 0.6, F.struct("cut", "acc")))
    best = F.max(F.struct(F.round("acc", 9).alias("r"), (-F.col("cut")).alias("m"), "acc"))
    one = swept.agg(first.alias("f"), best.alias("b"))
    return one.select(F.coalesce("f.cut", -F.col("b.m")).alias("cut"), F.round(F.coalesce("f.acc", "b.acc"), 6).alias("accuracy"))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END"


@query(f"""WITH {CUBE}, k AS (SELECT c, count(*) FILTER (WHERE round(m, 6) >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE round(m, 6) >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE round(m, 6) < 0.5 AND y = 1) AS fn FROM clip GROUP BY c), s AS (SELECT c, {_F1} AS f FROM k)
SELECT c::VARCHAR AS cls, round(f, 6) AS f1 FROM s UNION ALL SELECT 'macro', round(avg(f), 6) FROM s""")
def q_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.confusion(_means(spark, sf_dir), ["c"], F.round("m", 6) >= 0.5, F.col("y")).select("c", M.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f"))
    return scored.select(F.col("c").cast("string").alias("cls"), F.round("f", 6).alias("f1")).unionByName(scored.agg(F.round(F.avg("f"), 6).alias("f1")).select(F.lit("macro").alias("cls"), "f1"))


def _means(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    return V.clips(spark, sf_dir, second).withColumn("m", mean(F.col("ps"))).drop("ps")


@query(f"WITH {WIDE} SELECT g, count(*)::BIGINT AS n, round(avg(CAST({ARG} = label % 4 AS INT)), 6) AS accuracy FROM wide GROUP BY g")
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (_argmax(F.col("ms")) == F.col("label") % 4).cast("int")
    return _wide(spark, sf_dir).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


@query(f"""WITH {CUBE} SELECT c, round(avg(CAST((round(m, 6) >= 0.5) = (y = 1) AS INT)), 6) AS accuracy, round(avg(CAST(round(m, 6) >= 0.5 AS INT)), 6) AS said_yes, round(avg(y), 6) AS true_rate,
round(avg(CAST(round(m, 6) >= 0.5 AND y = 0 AS INT)), 6) AS false_yes, round(avg(CAST(round(m, 6) < 0.5 AND y = 1 AS INT)), 6) AS false_no FROM clip GROUP BY c""")
def q_polar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, y = F.round("m", 6) >= 0.5, F.col("y") == 1
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _means(spark, sf_dir).groupBy("c").agg(rate(said == y).alias("accuracy"), rate(said).alias("said_yes"), rate(y).alias("true_rate"), rate(said & ~y).alias("false_yes"), rate(~said & y).alias("false_no"))


@query(f"""WITH {WIDE}, d(cls, text) AS (VALUES (0, 'even'), (1, 'odd'), (2, 'even'), (3, '')), a AS (SELECT {ARG} AS top, label % 4 AS truth FROM wide)
SELECT count(*)::BIGINT AS n, round(avg(CAST(top = truth AS INT)), 6) AS class_accuracy, round(avg(CAST(top = truth OR (x.text = z.text AND x.text <> '') AS INT)), 6) AS text_accuracy FROM a JOIN d x ON x.cls = top JOIN d z ON z.cls = truth""")
def q_retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.broadcast(spark.createDataFrame([(0, "even"), (1, "odd"), (2, "even"), (3, "")], "cls long, text string"))
    a = _wide(spark, sf_dir).select(_argmax(F.col("ms")).alias("top"), (F.col("label") % 4).cast("long").alias("truth"))
    j = a.join(d.select(F.col("cls").alias("top"), F.col("text").alias("said")), "top").join(d.select(F.col("cls").alias("truth"), F.col("text").alias("meant")), "truth")
    same = F.col("top") == F.col("truth")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("int")), 6).alias("class_accuracy"), F.round(F.avg((same | ((F.col("said") == F.col("meant")) & (F.col("said") != ""))).cast("int")), 6).alias("text_accuracy"))


GRID = """gr AS (SELECT 5 + unnest(range(91)) AS cut),
kk AS (SELECT {keys}, cut, count(*) FILTER (WHERE hit AND y = 1) AS tp, count(*) FILTER (WHERE hit AND y = 0) AS fp, count(*) FILTER (WHERE NOT hit AND y = 1) AS fn, count(*) FILTER (WHERE NOT hit AND y = 0) AS tn
       FROM (SELECT *, round({p}, 6) >= round(cut / 100.0, 6) AS hit FROM {src}, gr) GROUP BY ALL)"""


@query(f"WITH {CUBE}, {GRID.format(keys='c', p='m', src='clip')}, s AS (SELECT *, {_F1} AS f FROM kk) SELECT c, arg_max(cut, (round(f, 12), -cut))::BIGINT AS cut, round(max(f), 6) AS best FROM s GROUP BY c")
def q_tune_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tune_f1(_means(spark, sf_dir), ["c"], "m", "y").select("c", F.col("cut").cast("long").alias("cut"), F.round("best", 6).alias("best"))


@query(f"WITH {CUBE}, {GRID.format(keys='c', p='m', src='clip')}, s AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS f FROM kk) SELECT c, arg_max(cut, (round(f, 12), -cut))::BIGINT AS cut, round(max(f), 6) AS best FROM s GROUP BY c")
def q_tune_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tune_accuracy(_means(spark, sf_dir), ["c"], "m", "y").select("c", F.col("cut").cast("long").alias("cut"), F.round("best", 6).alias("best"))


def _fold_sql(keys: str, src: str, p: str) -> str:
    own = f"{keys}, c, fold" if keys else "c, fold"
    by = f"{keys}, " if keys else ""
    return f"""{GRID.format(keys=own, p=p, src=src)}, s AS (SELECT *, {_F1} AS f1 FROM kk),
b AS (SELECT {own}, arg_max(cut, (round(f1, 12), -cut)) AS cut FROM s GROUP BY ALL),
o AS (SELECT {''.join(f's.{k.strip()}, ' for k in keys.split(',') if k.strip())}s.c, s.f1 AS score, s.tp + s.fn AS seen FROM s JOIN b ON {''.join(f's.{k.strip()} = b.{k.strip()} AND ' for k in keys.split(',') if k.strip())}s.c = b.c AND s.fold = 1 - b.fold AND s.cut = b.cut),
pc AS (SELECT {by}c, avg(score) AS score FROM o GROUP BY ALL HAVING min(seen) > 0 AND count(*) = 2)"""


@query(f"WITH {CUBE}, {_fold_sql('', 'clip', 'm')} SELECT round(avg(score), 6) AS honest, count(*)::BIGINT AS n_classes FROM pc")
def q_two_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.two_fold(_means(spark, sf_dir), [], "c", "m", "y", "fold").select(F.round("honest", 6).alias("honest"), "n_classes")


_CENTRES8 = [int((i + 0.5) * 16 / 8) for i in range(8)]
_SQL_AGGS = {
    "mean": "list_avg(ps)", "max": "list_max(ps)", "q75": "quantile_cont", "q90": "quantile_cont",
    "trim10": "list_avg(list_sort(ps)[1 + floor(len(ps) * 0.1)::INT:len(ps) - floor(len(ps) * 0.1)::INT])",
    "trim20": "list_avg(list_sort(ps)[1 + floor(len(ps) * 0.2)::INT:len(ps) - floor(len(ps) * 0.2)::INT])",
    "top3": "list_avg(list_reverse_sort(ps)[1:3])", "top5": "list_avg(list_reverse_sort(ps)[1:5])", "noisy_or": "1 - list_product([1 - x FOR x IN ps])",
}
_Q = "(list_sort(ps)[floor({q} * (len(ps) - 1))::INT + 1] + (list_sort(ps)[ceil({q} * (len(ps) - 1))::INT + 1] - list_sort(ps)[floor({q} * (len(ps) - 1))::INT + 1]) * ({q} * (len(ps) - 1) - floor({q} * (len(ps) - 1))))"
_SQL_AGGS |= {"q75": _Q.format(q=0.75), "q90": _Q.format(q=0.9)}
_ARMS = " UNION ALL ".join(f"SELECT '{k}' AS agg, n_frames, c, fold, y, {e} AS v FROM fr" for k, e in _SQL_AGGS.items())


@query(f"""WITH {CUBE}, fr AS (SELECT 16 AS n_frames, c, fold, y, ps FROM clip UNION ALL SELECT 8, c, fold, y, [ps[i + 1] FOR i IN {_CENTRES8}] FROM clip), arms AS ({_ARMS}),
{_fold_sql('agg, n_frames', 'arms', 'v')}, r AS (SELECT agg, n_frames, avg(score) AS h FROM pc GROUP BY ALL)
SELECT agg, n_frames::BIGINT AS n_frames, round(h, 6) AS honest, round(h - (SELECT h FROM r WHERE agg = 'mean' AND n_frames = 16), 6) AS delta FROM r""")
def q_agg_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aggregator on 16 and on 8 frames, scored across folds; one pass over the clips."""
    eight = F.transform(bin_centres(F.size("ps"), F.lit(8)), lambda i: F.get("ps", i))
    frames = V.clips(spark, sf_dir).select("c", "fold", "y", F.explode(F.array(F.struct(F.lit(16).cast("long").alias("n"), F.col("ps")), F.struct(F.lit(8).cast("long").alias("n"), eight.alias("ps")))).alias("x"))
    arms = frames.select("c", "fold", "y", F.col("x.n").alias("n_frames"), F.explode(F.array(*(F.struct(F.lit(k).alias("agg"), f(F.col("x.ps")).alias("v")) for k, f in AGGREGATORS.items()))).alias("a"))
    scored = M.two_fold(arms.select("c", "fold", "y", "n_frames", "a.agg", "a.v"), ["agg", "n_frames"], "c", "v", "y", "fold")
    base = F.max(F.when((F.col("agg") == "mean") & (F.col("n_frames") == 16), F.col("honest"))).over(Window.partitionBy(F.lit(1)))  # 18 rows
    return scored.withColumn("delta", F.round(F.col("honest") - base, 6)).select("agg", "n_frames", F.round("honest", 6).alias("honest"), "delta")


@query(f"""WITH {CUBE}, w AS (SELECT unnest(range(21)) AS w), bl AS (SELECT w, a.c, a.fold, a.y, (1 - w / 20.0) * a.m + w / 20.0 * b.m AS v FROM clip a JOIN clip2 b USING (vec_id, c), w),
{_fold_sql('w', 'bl', 'v')} SELECT w::BIGINT AS w, round(avg(score), 6) AS honest FROM pc GROUP BY w""")
def q_fusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _means(spark, sf_dir).join(_means(spark, sf_dir, second=True).select("vec_id", "c", F.col("m").alias("m2")), ["vec_id", "c"])
    arms = both.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long")))).withColumn("v", (1 - F.col("w") / 20.0) * F.col("m") + F.col("w") / 20.0 * F.col("m2"))
    return M.two_fold(arms, ["w"], "c", "v", "y", "fold").select("w", F.round("honest", 6).alias("honest"))


_PAIR = f"""{WIDE}, pr AS (SELECT a.label, CASE WHEN a.label % 4 = 0 THEN a.ms[1] WHEN a.label % 4 = 1 THEN a.ms[2] WHEN a.label % 4 = 2 THEN a.ms[3] ELSE a.ms[4] END AS x,
CASE WHEN a.label % 4 = 0 THEN b.ms[1] WHEN a.label % 4 = 1 THEN b.ms[2] WHEN a.label % 4 = 2 THEN b.ms[3] ELSE b.ms[4] END AS z FROM wide a JOIN wide2 b USING (vec_id)),
st AS (SELECT label, count(*) AS n, avg(z - x) AS delta, CASE WHEN count(*) > 1 THEN sqrt(var_samp(z - x) / count(*)) END AS se, avg(x) AS ma, avg(z) AS mb FROM pr GROUP BY label)"""


@query(f"""WITH {_PAIR} SELECT label::BIGINT AS label, n::BIGINT AS n, round(delta, 6) AS delta, round(se, 6) AS se, coalesce(CAST(delta > 2 * se AS INT), 0) AS armed FROM st
UNION ALL SELECT -1, sum(n)::BIGINT, round(sum(n * CASE WHEN delta > 2 * se THEN mb ELSE ma END) / sum(n), 6), round(sum(n * greatest(ma, mb)) / sum(n), 6), sum(CASE WHEN delta > 2 * se THEN 1 ELSE 0 END)::INT FROM st""")
def q_paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the paired difference of two models; the row of label -1 rolls up the armed policy and the best of both."""
    own = lambda ms: F.get(ms, F.col("label") % 4)
    j = _wide(spark, sf_dir).join(_wide(spark, sf_dir, second=True).select("vec_id", F.col("ms").alias("ms2")), "vec_id").select(F.col("label").cast("long").alias("label"), own("ms").alias("x"), own("ms2").alias("z"))
    st = M.paired(j, ["label"], "x", "z", 2)
    policy = F.when(F.col("armed") == 1, F.col("mean_b")).otherwise(F.col("mean_a"))
    total = st.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * policy) / F.sum("n"), 6).alias("delta"), F.round(F.sum(F.col("n") * F.greatest("mean_a", "mean_b")) / F.sum("n"), 6).alias("se"), F.sum("armed").cast("int").alias("armed"))
    return st.select("label", "n", F.round("delta", 6).alias("delta"), F.round("se", 6).alias("se"), "armed").unionByName(total.select(F.lit(-1).cast("long").alias("label"), "n", "delta", "se", "armed"))


@query(f"WITH {WIDE} SELECT (label % 4)::BIGINT AS truth, count(*) FILTER (WHERE {ARG} = 0)::BIGINT AS said_0, count(*) FILTER (WHERE {ARG} = 1)::BIGINT AS said_1, count(*) FILTER (WHERE {ARG} = 2)::BIGINT AS said_2, count(*) FILTER (WHERE {ARG} = 3)::BIGINT AS said_3 FROM wide GROUP BY 1")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wide(spark, sf_dir).select((F.col("label") % 4).cast("long").alias("truth"), F.concat(F.lit("said_"), _argmax(F.col("ms"))).alias("said"))
    return df.groupBy("truth").pivot("said", [f"said_{c}" for c in range(4)]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""WITH {WIDE}, t AS (SELECT label % 4 AS y, {ARG} AS top, list_reverse_sort(r) AS d, r FROM wide), u AS (SELECT y, top, list_position(r, d[2]) - 1 AS second, round(d[1] - d[2], 6) AS margin FROM t)
SELECT CASE WHEN margin < 0.02 THEN 'a' WHEN margin < 0.05 THEN 'b' WHEN margin < 0.1 THEN 'c' ELSE 'd' END AS band, count(*)::BIGINT AS n, round(avg(CAST(top = y AS INT)), 6) AS top1, round(avg(CAST(top = y OR second = y AS INT)), 6) AS top2 FROM u GROUP BY 1""")
def q_margin_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.transform("ms", lambda x: F.round(x, 9))
    t = _wide(spark, sf_dir).select((F.col("label") % 4).alias("y"), _argmax(F.col("ms")).alias("top"), r.alias("r"), F.sort_array(r, asc=False).alias("d"))
    u = t.select("y", "top", (F.array_position("r", F.get("d", F.lit(1))) - 1).alias("second"), F.round(F.get("d", F.lit(0)) - F.get("d", F.lit(1)), 6).alias("margin"))
    band = F.when(F.col("margin") < 0.02, "a").when(F.col("margin") < 0.05, "b").when(F.col("margin") < 0.1, "c").otherwise("d")
    hit1, hit2 = F.col("top") == F.col("y"), F.col("second") == F.col("y")
    return u.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit1.cast("int")), 6).alias("top1"), F.round(F.avg((hit1 | hit2).cast("int")), 6).alias("top2"))


_PAYOFF = [(1, 0, 0.2), (1, 1, 1.0), (2, 0, 0.1), (2, 1, 0.7), (3, 0, 0.05), (3, 1, 0.5)]


@query(f"""WITH {WIDE}, t AS (SELECT label % 4 AS y, r, list_reverse_sort(r) AS d FROM wide), k AS (SELECT unnest(range(1, 4)) AS k),
o AS (SELECT k, CAST(r[y + 1] >= d[k] AS INT) AS hit FROM t, k) SELECT o.k::BIGINT AS k, count(*)::BIGINT AS n, round(avg(p.v), 6) AS value FROM o JOIN (VALUES {', '.join(map(str, _PAYOFF))}) p(k, hit, v) ON p.k = o.k AND p.hit = o.hit GROUP BY o.k""")
def q_policy_payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected payoff of naming the k best classes."""
    r = F.transform("ms", lambda x: F.round(x, 9))
    t = _wide(spark, sf_dir).select((F.col("label") % 4).alias("y"), r.alias("r"), F.sort_array(r, asc=False).alias("d"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("k"))
    o = t.select("k", (F.get("r", F.col("y")) >= F.get("d", (F.col("k") - 1).cast("int"))).cast("long").alias("hit"))
    return o.join(F.broadcast(spark.createDataFrame(_PAYOFF, "k long, hit long, v double")), ["k", "hit"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("value"))


@query(f"WITH {CUBE} SELECT c, sum(y)::BIGINT AS pos, round(least(greatest((count(*) - sum(y)) / sum(y), 1), 10), 6) AS weight FROM clip GROUP BY c")
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, n = F.sum("y"), F.count(F.lit(1))
    weight = F.least(F.greatest((n - pos) / F.nullif(pos, F.lit(0)), F.lit(1.0)), F.lit(10.0))
    return V.clips(spark, sf_dir).groupBy("c").agg(pos.alias("pos"), F.round(weight, 6).alias("weight"))


@query("SELECT i::BIGINT AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-6, 6) AS std FROM (SELECT i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)) GROUP BY i")
def q_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")) + 1e-6, 6).alias("std"))


@query(f"""WITH {WIDE}, a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, ms FROM wide), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, ms FROM wide2)
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE a.vec_id <> b.vec_id)::BIGINT AS mismatched, round(avg(a.ms[1] * b.ms[1]), 6) AS product FROM a JOIN b USING (i)""")
def q_aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows aligned by an explicit ordinal, their keys compared; the ordinal is counted per range of ids."""
    from ..operators.audit import ordinal

    a, b = ordinal(_wide(spark, sf_dir), "vec_id"), ordinal(_wide(spark, sf_dir, second=True), "vec_id")
    j = a.select("i", "vec_id", "ms").join(b.select("i", F.col("vec_id").alias("other"), F.col("ms").alias("ms2")), "i")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") != F.col("other")).alias("mismatched"), F.round(F.avg(F.get("ms", F.lit(0)) * F.get("ms2", F.lit(0))), 6).alias("product"))


@query(f"""WITH {WIDE}, j AS (SELECT a.ms AS x, b.ms AS z, list_position(a.r, list_max(a.r)) = list_position(b.r, list_max(b.r)) AS agree FROM wide a JOIN wide2 b USING (vec_id)),
d AS (SELECT agree, unnest([abs(x[i] - z[i]) FOR i IN range(1, 5)]) AS d FROM j) SELECT round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, round(avg(CAST(agree AS INT)), 6) AS argmax_agreement FROM d""")
def q_max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _wide(spark, sf_dir).join(_wide(spark, sf_dir, second=True).select("vec_id", F.col("ms").alias("ms2")), "vec_id")
    d = j.select((_argmax(F.col("ms")) == _argmax(F.col("ms2"))).cast("int").alias("agree"), F.explode(F.zip_with("ms", "ms2", lambda a, b: F.abs(a - b))).alias("d"))
    return d.agg(F.round(F.max("d"), 6).alias("max_diff"), F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.avg("agree"), 6).alias("argmax_agreement"))


@query(f"""WITH {WIDE}, x AS (SELECT vec_id, {ARG} AS top, r, unnest(range(4)) AS flip FROM wide), y AS (SELECT flip, top, [CASE WHEN i = flip THEN round(1 - r[i + 1], 9) ELSE r[i + 1] END FOR i IN range(4)] AS r FROM x)
SELECT flip::BIGINT AS flip, count(*)::BIGINT AS n, count(*) FILTER (WHERE {ARG} <> top)::BIGINT AS changed FROM y GROUP BY flip""")
def q_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the decision changes when one class's score is turned round."""
    r = F.transform("ms", lambda x: F.round(x, 9))
    x = _wide(spark, sf_dir).select(r.alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("flip"))
    flipped = F.transform("r", lambda v, i: F.when(i == F.col("flip"), F.round(1 - v, 9)).otherwise(v))
    return x.groupBy("flip").agg(F.count(F.lit(1)).alias("n"), F.count_if(_argmax(F.col("r")) != _argmax(flipped)).alias("changed"))


@query(f"""WITH {WIDE} SELECT vec_id, concat_ws(chr(10), 'top: ' || ({ARG})::VARCHAR, CASE WHEN round(list_max(ms), 6) >= 0.55 THEN 'sure' END, CASE WHEN label % 2 = 0 THEN 'group: even' END) AS prompt FROM wide""")
def q_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [F.concat(F.lit("top: "), _argmax(F.col("ms")).cast("string")), F.when(F.round(F.array_max("ms"), 6) >= 0.55, "sure"), F.when(F.col("label") % 2 == 0, "group: even")]
    return _wide(spark, sf_dir).select("vec_id", F.concat_ws("\n", *lines).alias("prompt"))


@query("SELECT vec_id, round(sum(CASE WHEN i < 8 THEN -100 ELSE CAST(embedding[i + 1] AS DOUBLE) END), 6) AS total FROM embeddings, range(64) r(i) GROUP BY vec_id")
def q_mask_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = F.transform("embedding", lambda x, i: F.when(i < 8, F.lit(-100.0)).otherwise(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(masked, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_KEPT = ends_kept(64, 5)


@query(f"SELECT vec_id, array_to_string([round(CAST(embedding[i + 1] AS DOUBLE) * 1000000)::BIGINT FOR i IN {_KEPT}], ',') AS kept FROM embeddings")
def q_subsample_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.array(*(F.round(F.get("embedding", F.lit(i)).cast("double") * 1_000_000).cast("long").cast("string") for i in _KEPT))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(picked, ",").alias("kept"))
