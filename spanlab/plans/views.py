"""Views over the driver's tables: event intervals, one-hour windows, the probability cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import tumbling
from ..operators.intervals import window_sets as sets_of

HOUR = 3_600_000_000
DAY = 24 * HOUR
HALF_HOUR_CENT = 18_000_000  # microseconds in a hundredth of half an hour
SEGMENT_CLASSES = ("view", "purchase")
VOCABULARY = ("click", "error", "purchase", "signup", "view")
FRAMES, CLASSES = 16, 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """Microseconds since the epoch of a time without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * {DAY}L + unix_micros(cast({ts} as timestamp)) - unix_micros(date_trunc('DAY', cast({ts} as timestamp)))")


def part_of(t: str) -> F.Column:
    """Tens of the day of the month of a time in microseconds."""
    return F.expr(f"cast(floor(dayofmonth(date_from_unix_date(cast(floor({t} / {DAY}) as int))) / 10) as long)")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, event_id, cls, value, a, b (microseconds), part, part_b."""
    df = _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", F.col("event_type").alias("cls"), "value", micros("ts").alias("a"))
    df = df.withColumn("b", (F.col("a") + F.round(F.col("value") * 100).cast("long") * HALF_HOUR_CENT).cast("long"))
    return df.withColumn("part", part_of("a")).withColumn("part_b", part_of("b"))


def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).where("part = part_b and b > a")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv(spark, sf_dir).where(F.col("cls").isin(*SEGMENT_CLASSES))


def tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv(spark, sf_dir).where(~F.col("cls").isin(*SEGMENT_CLASSES))


def win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, part, seg_id, k, t0, mid, t1."""
    made = tumbling(seg(spark, sf_dir), "a", "b", HOUR)
    return made.select("case_id", "part", F.col("event_id").alias("seg_id"), "k", "t0", (F.col("t0") + HOUR // 2).alias("mid"), "t1")


def window_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, part, seg_id, k, t0, mid, t1, classes, bag: windows with the tool intervals at their middles; those without any have an empty list."""
    made = sets_of(seg(spark, sf_dir), tool(spark, sf_dir), ["case_id", "part"], "a", "b", "event_id", "cls", HOUR)
    return made.withColumnRenamed("event_id", "seg_id")


def cube(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """vec_id, label, g, fold, f (frame), c (class), p; the second cube reads the vector class-major."""
    at = (lambda i: (i % FRAMES) * 1, lambda i: i // FRAMES) if second else (lambda i: i // CLASSES, lambda i: i % CLASSES)
    each = F.explode(F.array(*(F.struct(F.lit(at[0](i)).alias("f"), F.lit(at[1](i)).alias("c"), F.get("embedding", F.lit(i)).cast("double").alias("x")) for i in range(FRAMES * CLASSES)))).alias("e")
    df = _table(spark, sf_dir, "embeddings").select("vec_id", "label", each)
    return df.select("vec_id", "label", (F.col("vec_id") % 20).alias("g"), (F.col("vec_id") % 20 % 2).alias("fold"), "e.f", "e.c", (1 / (1 + F.exp(-4 * F.col("e.x")))).alias("p"))


def clips(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """vec_id, label, g, fold, c, ps: a row a clip and class, its frame probabilities in frame order; no shuffle."""
    at = (lambda f, c: c * FRAMES + f) if second else (lambda f, c: f * CLASSES + c)
    p = lambda i: 1 / (1 + F.exp(-4 * F.get("embedding", F.lit(i)).cast("double")))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.array(*(p(at(f, c)) for f in range(FRAMES))).alias("ps")) for c in range(CLASSES)))).alias("e")
    df = _table(spark, sf_dir, "embeddings").select("vec_id", "label", each)
    return df.select("vec_id", "label", (F.col("vec_id") % 20).alias("g"), (F.col("vec_id") % 20 % 2).alias("fold"), "e.c", "e.ps", (F.col("label") % CLASSES == F.col("e.c")).cast("int").alias("y"))


EV = f"""ev AS (
  SELECT user_id AS case_id, event_id, event_type AS cls, value, epoch_us(ts) AS a,
         epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * {HALF_HOUR_CENT} AS b,
         CAST(day(ts) // 10 AS BIGINT) AS part,
         CAST(day(make_timestamp(epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * {HALF_HOUR_CENT})) // 10 AS BIGINT) AS part_b
  FROM events),
iv AS (SELECT * FROM ev WHERE part = part_b AND b > a),
seg AS (SELECT * FROM iv WHERE cls IN ('view', 'purchase')),
tool AS (SELECT * FROM iv WHERE cls NOT IN ('view', 'purchase')),
win AS (SELECT case_id, part, seg_id, k, a + k * {HOUR} AS t0, a + k * {HOUR} + {HOUR // 2} AS mid, a + (k + 1) * {HOUR} AS t1
        FROM (SELECT case_id, part, event_id AS seg_id, a, unnest(range(0, (b - a) // {HOUR})) AS k FROM seg))"""
STAB = EV + """,
stab AS (SELECT w.case_id, w.part, w.seg_id, w.k, w.t0, w.mid, w.t1, t.cls
         FROM win w JOIN tool t ON t.case_id = w.case_id AND t.part = w.part AND w.mid BETWEEN t.a AND t.b)"""
CUBE = """cube AS (SELECT vec_id, label, vec_id % 20 AS g, vec_id % 20 % 2 AS fold, i // 4 AS f, i % 4 AS c,
                        1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) AS p
                 FROM embeddings, range(64) r(i)),
cube2 AS (SELECT vec_id, label, vec_id % 20 AS g, vec_id % 20 % 2 AS fold, i % 16 AS f, i // 16 AS c,
                        1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) AS p
                 FROM embeddings, range(64) r(i)),
clip AS (SELECT vec_id, label, g, fold, c, CAST(label % 4 = c AS INT) AS y, avg(p) AS m, list(p ORDER BY f) AS ps FROM cube GROUP BY ALL),
clip2 AS (SELECT vec_id, label, g, fold, c, CAST(label % 4 = c AS INT) AS y, avg(p) AS m, list(p ORDER BY f) AS ps FROM cube2 GROUP BY ALL)"""
