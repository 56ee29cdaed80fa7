"""Queries over names, labels and short forms, and over whole listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forms as X
from ..functions.hashing import stable_index
from ..sources.intervals_csv import seconds
from .registry import query, table


@query("SELECT l_orderkey, l_linenumber, l_linenumber || CASE WHEN l_orderkey % 2 = 0 THEN '.0' ELSE '.5' END AS written, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber END::BIGINT AS part FROM lineitem")
def q_part_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ".0").otherwise(".5"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("written")).withColumn("part", X.part_number(F.col("written"), strict=False))


# What a model said, the polarity in it, the candidate of ("first", "second") that it names, and what kind of decision it is.
SAID = [
    ("Yes.", "Yes", None, "suppressed"),
    ("  no, it isn't", "No", None, "suppressed"),
    ("NO: none", "No", None, "suppressed"),
    ("yes-man", None, None, "suppressed"),
    ("*Yes* it is", None, None, "suppressed"),
    ("1 yes", None, None, "suppressed"),
    ("Answer 2", None, "second", "choice"),
    ("answer 1: the first one", None, "first", "choice"),
    ("Answer2", None, "second", "choice"),
    ("Answer 2.", None, "second", "choice"),
    ("Answer 1- so", None, "first", "choice"),
    ("ANSWER 2 : so", None, "second", "choice"),
    ("Answer 2 and more", None, None, "suppressed"),
    ("Answer 0", None, None, "unparseable"),
    ("Answer 3", None, None, "unparseable"),
    ("Answer 99999999999999999999", None, None, "unparseable"),
    ("Answer", None, None, "suppressed"),
    ("I think Answer 2", None, None, "suppressed"),
    (" ", None, None, "unparseable"),
]
_SAID = ", ".join("(" + ", ".join("NULL" if x is None else "'" + str(x).replace("'", "''") + "'" for x in (i, *row)) + ")" for i, row in enumerate(SAID))


@query(f"""WITH v(id, said, polarity, chosen, source) AS (VALUES {_SAID}), c AS (SELECT CAST(('0x' || sha256(conv_id || '|' || turn)[1:16])::UHUGEINT % {len(SAID)} AS VARCHAR) AS id FROM conversations)
SELECT id::BIGINT AS id, polarity, chosen, source, count(*)::BIGINT AS n FROM c JOIN v USING (id) GROUP BY ALL""")
def q_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to turns of conversations, one of the list each, white space around every other one."""
    pick = stable_index(F.concat_ws("|", "conv_id", "turn"), len(SAID)).alias("id")
    t = table(spark, sf_dir, "conversations").select(pick, "turn")
    said = F.get(F.array(*(F.lit(r[0]) for r in SAID)), F.col("id").cast("int"))
    t = t.withColumn("said", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" \n"), said, F.lit("\t"))).otherwise(said))
    j = t.withColumn("j", X.judged(F.col("said"), F.array(F.lit("first"), F.lit("second"))))
    return j.groupBy("id", X.polarity_of(F.col("said")).alias("polarity"), F.col("j.answer").alias("chosen"), F.col("j.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS noun,
CASE WHEN NOT regexp_matches(p_brand, '(^| )[0-9]+$') AND NOT regexp_matches(p_brand, '(s|x|z|ch|sh)$') THEN p_brand || 's' END AS brands, CASE WHEN NOT regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 's' END AS many FROM part""")
def q_display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.display_noun(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("noun"), X.plural(F.col("p_brand")).alias("brands"), X.plural(F.col("p_name")).alias("many"))


@query("SELECT event_id, printf('case_%03d/part%d/%06d.jpg', user_id, event_id % 3 + 1, event_id) AS path, user_id AS \"case\", event_id % 3 + 1 AS part, event_id AS frame FROM events")
def q_shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to paths and back."""
    e = table(spark, sf_dir, "events").select("event_id", X.shard_name(F.col("user_id"), F.col("event_id") % 3 + 1, F.col("event_id")).alias("path"))
    return e.withColumn("name", X.parsed_name(F.col("path"))).select("event_id", "path", "name.case", "name.part", "name.frame")


@query("SELECT event_type, count(*) FILTER (WHERE value / 100 BETWEEN 0 AND 1)::BIGINT AS valid, count(*)::BIGINT AS n FROM events GROUP BY 1")
def q_threshold_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(X.valid_threshold(F.col("value") / 100)).alias("valid"), F.count(F.lit(1)).alias("n"))


@query(r"WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS line FROM documents) SELECT doc_id, CASE WHEN length(line) > 40 THEN line[1:39] || '…' ELSE line END AS shown FROM d")
def q_clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clipped(F.col("text"), 40).alias("shown"))


@query("SELECT event_type, min(value) AS fastest, round(avg(value), 6) AS mean, max(value) AS slowest FROM events GROUP BY 1")
def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("fastest"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("slowest"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'buy' END AS mapped FROM events")
def q_detector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"click": "touch", "view": "look", "purchase": "buy", "signup": None, "error": None}
    return table(spark, sf_dir, "events").select("event_id", X.mapped(F.col("event_type"), known).alias("mapped"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_type, string_agg(event_id::VARCHAR, ', ' ORDER BY k) || CASE WHEN any_value(n) > 4 THEN ' +' || (any_value(n) - 4) || ' more' ELSE '' END AS listed FROM r WHERE k <= 4 GROUP BY 1, 2""")
def q_capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of each group and how many more; one pass that gathers five rows a group at most."""
    by = Window.partitionBy("user_id", "event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    e = e.withColumn("k", F.row_number().over(by.orderBy("event_id"))).withColumn("n", F.count(F.lit(1)).over(by)).where("k <= 4")
    listed = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.max("n").cast("int").alias("n"))
    return listed.select("user_id", "event_type", X.capped_list(F.transform("ids", lambda i: i.cast("string")), 4, F.col("n")).alias("listed"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_orderkey, count(*)::BIGINT AS paths FROM p LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey
GROUP BY l_orderkey HAVING count(*) = count(s_suppkey)""")
def q_existing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records all of whose references exist in a listing."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    there = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("there"))
    n = p.join(there, "l_suppkey", "left").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("paths"), F.count("there").alias("found"))
    return n.where("paths = found").select("l_orderkey", "paths")


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) AS top, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY 1)
SELECT user_id, concat_ws(chr(10), 'Events: ' || n, 'Kinds: ' || kinds, CASE WHEN errors > 0 THEN 'Errors: ' || errors END, CASE WHEN top > 100 THEN 'High values: yes' END, CASE WHEN n < 5 THEN 'Note: few' END, 'Task: describe the user') AS prompt FROM u""")
def q_evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six evidence blocks, those without evidence left out."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("top"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    some = lambda test, text: F.when(test, text)
    blocks = [
        ("Events", F.col("n").cast("string")),
        ("Kinds", F.array_join("kinds", ", ")),
        ("Errors", some(F.col("errors") > 0, F.col("errors").cast("string"))),
        ("High values", some(F.col("top") > 100, F.lit("yes"))),
        ("Note", some(F.col("n") < 5, F.lit("few"))),
        ("Task", F.lit("describe the user")),
    ]
    return u.select("user_id", X.evidence_prompt(blocks).alias("prompt"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL ELSE round(CASE WHEN event_id % 5 = 1 THEN 1000 ELSE hour(ts) END * 3600 + CASE WHEN event_id % 5 = 2 THEN 75 ELSE minute(ts) END * 60 + second(ts), 6)::DOUBLE END AS seconds FROM events")
def q_parse_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as the interval logs write them: with spaces around, of many hours, of more than sixty minutes, and unreadable."""
    k, t = F.col("event_id") % 5, F.date_format("ts", "HH:mm:ss")
    written = F.when(k == 0, F.concat(t, F.lit(":9"))).when(k == 1, F.concat(F.lit("1000"), F.substring(t, 3, 6))).when(k == 2, F.concat(F.substring(t, 1, 3), F.lit("75"), F.substring(t, 6, 3))).when(k == 3, F.concat(F.lit("  "), t, F.lit(" "))).otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", F.round(seconds(written), 6).alias("seconds"))


@query("""WITH f AS (SELECT unnest(range(8)) AS flags), d AS (SELECT doc_id, n_chars > 500 AS a, lang = 'en' AS b, source < 's' AS c, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
s AS (SELECT flags, quality, (flags & 1 = 0 OR a) AND (flags & 2 = 0 OR b) AND (flags & 4 = 0 OR c) AS said FROM f, d)
SELECT flags::BIGINT AS flags, count(*) FILTER (WHERE said)::BIGINT AS chosen, CASE WHEN count(*) FILTER (WHERE said) > 0 THEN round(avg(quality) FILTER (WHERE said), 6) END AS share, CASE WHEN count(*) FILTER (WHERE said) = 0 THEN 'nothing chosen' END AS error FROM s GROUP BY flags""")
def q_flag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subset of three filters scored; one that leaves nothing says so instead of a score."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    tests = (F.col("n_chars") > 500, F.col("lang") == "en", F.col("source") < "s")
    counts = d.groupBy(*(t.alias(f"t{k}") for k, t in enumerate(tests)), "quality").agg(F.count(F.lit(1)).alias("n"))  # sixteen rows at most
    each = counts.withColumn("flags", F.explode(F.sequence(F.lit(0), F.lit(7))))
    said = F.lit(True)
    for k in range(3):
        said = said & ((F.col("flags").bitwiseAND(1 << k) == 0) | F.col(f"t{k}"))
    n = F.sum(F.when(said, F.col("n")).otherwise(0))
    good = F.sum(F.when(said, F.col("n") * F.col("quality")).otherwise(0))
    out = each.groupBy(F.col("flags").cast("long").alias("flags")).agg(n.alias("chosen"), good.alias("good"))
    return out.select("flags", "chosen", F.when(F.col("chosen") > 0, F.round(F.col("good") / F.col("chosen"), 6)).alias("share"), F.when(F.col("chosen") == 0, "nothing chosen").alias("error"))


@query("""WITH q AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'large' WHEN 1 THEN 'mega' END AS asked, CASE WHEN p_partkey % 4 = 0 THEN 'count' ELSE 'presence' END AS intent, p_partkey % 5 = 0 AS two, p_retailprice > 1000 AS detected, p_size > 5 AS decided, CASE WHEN p_partkey % 2 = 0 THEN 'large' ELSE 'mega' END AS family FROM part)
SELECT p_partkey, CASE WHEN asked IS NOT NULL AND intent = 'presence' AND NOT two AND detected AND decided THEN CASE WHEN family = asked THEN 'Yes' ELSE 'No' END END AS answer FROM q""")
def q_variant_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    asked = F.when(size % 3 == 0, "large").when(size % 3 == 1, "mega")
    intent = F.when(key % 4 == 0, "count").otherwise("presence")
    classes = F.when(key % 5 == 0, F.array("p_brand", F.lit("other"))).otherwise(F.array("p_brand"))
    family = F.when(key % 2 == 0, "large").otherwise("mega")
    gate = X.variant_gate(asked, intent, classes, F.col("p_retailprice") > 1000, size > 5, family, F.col("p_brand"), ("large", "mega"))
    return table(spark, sf_dir, "part").select("p_partkey", gate.alias("answer"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN ' ' ELSE coalesce(text, '') END, '[ \t\n\f\r]+', ' ', 'g'), ' ') AS said FROM conversations)
SELECT conv_id, turn, to_json(CASE WHEN said = '' THEN 'Unknown.' ELSE said END)::VARCHAR AS response FROM t""")
def q_response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.response_text(said, "Unknown.").alias("response"))


@query("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'where is it' WHEN s_suppkey % 4 = 1 THEN 'what tool acts' WHEN s_suppkey % 4 = 2 THEN 'what is it' ELSE 'is it there' END AS question, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS answer FROM supplier)
SELECT s_suppkey, CASE WHEN question LIKE 'what tool%' THEN 'tool' WHEN question LIKE 'what%' THEN 'thing' ELSE 'place' END AS intent, answer FROM l WHERE answer <> '' AND question NOT LIKE 'is%'""")
def q_annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer lines, those of the known shapes; the first shape that fits counts."""
    k = F.col("s_suppkey") % 4
    question = F.when(k == 0, "where is it").when(k == 1, "what tool acts").when(k == 2, "what is it").otherwise("is it there")
    line = F.concat(question, F.lit(" | "), F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.col("s_name")), F.lit("|more"))
    found = X.annotation(line, (("what tool", "tool"), ("what", "thing"), ("where", "place")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("a")).where("a is not null").select("s_suppkey", "a.intent", "a.answer")
