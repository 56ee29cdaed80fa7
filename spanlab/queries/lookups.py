"""Queries over the star-schema tables: lookups, allocation, splits, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import bin_centres, centred_slice
from ..functions.hashing import draw, stable_index
from ..operators import audit as A
from ..operators import sampling as S
from .registry import query, table


@query(r"SELECT c_custkey, 'case_' || CASE WHEN length(d) >= 3 THEN d ELSE lpad(d, 3, '0') END AS key, CAST(d::BIGINT = c_custkey AS INT) AS agrees FROM (SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::BIGINT::VARCHAR AS d FROM customer)")
def q_key_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.regexp_extract("c_name", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("case_%03d", d).alias("key"), (d == F.col("c_custkey")).cast("int").alias("agrees"))


@query(r"SELECT p_partkey, coalesce(nullif(upper(substr(t, 1, 1)) || substr(t, 2), ''), 'Unnamed') AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN trim(regexp_replace(p_name, '[ \t\r\n]+', ' ', 'g'), ' ') END AS t FROM part)")
def q_finalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 10 != 0, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.finalized(name, "Unnamed").alias("name"))


PHRASES = [(1, "small ring", "jewel"), (2, "ring", "round"), (3, "small", "size"), (4, "large", "size"), (5, "red", "colour"), (6, "blue", "colour"), (7, "green", "colour"), (8, "bolt", "metal"), (9, "steel", "metal"), (10, "gear", "round"), (11, "widget", "thing")]
_PHR = "phr(rank, phrase, cls) AS (VALUES " + ", ".join(f"({r}, '{p}', '{c}')" for r, p, c in PHRASES) + ")"
_ALT = "|".join(p for _, p, _ in sorted(PHRASES, key=lambda x: (-len(x[1]), x[1])))


def _phrases(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(PHRASES, "rank long, phrase string, cls string"))


@query(rf"WITH {_PHR}, m AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '\b({_ALT})\b')) AS phrase FROM part) SELECT p_partkey, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes, count(*)::BIGINT AS n FROM m JOIN phr USING (phrase) GROUP BY p_partkey")
def q_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-first, leftmost, non-overlapping phrases of each name and their classes."""
    m = table(spark, sf_dir, "part").select("p_partkey", F.explode(X.matched_phrases(F.lower("p_name"), [p for _, p, _ in PHRASES])).alias("phrase"))
    return m.join(_phrases(spark), "phrase").groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("cls")), ",").alias("classes"), F.count(F.lit(1)).alias("n"))


@query(rf"WITH {_PHR} SELECT p_partkey, arg_min(phrase, (-length(phrase), phrase)) AS phrase FROM part JOIN phr ON contains(lower(p_name), phrase) GROUP BY p_partkey")
def q_phrase_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest phrase a name contains, from an ordered CASE over the small table; names without one are left out."""
    first = F.coalesce(*(F.when(F.contains(F.lower("p_name"), F.lit(p)), p) for _, p, _ in sorted(PHRASES, key=lambda x: (-len(x[1]), x[1]))))
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("phrase")).where("phrase is not null")


@query("WITH t AS (SELECT p_type, unnest(string_split(lower(p_name) || ' ' || lower(p_brand) || '/' || p_size, ' ')) AS token FROM part) SELECT token, min(p_type) AS only_type, count(*)::BIGINT AS n FROM t GROUP BY token HAVING count(DISTINCT p_type) = 1")
def q_distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select("p_type", F.explode(F.split(F.concat(F.lower("p_name"), F.lit(" "), F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string")), " ")).alias("token"))
    return t.groupBy("token").agg(F.min("p_type").alias("only_type"), F.max("p_type").alias("other"), F.count(F.lit(1)).alias("n")).where("only_type = other").drop("other")


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 AND p_size > 25 THEN NULL WHEN p_size > 40 THEN 'mega' WHEN p_size > 25 THEN 'large' WHEN p_size % 6 = 0 THEN 'even' ELSE 'small' END AS family FROM part")
def q_part_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered family rule; where two markers meet there is no answer."""
    s = F.col("p_size")
    family = F.when((s % 6 == 0) & (s > 25), F.lit(None)).when(s > 40, "mega").when(s > 25, "large").when(s % 6 == 0, "even").otherwise("small")
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"))


_SHARE = "s AS (SELECT p_type, p_brand, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY p_type) AS share, max(count(*)) OVER (PARTITION BY p_type) / sum(count(*)) OVER (PARTITION BY p_type) AS best FROM part GROUP BY 1, 2)"


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("p_type")
    c = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("best", F.max("n").over(own) / F.sum("n").over(own))


@query(f"WITH {_SHARE} SELECT p_type, CASE WHEN max(best) < 0.045 THEN p_type ELSE arg_min(p_brand, (length(p_brand), p_brand)) FILTER (WHERE round(best - share, 9) <= 0.01) END AS shown FROM s GROUP BY p_type")
def q_display_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest name within a band of the most frequent; the type itself where none is frequent."""
    near = F.min(F.when(F.round(F.col("best") - F.col("share"), 9) <= 0.01, F.struct(F.length("p_brand").alias("len"), "p_brand"))).alias("near")
    return _shares(spark, sf_dir).groupBy("p_type").agg(near, F.max("best").alias("best")).select("p_type", F.when(F.col("best") < 0.045, F.col("p_type")).otherwise(F.col("near.p_brand")).alias("shown"))


@query(f"WITH {_SHARE} SELECT p_type, p_brand, n::BIGINT AS n, round(share, 4) AS share, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand)::BIGINT AS rank FROM s")
def q_variant_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("p_type", "p_brand", "n", F.round("share", 4).alias("share"), F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")).cast("long").alias("rank"))


_BOX = "b AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 - 40 AS x0, l_discount * 4000 AS y0, l_quantity * 20 + l_tax * 2000 AS x1, l_discount * 4000 + l_tax * 9000 AS y1 FROM lineitem)"


@query(f"WITH {_BOX}, c AS (SELECT l_orderkey, l_linenumber, least(greatest(x0, 0), 640) AS x0, least(greatest(y0, 0), 512) AS y0, least(greatest(x1, 0), 640) AS x1, least(greatest(y1, 0), 512) AS y1 FROM b) SELECT l_orderkey, l_linenumber, round((x0 + x1) / 2 / 640, 4) AS cx, round((y0 + y1) / 2 / 512, 4) AS cy, round((x1 - x0) / 640, 4) AS w, round((y1 - y0) / 512, 4) AS h FROM c WHERE x1 - x0 > 1e-9 AND y1 - y0 > 1e-9")
def q_clamp_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clamped to the frame and normalised; degenerate ones are dropped."""
    d = lambda c: F.col(c).cast("double")
    raw = {"x0": d("l_quantity") * 20 - 40, "y0": d("l_discount") * 4000, "x1": d("l_quantity") * 20 + d("l_tax") * 2000, "y1": d("l_discount") * 4000 + d("l_tax") * 9000}
    clamp = lambda name, hi: F.least(F.greatest(raw[name], F.lit(0.0)), F.lit(float(hi))).alias(name)
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clamp("x0", 640), clamp("y0", 512), clamp("x1", 640), clamp("y1", 512)).where("x1 - x0 > 1e-9 and y1 - y0 > 1e-9")
    return c.select("l_orderkey", "l_linenumber", F.expr("round((x0 + x1) / 2 / 640, 4)").alias("cx"), F.expr("round((y0 + y1) / 2 / 512, 4)").alias("cy"), F.expr("round((x1 - x0) / 640, 4)").alias("w"), F.expr("round((y1 - y0) / 512, 4)").alias("h"))


@query("WITH t AS (SELECT o_orderkey, (o_orderkey % 97) / 4.0 AS t0, (o_orderkey % 97) / 4.0 + (o_custkey % 13) / 2.0 AS t1 FROM orders), i AS (SELECT o_orderkey, round_even(t0 * 2, 0)::BIGINT AS first, round_even(t1 * 2, 0)::BIGINT - 1 AS last FROM t) SELECT o_orderkey, CASE WHEN last >= first AND last < 50 THEN first END AS first, CASE WHEN last >= first AND last < 50 THEN last END AS last FROM i")
def q_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame indices of a time span, halves to even; null outside the clip."""
    t0 = (F.col("o_orderkey") % 97) / 4.0
    t1 = t0 + (F.col("o_custkey") % 13) / 2.0
    i = table(spark, sf_dir, "orders").select("o_orderkey", F.bround(t0 * 2, 0).cast("long").alias("f"), (F.bround(t1 * 2, 0).cast("long") - 1).alias("l"))
    inside = (F.col("l") >= F.col("f")) & (F.col("l") < 50)
    return i.select("o_orderkey", F.when(inside, F.col("f")).alias("first"), F.when(inside, F.col("l")).alias("last"))


@query("WITH d AS (SELECT doc_id, coalesce(n_chars, 0) % 40 + 1 AS n FROM documents) SELECT doc_id, array_to_string(CASE WHEN n <= 8 THEN range(n) ELSE [((2 * i + 1) * n) // 16 FOR i IN range(8)] END, ',') AS picked FROM d")
def q_bin_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.coalesce("n_chars", F.lit(0)) % 40 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(bin_centres(n, F.lit(8)), lambda i: i.cast("string")), ",").alias("picked"))


@query("WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT o_custkey, ks, unnest(range(len(ks))) AS i FROM l) SELECT o_custkey, i::BIGINT AS i, array_to_string(ks[greatest(1, least(i - 1, len(ks) - 4)):greatest(1, least(i - 1, len(ks) - 4)) + 4], ',') AS around FROM p")
def q_centred_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks")).where("size(ks) >= 5")
    p = l.select("o_custkey", "ks", F.posexplode("ks").alias("i", "k"))
    return p.select("o_custkey", F.col("i").cast("long").alias("i"), F.array_join(F.transform(centred_slice(F.col("ks"), F.col("i"), 5), lambda k: k.cast("string")), ",").alias("around"))


@query("WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n = 4 THEN 'kept' WHEN n < 4 THEN 'short' ELSE 'long' END AS outcome, count(*)::BIGINT AS orders, sum(n)::BIGINT AS lines FROM c GROUP BY 1")
def q_exact_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("n") == 4, "kept").when(F.col("n") < 4, "short").otherwise("long")
    return c.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("orders"), F.sum("n").alias("lines"))


@query("SELECT p_type, p_partkey, p_name, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_name, p_partkey) AS rank FROM part) WHERE rank <= 3")
def q_ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey")
    return table(spark, sf_dir, "part").withColumn("rank", F.row_number().over(by).cast("long")).where("rank <= 3").select("p_type", "p_partkey", "p_name", "rank")


_FILL = """cap AS (SELECT c_nationkey AS nation, count(*) AS cap FROM customer GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY cap, nation) - 1 AS i, coalesce(sum(cap) OVER (ORDER BY cap, nation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, count(*) OVER () AS n, least(1460, sum(cap) OVER ()) AS t FROM cap),
e AS (SELECT *, (t - cum) // (n - i) AS even FROM o), j AS (SELECT min(i) AS j FROM e WHERE cap > even), l AS (SELECT i AS j, even AS level, t - cum - even * (n - i) AS rest FROM e WHERE i = (SELECT j FROM j)),
fill AS (SELECT e.nation, e.cap, CASE WHEN l.j IS NULL OR e.i < l.j THEN e.cap ELSE l.level + CASE WHEN row_number() OVER (PARTITION BY e.i >= l.j ORDER BY e.nation) <= l.rest THEN 1 ELSE 0 END END::BIGINT AS share FROM e LEFT JOIN l ON TRUE)"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("cap"))
    return S.water_fill(capacity, "nation", "cap", 1460)


@query(f"WITH {_FILL} SELECT nation::BIGINT AS nation, cap::BIGINT AS cap, share FROM fill")
def q_water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).withColumn("nation", F.col("nation").cast("long"))


@query(f"WITH {_FILL}, r AS (SELECT c_custkey, c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('strat|' || c_custkey)) AS r FROM customer) SELECT c_custkey, r.nation::BIGINT AS nation FROM r JOIN fill USING (nation) WHERE r <= share // 10")
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    shares = _filled(spark, sf_dir).select("nation", F.expr("share div 10").alias("share"))
    return S.stratified_sample(customers, "nation", shares, draw("strat", F.col("c_custkey"))).select("c_custkey", F.col("nation").cast("long").alias("nation"))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 10 = 0")
def q_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.systematic(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 10).select("o_orderpriority", "o_orderkey")


PLANS = [(1, 32, 896), (2, 32, 672), (3, 16, 672), (4, 16, 448), (5, 8, 448), (6, 8, 224)]


@query(f"""WITH p(rank, frames, size) AS (VALUES {', '.join(map(str, PLANS))}), b AS (SELECT o_orderkey, o_orderkey * 37 % 40000 AS tokens, o_custkey % 620 AS seconds FROM orders), c AS (SELECT *, ((size // 14) * (size // 14) // 4) * frames AS cost FROM p),
m AS (SELECT o_orderkey, min(rank) AS rank FROM b JOIN c ON cost <= tokens AND round(15 + 40 * cost / 1000.0, 6) <= seconds GROUP BY 1), d AS (SELECT x.rank, any_value(x.cost) AS cost, min(y.rank) AS cheaper FROM c x LEFT JOIN c y ON y.cost < x.cost GROUP BY x.rank)
SELECT b.o_orderkey, m.rank::BIGINT AS rank, d.cost::BIGINT AS cost, d.cheaper::BIGINT AS cheaper FROM b LEFT JOIN m USING (o_orderkey) LEFT JOIN d ON d.rank = m.rank""")
def q_plan_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row's two budgets the richest plan within them and the next strictly cheaper one, null where none fits; the plans are a literal, so a CASE."""
    costed = [(rank, (size // 14) ** 2 // 4 * frames) for rank, frames, size in sorted(PLANS)]
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 40000).alias("tokens"), (F.col("o_custkey") % 620).alias("seconds"))
    fits = lambda cost: (F.lit(cost) <= F.col("tokens")) & (F.round(15 + 40 * F.lit(cost) / 1000.0, 6) <= F.col("seconds"))
    cheaper = {rank: min((r for r, c in costed if c < cost), default=None) for rank, cost in costed}
    best = F.coalesce(*(F.when(fits(cost), F.struct(F.lit(rank).cast("long").alias("rank"), F.lit(cost).cast("long").alias("cost"), F.lit(cheaper[rank]).cast("long").alias("cheaper"))) for rank, cost in costed))
    return o.select("o_orderkey", best.alias("b")).select("o_orderkey", "b.rank", "b.cost", "b.cheaper")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)) GROUP BY 1")
def q_anti_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out keys removed; removing none would be an error."""
    held = table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(3, 7)).select(F.col("c_custkey").alias("o_custkey"))
    return A.exclude(table(spark, sf_dir, "orders"), held, ["o_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_NSPLIT = "n AS (SELECT n_nationkey, CASE WHEN CAST(('0x' || sha256('n|' || n_nationkey)[1:16])::UHUGEINT % 5 AS INT) = 0 THEN 'val' ELSE 'train' END AS split FROM nation)"


def _nation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(stable_index(F.concat(F.lit("n|"), F.col("n_nationkey")), 5) == 0, "val").otherwise("train")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), split.alias("split"))


@query(f"WITH {_NSPLIT} SELECT split, count(*)::BIGINT AS customers, count(DISTINCT c_nationkey)::BIGINT AS nations FROM customer JOIN n ON n_nationkey = c_nationkey GROUP BY split")
def q_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(_nation_split(spark, sf_dir), "c_nationkey")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("c_nationkey").alias("nations"))


@query(f"WITH {_NSPLIT}, c AS (SELECT c_nationkey, split FROM customer JOIN n ON n_nationkey = c_nationkey) SELECT count(*)::BIGINT AS leaked FROM (SELECT c_nationkey FROM c WHERE split = 'val' INTERSECT SELECT c_nationkey FROM c WHERE split = 'train')")
def q_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(_nation_split(spark, sf_dir), "c_nationkey")
    return A.shared_keys(j.where("split = 'val'"), j.where("split = 'train'"), "c_nationkey").agg(F.count(F.lit(1)).alias("leaked"))


@query("WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'both' END AS side, count(*)::BIGINT AS n FROM a FULL JOIN b USING (k) GROUP BY 1")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"))
    return A.reconcile(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT s_suppkey, coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END, 'UNKNOWN') AS nation, coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN r_name END, 'UNKNOWN') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q_dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lookup with a default where the dimension lacks the key."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    j = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"), F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


@query("WITH f AS (SELECT r_name AS name, row_number() OVER (ORDER BY r_name) - 1 AS i, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey), m AS (SELECT unnest(range((SELECT 1 << count(*) FROM f))) AS mask) SELECT m.mask::BIGINT AS mask, count(name)::BIGINT AS size, coalesce(string_agg(name, '+' ORDER BY name), 'none') AS flags, coalesce(sum(n), 0)::BIGINT AS nations FROM m LEFT JOIN f ON (m.mask >> f.i) & 1 = 1 GROUP BY m.mask")
def q_flag_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subset of the regions with its nations; subsets double with every name, so more than sixteen are an error."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, sf_dir, "region").join(n, "r_regionkey").agg(F.array_sort(F.collect_list(F.struct("r_name", "n"))).alias("names"))
    few = F.when(F.size("names") <= 16, F.shiftleft(F.lit(1), 16)).otherwise(F.raise_error(F.lit("too many names")).cast("int"))
    masks = names.select("names", F.explode(F.sequence(F.lit(0), F.least(few, F.pow(F.lit(2), F.size("names")).cast("int")) - 1)).alias("mask"))
    own = F.filter("names", lambda x, i: F.expr("1").cast("int") == F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), i)), F.lit(2)))
    s = masks.select(F.col("mask").cast("long").alias("mask"), own.alias("own"))
    flags = F.array_join(F.transform("own", lambda x: x["r_name"]), "+")
    return s.select("mask", F.size("own").cast("long").alias("size"), F.when(F.size("own") == 0, "none").otherwise(flags).alias("flags"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("nations"))

