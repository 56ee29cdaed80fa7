"""What a review of the third round found, on small tables."""

import duckdb
import pytest

from spanlab.queries import ORACLES, QUERIES


def same_as_sql(spark, tmp_path, name, tables):
    """The rows of a query and of its SQL over tables that DuckDB makes."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"create table {table} as {sql}")
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    want = con.sql(ORACLES[name])
    assert got == sorted(map(repr, want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall()))
    return got


def test_arbitrate_capitals_and_missing_texts(spark, tmp_path):
    turns = "select * from (values (1, 0, 'Kei\u00df. a'), (1, 1, NULL), (1, 1, 'b c'), (1, 2, '\u01f0\ufb01\u1fb3 x'), (1, 4, '\u1f80\u0149 y'), (1, 3, NULL), (1, 3, 'z')) t(conv_id, turn, text)"
    assert len(same_as_sql(spark, tmp_path, "q_arbitrate", {"conversations": f"select conv_id::bigint conv_id, turn::bigint turn, text from ({turns})"})) == 42


def test_settings_halves(spark, tmp_path):
    same_as_sql(spark, tmp_path, "q_settings", {"supplier": "select (1 + 5 * i)::bigint s_suppkey, 's' || i s_name, i::int s_nationkey, i - 6 + 0.5::double s_acctbal from range(12) r(i)"})


def test_named_files_are_whole_and_one_each(spark, tmp_path):
    from spanlab.sources import files

    df = spark.range(5000).selectExpr("concat('f', id % 700, '/x.txt') name", "cast(id as string) value", "id").repartition(7)
    assert files.write_named(df, str(tmp_path / "a"), "id", head="h") == 700  # a file a name, however the rows are partitioned
    assert sum(p.is_file() for p in (tmp_path / "a").rglob("*")) == 700
    got = {r.name: (r.length, r.content.decode()) for r in files.read_named(spark, str(tmp_path / "a")).collect()}
    want = {f"f{k}/x.txt": "h\n" + "".join(f"{i}\n" for i in range(k, 5000, 700)) for k in range(700)}
    assert got == {n: (len(t), t) for n, t in want.items()}
    assert files.read_named(spark, str(tmp_path / "a"), content=False).where("content is null").count() == 700


def test_case_files_are_one_a_case(spark, sf_dir, monkeypatch):
    from pathlib import Path

    from spanlab.queries import files as Q

    for name, cases in (("q_case_files", 15), ("q_file_listing", 15)):
        made = []
        whole = Q.folder
        monkeypatch.setattr(Q, "folder", lambda s, whole=whole, made=made: made.append(whole(s)) or made[-1])
        QUERIES[name](spark, sf_dir).collect()
        monkeypatch.setattr(Q, "folder", whole)
        assert sum(p.suffix in (".csv", ".txt") for p in Path(made[0]).rglob("*")) == cases


def test_window_sets_meet_whole_segments(spark):
    import random

    from spanlab.operators import intervals as I

    rng = random.Random(5)
    hour, day = 3600, 86_400
    segs = [(k % 3, k, a, a + rng.randrange(60 * hour)) for k in range(60) for a in [rng.randrange(30 * day)]]
    long = [(0, 5 * day, 9000 * day, "c"), (1, 0, 70 * day, "d")]  # of higher levels
    ivs = [(rng.randrange(3), a, a + rng.randrange(40 * hour), rng.choice("ab")) for a in (rng.randrange(30 * day) for _ in range(90))] + long
    s, t = spark.createDataFrame(segs, "c long, i long, a long, b long"), spark.createDataFrame(ivs, "c long, a long, b long, cls string")
    for some in (ivs, [x for x in ivs if x not in long]):
        t = spark.createDataFrame(some, "c long, a long, b long, cls string")
        df = I.window_sets(s, t, ["c"], "a", "b", "i", "cls", hour, bucket=6 * hour)
        want = {}
        for c, i, a, b in segs:
            for k in range((b - a) // hour):
                mid = a + k * hour + hour // 2
                hit = [x[3] for x in some if x[0] == c and x[1] <= mid <= x[2]]
                want[i, k] = (a + k * hour, mid, a + (k + 1) * hour, sorted(set(hit)), len(hit))
        rows = df.collect()
        assert len(rows) == len(want) and {(r.i, r.k): (r.t0, r.mid, r.t1, r.classes, r.bag) for r in rows} == want


def test_stable_index_of_large_hashes(spark):
    import hashlib

    from pyspark.sql import functions as F

    from spanlab.functions.hashing import stable_index

    for n in (1, 7, 54, 2**31 - 1):
        got = spark.range(200).select(stable_index(F.col("id").cast("string"), n).alias("x")).collect()
        assert [r.x for r in got] == [int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:8], "big") % n for k in range(200)]


def test_swap_search_over_more_cases_than_one_task_holds(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from spanlab.operators import sampling as S

    many = spark.range(100_100).select(F.col("id").alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c")).withColumn("n", F.abs(F.hash("k", "c")) % 50 + 1)
    split = S.swap_search(many, "k", "c", "n", 0.2, 5)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"val": 20_020, "train": 80_080}
    assert S.improving_swaps(many, split, "k", "c", "n", 0.2, 5).count() == 0

    rng = random.Random(8)
    monkeypatch.setattr(S, "WORKING", 4)
    monkeypatch.setattr(S, "PAIRS", 4)
    for floor, most in ((5, 200), (70, 40)):
        rows = [(i, c, rng.randrange(1, most)) for i in range(60) for c in "abc" if rng.random() < 0.7]
        counts = spark.createDataFrame(rows, "k long, c string, n long")
        total = {c: sum(n for _, d, n in rows if d == c) for c in "abc"}
        side = {r.k: r.split for r in S.swap_search(counts, "k", "c", "n", 0.2, floor).collect()}

        def cost(val, rows=rows, total=total, floor=floor):
            own = {c: sum(n for k, d, n in rows if d == c and k in val) for c in "abc"}
            return sum((own[c] / (0.2 * total[c]) - 1) ** 2 + 1000 * (own[c] < floor) for c in "abc")

        val = {k for k, s in side.items() if s == "val"}
        assert len(val) == round(0.2 * len(side)) and set(side) == {k for k, _, _ in rows}
        assert min(cost(val - {a} | {b}) for a in val for b in set(side) - val) >= cost(val) * (1 - 1e-6)
        drawn = spark.createDataFrame([(k, "val" if i < 12 else "train") for i, k in enumerate(rng.sample(sorted(side), len(side)))], "k long, split string")
        val = {r.k for r in drawn.where("split = 'val'").collect()}
        want = {str(a): max(cost(val) - cost(val - {a} | {b}) for b in set(side) - val) for a in val}
        got = {r.key: r.gain for r in S.improving_swaps(counts, drawn, "k", "c", "n", 0.2, floor).collect()}
        assert set(got) == {a for a, g in want.items() if g > 1e-9} and all(abs(got[a] - want[a]) < 1e-6 for a in got)


def test_index_counts_are_those_of_stable_index(spark):
    from pyspark.sql import functions as F

    from spanlab.functions.hashing import index_counts, stable_index

    df = spark.range(3000).select(F.concat_ws("|", "id", F.lit("\u00e9")).alias("k"), F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("x"))
    got = {(r["name"], r["index"], r["answer"]): r["n"] for r in index_counts(df, F.col("k"), {"p": F.col("x"), "q": F.lit("1")}, 5).collect()}
    want = {}
    for name, answer in (("p", F.col("x")), ("q", F.lit("1"))):
        for r in df.groupBy(stable_index(F.concat("k", F.lit(f"|{name}")), 5).alias("i"), answer.alias("a")).count().collect():
            want[name, r.i, r.a] = r["count"]
    assert got == want and sum(got.values()) == 6000
    assert index_counts(df.limit(0), F.col("k"), {"p": F.col("x")}, 5).count() == 0


@pytest.mark.parametrize("name", ["q_fold_imbalance", "q_multi_hot", "q_stab_join", "q_class_frequency", "q_window_prior"])
def test_windows_are_not_shuffled(spark, tmp_path, name):
    store = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    known = {store().apply(i).stageId() for i in range(store().size())}
    events = """select i::bigint event_id, timestamp '2024-01-01 00:00:00' + to_seconds((i * 311)::bigint) ts, (i % 5)::bigint user_id,
        ['view', 'click', 'purchase', 'error', 'view', 'signup'][i % 6 + 1] event_type, (300 + i % 70)::double as value from range(120) r(i)"""
    same_as_sql(spark, tmp_path, name, {"events": events})
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = [store().apply(i) for i in range(store().size())]
    sent = sum(s.shuffleWriteRecords() for s in stages if s.stageId() not in known)
    ((windows,),) = duckdb.sql(f"select sum(floor(value / 2)) from '{tmp_path}/events.parquet' where event_type in ('view', 'purchase')").fetchall()
    trials = 4 * 4000 if name == "q_fold_imbalance" else 0  # a row a trial and class, whatever the windows
    assert windows > 9000 and sent < 0.3 * windows + trials
