"""Language-model scores, the Jaccard join, chat windows, the pipeline."""

import collections
import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from spanlab.llm import chat, jaccard, lm_score


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_scores(docs, block_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for doc, text in rows:
        if not brute.is_held(doc):
            w = [*brute.spaced(text, lower=True), ""]
            count.update(w)
            pairs.update(zip([None, *w], w, strict=False))
            triples.update(zip([None, *w], w, w[1:], strict=False))
    n, v, (k, l) = sum(count.values()), len(count), lm_score.STRENGTH
    expected = []
    for doc, text in rows:
        w = [*brute.spaced(text, lower=True), ""]
        p = [(count[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score, before, last = 0.0, None, None
        for i, (x, q) in enumerate(zip(w, p, strict=True)):
            q = (pairs[before, x] + k * q) / ((count[""] if before is None else count[before]) + k)
            if i:
                q = (triples[last, before, x] + l * q) / (pairs[last, before] + l)
            score += math.log10(q)
            last, before = before, x
        expected.append((doc, brute.is_held(doc), len(w), sum(count[x] > 0 for x in w), n, sum(map(math.log10, p)), score))
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in lm_score.score(docs, block_bytes=block_bytes).collect()), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_what_blocks_ask_grows_with_the_input(spark):
    """Twice the documents ask no more than twice the rows, and never more than there are keys."""
    from spanlab.llm import blocks

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(3000)], k=60))) for i in range(800)]
    n_rows = []
    for n in (400, 800):
        df = spark.createDataFrame(texts[:n], "doc_id long, text string")
        table, k = blocks.blocked(df, 4000)
        asked = lm_score.asked_of(table, k).collect()
        keys = [r.n_words + len(blocks.from_ascending(r.grams)) for r in asked]
        assert all(keys) and len(asked) == len({(r.block, r.shard) for r in asked}) <= min(sum(keys), k * blocks.shards_of(k))
        n_rows.append(sum(keys))
    assert n_rows[1] <= 2.1 * n_rows[0]


def test_rows_of_one_id_are_dealt_over_blocks(spark):
    from spanlab.llm import blocks

    df = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " + "x" * 50) for i in range(400)], "doc_id long, text string")
    table, n = blocks.blocked(df, 2000)
    sizes = [r["count"] for r in table.groupBy("block").count().collect()]
    assert n > 15 and max(sizes) < 60


def test_held_out_texts_gain_from_the_model(spark):
    """Texts of a small grammar: held-out ones are likelier under the automaton than under words alone, and under triples than under pairs."""
    rng = random.Random(3)
    follow = {}

    def text():
        w = ["a", "b"]
        while len(w) < 80:
            w.append(rng.choice(follow.setdefault((w[-2], w[-1]), rng.sample([f"w{k}" for k in range(40)], 2))))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    held = lambda strength: lm_score.score(df, strength).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    base, triples = held(lm_score.STRENGTH)
    _, pairs = held((lm_score.STRENGTH[0], 1e12))
    assert triples > pairs > base


def test_model_is_a_distribution(spark):
    words = [f"w{i}" for i in range(30)]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm_score.score(df.limit(0)).count() == 0
    r = lm_score.score(df).agg(F.max("score").alias("m")).first()
    assert r.m < 0


def near_copies(seed):
    """Chains and families of near copies, copies, passages many share, texts of few words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    out, passage = {}, [word() for _ in range(30)]
    for i in range(40):
        out[i] = [word() for _ in range(rng.choice([4, 5, 6, 30, 60]))]
    for i in range(40, 110):
        w = list(out[rng.randrange(i)])
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = word()
        out[i] = w + [word()] * rng.choice([0, 0, 1])
    for i in range(110, 140):
        out[i] = passage + [word() for _ in range(rng.choice([3, 10, 60]))]
    ids = rng.sample(range(10_000), len(out))
    return {ids[k]: " ".join(w) for k, w in out.items()} | {20_000: None, 20_001: "", 20_002: " "}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    texts = near_copies(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute.components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, block_bytes=1 << (10 + 4 * seed)).collect()}
    assert got == {i: (len(brute.shingles(t)), expected[i]) for i, t in texts.items()}
    assert len(set(expected.values())) < len(expected)


def test_odd_documents(docs, texts, empty):
    rows = jaccard.components(docs).collect()
    expected = brute.components(texts)
    assert len(rows) == docs.count()
    for r in rows:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1, *set(expected.values())])
    assert jaccard.components(empty).count() == 0 and jaccard.distinct(empty).count() == 0


def test_rows_of_equal_id_link_by_their_smallest_set(spark):
    short, long_ = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, "near", long_ + " x"), (2, "near", short + " x"), (5, "both", long_), (5, "both", short), (5, "none", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, kind string, text string").repartition(3)
        got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.components(docs, block_bytes=1 << 8).collect()}
        assert got == {(1, 57): 1, (2, 27): 2, (5, 56): 2, (5, 26): 2, (5, 0): 2}
        assert sorted(jaccard.distinct(docs).toPandas().doc_id) == [1, 2]
    alone = spark.createDataFrame(rows[3:], "doc_id long, kind string, text string")
    assert [r.text for r in jaccard.distinct(alone).collect()] == [short]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.doc_id: r.label for r in jaccard.component_of(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


TURNS = [
    (1, 0, "system", "Be <turn kind>."), (1, 1, "user", "Hi </turn> <\\turn <\\\\/turn"), (1, 2, "assistant", "A </turn>\n<turn user>\nB"), (1, 3, "user", "x" * 400), (1, 4, "assistant", "long " * 200),
    (1, 5, "user", None), (1, 6, "assistant", ""), (1, 6, "assistant", ""), (2, 0, "a>b<c%\nd", "odd role"), (2, 1, None, None), (None, 0, "user", "no id"), (3, 1, "assistant", "late"), (3, 0, "user", "<"), (3, None, "user", "first"),
]


def tokens_of(text):
    return 4 + (len((text or "").encode()) + 3) // 4


@pytest.mark.parametrize("seed", range(4))
def test_windows_keep_the_budget(spark, seed):
    """Random conversations with system turns up to and beyond the budget; windows against a plain restatement."""
    rng = random.Random(seed)
    budget, history, back = rng.choice([(100, 30, 2), (300, 200, 3), (64, 0, 1), (200, 500, 4)])
    turns, rows = {}, []
    for c in range(60):
        n, at = rng.choice([1, 2, 9, 40]), 0
        for k in range(n):
            at += rng.choice([1, 1, 1, 300, 1000])
            role = "system" if k == 0 and c % 3 else rng.choice(["user", "assistant"])
            text = "w" * (rng.randrange(5 * budget) if k == 0 or rng.random() < 0.1 else rng.randrange(2 * budget))
            turns.setdefault(c, []).append((role, text))
            rows.append((c, at, role, text))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    made = chat.windows(df, budget=budget, history=history, history_turns=back).select("conv_id", "window", "n_context", chat.parse(F.col("formatted")).alias("turns")).collect()
    got = {(r.conv_id, r.window): (r.n_context, [tuple(t) for t in r.turns]) for r in made}
    expected = {}
    for c, own in turns.items():
        size = [tokens_of(t) for _, t in own]
        st = size[0] if own[0][0] == "system" and size[0] < budget else 0
        past = min(history, (budget - st) // 2)
        stride, at, windows = budget - st - past, 0, {}
        for i, n in enumerate(size):
            if i == 0 and st:
                windows[0] = [0]
                continue
            k = at // stride
            windows.setdefault(2 * k + (at + n > (k + 1) * stride), []).append(i)
            at += n
        for w, new in windows.items():
            most, sum_, old = min(past, budget - st - (size[new[0]] if w % 2 else stride)), 0, []
            for i in range(new[0] - 1, max(-1, new[0] - 1 - back), -1):
                sum_ += size[i]
                if sum_ > most or (i == 0 and st):
                    break
                old.insert(0, i)
            if st and w > 0 and st + (size[new[0]] if w % 2 else stride) <= budget:
                old.insert(0, 0)
            expected[c, w] = (len(old), [own[i] for i in old + new])
            total = sum(size[i] for i in old + new)
            assert total <= budget or max(size[i] for i in new) > budget
    assert got == expected


def test_windows_plan_is_small(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 10


def test_windows_read_back(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, window string")
    for budget, history in ((64, 16), (200, 60), (4000, 100)):
        made = chat.windows(df, budget=budget, history=history)
        rows = made.select("conv_id", "window", "n_context", "n_new", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
        back, loss = {}, {}
        for r in sorted(rows, key=lambda r: r.window):
            assert len(r.turns) == r.n_context + r.n_new
            back.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns[r.n_context :])
            loss[r.conv_id] = loss.get(r.conv_id, "") + r.loss
            sizes = [tokens_of(t.text) for t in r.turns]
            assert sum(sizes) <= budget or max(sizes[r.n_context :]) > budget
        expected = {}
        for c, t, role, text, in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
            expected.setdefault(c, []).append((role or "", text or ""))
        assert back == expected
        assert loss == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in expected.items()}
    assert chat.windows(df.limit(0)).count() == 0


def test_history_is_repeated_and_masked(spark):
    df = spark.createDataFrame([(1, 0, "system", "sys")] + [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "w" * 100) for i in range(1, 20)], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.windows(df, budget=200, history=70, history_turns=2).collect(), key=lambda r: r.window)
    assert len(rows) > 3 and all("sys" in r.formatted for r in rows)
    assert all(r.n_context >= 2 for r in rows[1:]) and rows[0].n_context == 0
    for r in rows:
        assert r.formatted.count("<turn assistant>") >= len(r.loss_spans)


def test_queries_match_sql(spark, sf_dir):
    import duckdb

    from spanlab.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("benchmark", "conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        relation = con.execute(sql)
        names = [d[0] for d in relation.description]
        assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, relation.fetchall()))


def test_pipeline(spark, sf_dir):
    import numpy as np

    import corpus_pipeline
    from spanlab.llm import quality, secret_scan
    from spanlab.llm.common import vocabulary_path
    from spanlab.llm.wordids import word_ids

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    llr = {r.doc_id: r.llr for r in quality.assess(docs, model).collect()}
    left = {}
    for i, t in texts.items():
        n, _, _, _, repeated = brute.rules(t)
        if n >= 20 and 100 * repeated <= 30 * n and llr[i] >= model.threshold:
            left[i] = t
    left = {i: left[i] for i, c in brute.components(left).items() if c == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}

    def clean(t):
        n, hit, _ = brute.contamination(t, items)
        return not (hit and 20 * hit >= n)

    left = {i: t for i, t in left.items() if clean(t)}
    ratios = secret_scan.train(secret_scan.labelled_samples(spark))
    spans = {r.doc_id: r.every for r in secret_scan.scan(docs, ratios).select("doc_id", "every").collect()}
    for i, t in left.items():
        at, out = 0, []
        for s in spans[i]:
            if s.start >= at:
                out += [t[at : s.start], "[SECRET]"]
            at = max(at, s.end)
        left[i] = "".join(out) + t[at:]
    library = word_ids(vocabulary_path()).full
    expected = set()
    for i, t in left.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), 4096)):
            expected.add((i, p, np.array(ids[a : a + 4096], "<u4").tobytes()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, bytes(r.ids)) for r in got} == expected and len(got) == len(expected)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "best_fit_packing"]


def test_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("base", F.lit(1)).withColumn("same", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema, name
