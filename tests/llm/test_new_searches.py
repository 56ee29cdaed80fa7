"""Ranked search, source divergence and repeated passages against plain restatements."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.llm import divergence, lexical, repeats

from brute import LOW

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def ranking(rows, query, k):
    """(doc_id, score) of the k best of all rows, one after the other."""
    own = [(i, collections.Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(w for _, c in own for w in c)
    out = []
    for i, c in own:
        m = 50 + (50 * sum(c.values()) * n) // total if total else 0
        score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(query)) if c[w])
        if score > 0:
            out.append((-score, i is None, i, score))
    return [(i, s) for _, _, i, s in sorted(out, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]


QUERIES = ["the tree by the river", "Straße ÉLAN élan 42", "general public license all rights reserved", "", None, "nowhere-to-be-found", "one two three", "the the the of and", "don't ring"]


@pytest.mark.parametrize(("shard", "query_bytes", "k"), [(1 << 23, 1 << 20, 50), (3000, 60, 7), (1, 1 << 20, 3)])
def test_ranking_is_that_of_all_documents(spark, docs, texts, shard, query_bytes, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = spark.createDataFrame([*enumerate(QUERIES), (0, QUERIES[0])], "item_id long, text string").withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in lexical.search(lexical.build(docs, shard_bytes=shard, longest=4), items, k, query_bytes).orderBy("item_id", "rank", "doc_id").collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    for i, q in enumerate(QUERIES):
        want = [(n + 1, *x) for n, x in enumerate(ranking(rows, q, k))]
        assert got[i] == ([x for x in want for _ in range(2)] if i == 0 else want), q


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "tree")], "item_id long, text string")
    assert lexical.search(lexical.build(empty), items).count() == 0
    assert lexical.search(lexical.build(docs), items.limit(0)).count() == 0
    assert lexical.search(lexical.build(docs.withColumn("text", F.lit(None).cast("string"))), items).count() == 0


def test_cuts_minimise_the_bound_error():
    """Against trying every way to cut a short list; whole multiples of 256, so nothing is rounded."""
    rng = random.Random(1)

    def error(values, ends, cost):
        return sum((b - a) * max(values[a:b]) - sum(values[a:b]) + cost for a, b in zip([0, *ends[:-1]], ends))

    for _ in range(60):
        n, cost, longest = rng.randrange(1, 9), rng.choice([0, 512, 5120]), rng.choice([2, 3, 9])
        values = [256 * rng.randrange(40) for _ in range(n)]
        ends = lexical.optimal_cuts(np.array([values + [0] * 3]), np.array([n]), cost, longest)[0]
        every = [[*(i + 1 for i in range(n - 1) if mask >> i & 1), n] for mask in range(1 << (n - 1))]
        legal = [e for e in every if all(b - a <= longest for a, b in zip([0, *e[:-1]], e))]
        assert ends in legal and error(values, ends, cost) == min(error(values, e, cost) for e in legal)


def test_blocks_below_the_bar_are_skipped(monkeypatch):
    """A bar above all but one document's bound leaves one block of each list to read."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 60))) for _ in range(400)]
    texts[77] = "needle " * 9 + "a"
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["doc_id", "text"])
    raw = list(lexical._postings(iter([batch]), 1 << 30))
    index = list(lexical._blocked(iter(raw), 400, sum(len(t.split()) for t in texts), lexical.BLOCK_COST, 16))
    shard = lexical.Shard(index[0].to_pylist()[0], {b"needle": 0, b"a": 1, b"b": 2})
    shard.open()
    weights = [(0, 5000), (1, 10), (2, 10)]
    docs, scores = lexical.best_of(shard, weights, 3, 0)
    assert docs[0] == 77
    read = []
    real = lexical._ranges
    monkeypatch.setattr(lexical, "_ranges", lambda first, size: read.append(int(size.sum())) or real(first, size))
    again, same = lexical.best_of(shard, weights, 3, int(scores[0]))
    assert again.tolist() == [77] and same[0] == scores[0] and read[-1] < len(shard.docs) // 10


def divergences(rows, least, top):
    groups, holding, counts = set(), collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        c = collections.Counter(LETTERS.findall((text or "").translate(LOW)))
        for t, n in c.items():
            holding[lang, t] += 1
            counts[lang, source, t] += n
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in holding.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        own = {s: [counts[lang, s, t] for t in kept] for s in sources}
        share = lambda c: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c]
        p = {s: share(own[s]) for s in sources}
        q = share([sum(own[s][i] for s in sources) for i in range(len(kept))])
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            best = [(f(a, b), t) for a, b, t, n in zip(p[s], q, kept, own[s]) if n > 0 and a > b]
            for part, found, most in (("pair", pairs, None), ("term", best, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order)}
    return out


@pytest.mark.parametrize(("dense", "slice_bytes", "shard_bytes"), [(0.5, 1 << 23, 1 << 23), (0.0, 2000, 3000), (2.0, 2000, 3000), (0.3, 1, 40_000)])
def test_divergence_is_exact_however_it_is_split(spark, texts, dense, slice_bytes, shard_bytes):
    rng = random.Random(4)
    rows = [(t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None])) for t in texts.values()] + [("x" * 9, "lone", "only"), ("p q", "xx", "r"), (None, "xx", "s")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("shard", F.lit("s")).repartition(3)
    got = divergence.audit(df, least=6, top=4, dense=dense, slice_bytes=slice_bytes, shard_bytes=shard_bytes).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == divergences(rows, 6, 4)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([("a b", "en", "x")], "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).count() == 0 and divergence.audit(df).count() == 0


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**9 + 7, 99_999_999_999_999])
    got = divergence.share(counts, np.int64(2 * 10**14), 12345)
    assert got.tolist() == [1 + 10**9 * (c + 2) // (2 * 10**14 + 2 * 12345) for c in counts.tolist()]


def removed(texts, length):
    """Bytes covered by a string of ``length`` bytes that starts twice."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return raw, out


def copied(rng, n):
    """Texts with shared passages, near copies, periods and copies inside one text."""
    base = ["".join(rng.choice("abcé \n") for _ in range(rng.randrange(20, 200))) for _ in range(n)]
    out = [*base, "", None, "abc" * 60, "x" * 150, base[0], base[0]]
    for _ in range(2 * n):
        parts = [rng.choice(base) for _ in range(rng.randrange(1, 4))]
        text = "".join(p[rng.randrange(len(p)) :] if rng.random() < 0.5 else p for p in parts)
        at = rng.randrange(len(text) + 1)
        out.append(text[:at] + rng.choice(["", "#", "z"]) + text[at:])
    return out


@pytest.mark.parametrize(("length", "seed", "many", "shard"), [(40, 8, 4096, 1 << 21), (24, 8, 1, 1 << 21), (24, 4, 3, 500), (9, 8, 1, 200), (64, 16, 2, 1 << 21)])
def test_repeats_are_those_of_counting_every_string(spark, length, seed, many, shard):
    texts = copied(random.Random(length * many), 25)
    rows = [(None if i % 11 == 0 else i % 50, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("at", F.lit(1)).repartition(4)
    got = repeats.remove(df, length, seed, many, shard).collect()
    raw, gone = removed(texts, length)
    want = []
    for (i, _), b, g in zip(rows, raw, gone, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0])))).reshape(-1, 2)
        want.append((i, bytes(np.frombuffer(b, np.uint8)[~g]), len(b), [tuple(e) for e in edges.tolist()]))
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, [tuple(s) for s in r.removed]) for r in got), key=order) == sorted(want, key=order)


def test_repeats_of_nothing(spark, empty):
    assert repeats.remove(empty).count() == 0
    one = spark.createDataFrame([(1, "x" * 399), (2, "x" * 399), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_bytes, len(r.removed)) for r in repeats.remove(one).collect()} == {(1, 399, 0), (2, 399, 0), (3, 0, 0)}


def test_maximal_repeats_hold_all_their_occurrences(spark):
    """Every group of occurrences can't be extended, and with its children has all places of its text."""
    texts = [t for t in copied(random.Random(8), 12) if t]
    length, seed = 30, 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, members = repeats.groups(df, length, seed)
    place = collections.defaultdict(list)
    for m in members.collect():
        place[m.core, m.whole].append((m.doc, m["at"]))
    # repeats are numbered within a task; here one task holds all of them
    rows, parent, size, text = found.collect(), {}, {}, {}
    own = collections.defaultdict(set)
    for r in rows:
        parent[r.repeat], size[r.repeat] = r.parent, r.length
        for doc, at in place[r.core, r.whole]:
            own[r.repeat].add((doc, at + r["at"]))
            text[r.repeat] = texts[doc].encode()[at + r["at"] :][: r.length]
    whole = collections.defaultdict(set)
    for k, spots in own.items():
        while k >= 0:
            whole[k] |= spots
            k = parent.get(k, -1)
    raw = [t.encode() for t in texts]
    nested = 0
    for k, spots in whole.items():
        assert size[k] >= length and len(spots) >= 2
        assert {raw[d][i : i + size[k]] for d, i in spots} == {text[k]}
        nested += parent[k] >= 0
        if parent[k] >= 0:
            assert size[k] > size.get(parent[k], 0)
    assert nested
