"""Exact n-gram Jaccard self-join and its connected components.

A document's set is its distinct 5-word shingles (as 64-bit hashes); two documents link at
``100 * |A & B| >= 75 * |A | B|``.  The join is a rare-first prefix join:

1. The exchange of ``blocks`` gives every shingle's document frequency, and every set the
   smallest id that has just the same set.  Frequencies are counted on 32 bits of the hash
   below the shard's own; that only has to be the same function everywhere, as any fixed order
   of the shingles makes the prefixes exact.  Equal sets are one node from here on.
2. A set of n shingles enters with its ``n - ceil(0.75 n) + 1`` rarest.  A shingle of
   frequency 1 joins nothing and isn't sent, so a document that shares none of its rare
   shingles costs nothing further.
3. Pairs that share a prefix shingle pass a length filter and, at their first common shingle, a
   positional filter, and are verified once each on the whole sets, behind a suffix filter that bounds the overlap by hash ranges.
   The set of a document that meets many is sent to several tasks, one for every ``GROUP`` of them.
4. Pairs are made in two rounds, not all within a shingle's list.  First every member is
   compared with the list's smallest member.  Lists whose members thereby fall into one
   component are done, as further links there can't change a component; in the others the
   pairs across components are made, a task for every ``GROUP`` of the smaller sets in the list.  So a group of thousands of near copies costs a
   comparison a member, and no link that joins components is lost.
5. Components by repeated hooking to the smallest neighbour and contraction.

Nulls: a null text has no shingles; ids are taken as longs; rows of null id are returned with their set's size and a
null component.  Texts of fewer than five words have one shingle, the whole; texts without
words have none and link with nothing.  Repeated rows give a row each.  Rows of equal id are one
document: where their texts differ, it links by its smallest set, and by any set that another
document has just as it is.  Extra columns are ignored by ``components`` and kept by ``distinct``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_words import plain_texts, release, words_of
from .blocks import ascending, blocked, counted, from_ascending, from_counted, shard_bounds, shards_of, within_shard
from .common import mixed, shielded, written

SHINGLE = 5
PERCENT = 75
GROUP = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)

ASKED = "shard int, block int, keys binary, counts binary, sets binary, ids binary"
TOTALS = "block int, shard int, counts binary, ids binary, same binary"
NODES = "doc_id long, n_shingles long, same long, keys array<long>, places array<int>, shingles binary"


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest overlap at which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class Sets:
    """Distinct shingles of a block's documents: ``shingle[start[d]:start[d+1]]``, ascending."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id")
        words = words_of(plain_texts(table.column("text")), lower=True)
        w, doc, n = mixed(words.hashes())[words.codes], words.doc, len(self.ids)
        size = np.diff(words.bounds)
        first = np.flatnonzero(doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
        h = np.zeros(len(first), np.uint64)
        for k in range(SHINGLE):
            h = h * _STEP + w[first + k]
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        whole = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = size[short] > k
            whole[more] = whole[more] * _STEP + w[words.bounds[short[more]] + k]
        h = mixed(np.concatenate((h, whole + size[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        owner = np.concatenate((doc[first], short))
        order = np.argsort(owner, kind="stable")  # two ascending runs
        h, owner = h[order], owner[order]
        ends = np.cumsum(np.bincount(owner, minlength=n)).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        self.shingle, self.owner = h[new], owner[new]
        self.size = np.bincount(self.owner, minlength=n)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.keys, self.at, self.count = np.unique(self.shingle, return_inverse=True, return_counts=True)
        self.valid = np.asarray(self.ids.is_valid()).astype(bool) if n else np.zeros(0, bool)
        self.number = np.asarray(self.ids.fill_null(0)).astype(np.int64) if n else np.zeros(0, np.int64)
        # sets by two sums of mixed shingles; only sets of documents that can link
        self.has = np.flatnonzero((self.size > 0) & self.valid)
        marks = np.zeros((len(self.has), 2), np.uint64)
        if len(self.has):
            full = np.flatnonzero(self.size > 0)
            spot = np.searchsorted(full, self.has)
            for j, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                marks[:, j] = np.add.reduceat(mixed(self.shingle ^ np.uint64(salt)), self.start[full])[spot]
        self.by_mark = np.lexsort((self.number[self.has], marks[:, 1], marks[:, 0]))
        self.marks = marks[self.by_mark]

    def asked(self, block: int, shards: int) -> pa.Table:
        k, m = shard_bounds(self.keys, shards), shard_bounds(self.marks[:, 0], shards)
        low = within_shard(self.keys, shards, 32)
        ids = self.number[self.has][self.by_mark]
        rows = []
        for s in range(shards):
            if k[s] < k[s + 1] or m[s] < m[s + 1]:
                rows.append((s, block, ascending(low[k[s] : k[s + 1]]), counted(self.count[k[s] : k[s + 1]] - 1), self.marks[m[s] : m[s + 1]].astype("<u8").tobytes(), ids[m[s] : m[s + 1]].astype("<i8").tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "block", "keys", "counts", "sets", "ids"])


def _totals(table: pa.Table) -> pa.Table:
    """One shard: frequency of each key and smallest id of each set, for every block in its own order."""
    release()
    rows = table.to_pylist()
    keys = [from_ascending(r["keys"]) for r in rows]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([from_counted(r["counts"]) + 1 for r in rows])
    total = np.bincount(at, weights=counts).astype(np.int64)[at] if len(at) else counts
    marks = np.concatenate([np.frombuffer(r["sets"], "<u8").reshape(-1, 2) for r in rows])
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows])
    order = np.lexsort((ids, marks[:, 1], marks[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (marks[order][1:] != marks[order][:-1]).any(axis=1)
    same = np.empty_like(ids)
    same[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else ids
    k = np.split(total, np.cumsum([len(x) for x in keys])[:-1])
    i = np.cumsum([len(r["ids"]) // 8 for r in rows])[:-1]
    answer = [(r["block"], r["shard"], counted(c - 1), a.astype("<i8").tobytes(), s.astype("<i8").tobytes()) for r, c, a, s in zip(rows, k, np.split(ids, i), np.split(same, i), strict=True)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*answer, strict=True), kinds, strict=True)], names=["block", "shard", "counts", "ids", "same"])


def _nodes(table: pa.Table, totals: pa.Table, percent: int) -> pa.Table:
    """A row a document: its size, the smallest id of its set, and, for one document a set, prefix and set."""
    release()  # what the worker's last task left
    sets = Sets(table)
    answers = sorted(totals.to_pylist(), key=lambda r: r["shard"])
    n = len(sets.size)
    same = np.where(sets.valid, sets.number, 0)
    frequency = np.zeros(0, np.int64)
    if answers:
        frequency = np.concatenate([from_counted(r["counts"]) + 1 for r in answers])
        if not np.array_equal(np.concatenate([np.frombuffer(r["ids"], "<i8") for r in answers]), sets.number[sets.has][sets.by_mark]):
            raise ValueError("a block's documents changed between its two readings")
        same[sets.has[sets.by_mark]] = np.concatenate([np.frombuffer(r["same"], "<i8") for r in answers])
    own = frequency[sets.at]
    prefix = sets.size - -(-percent * sets.size // 100) + 1
    node = sets.valid & (same == sets.number) & (sets.size > 0)
    # shingles of no other document come first in every set and aren't sent, so only the others are put in order
    some = np.flatnonzero(own > 1)
    order = some[np.lexsort((sets.shingle[some], own[some], sets.owner[some]))]
    owner = sets.owner[order]
    held = np.bincount(owner, minlength=n)
    place = sets.size[owner] - held[owner] + np.arange(len(order)) - (np.cumsum(held) - held)[owner]
    sent = node[owner] & (place < prefix[owner])
    keys, places, per = sets.shingle[order][sent].view(np.int64), place[sent].astype(np.int32), np.bincount(owner[sent], minlength=n)
    offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
    raw = [sets.shingle[sets.start[d] : sets.start[d + 1]].astype("<u8").tobytes() if per[d] else None for d in range(n)]
    columns = [sets.ids.combine_chunks() if isinstance(sets.ids, pa.ChunkedArray) else sets.ids, pa.array(sets.size), pa.array(same, mask=~sets.valid), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(places)), pa.array(raw, pa.binary())]
    return pa.table(columns, names=["doc_id", "n_shingles", "same", "keys", "places", "shingles"])


def asked_of(table: DataFrame, n: int) -> DataFrame:
    """What ``n`` blocks ask of the shards: a row where a block has keys or sets of a shard."""
    return table.groupBy("block").applyInArrow(lambda key, t: Sets(t).asked(key[0].as_py(), shards_of(n)), ASKED)


def nodes(docs: DataFrame, percent: int = PERCENT, block_bytes: int | None = None) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, n_shingles, same, and prefix keys, their places and the set of each node that may link."""
    table, n = blocked(docs, block_bytes) if block_bytes else blocked(docs)
    asked = asked_of(table, n)
    totals = asked.groupBy("shard").applyInArrow(_totals, TOTALS)
    return table.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(lambda left, right: _nodes(left, right, percent), NODES)


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Length filter, then positional filter: nothing before a pair's first common shingle is common.

    At the first common shingle the bound is largest, so a pair that passes at no common one can't link.
    """
    need = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    bound = 1 + F.least(na - 1 - pa_, nb - 1 - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bound >= need)


def overlap(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """|a & b| of ascending arrays, or -1 where a bound by hash ranges shows less than ``need``."""
    edges = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    parts = [np.diff(np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))) for x in (a, b)]
    if int(np.minimum(*parts).sum()) < need:
        return -1
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def spread(by: str, members: str | Column) -> Column:
    """A row's number among the tasks that share a key of so many members, ``GROUP`` a task."""
    return F.pmod(F.xxhash64(by), F.ceil(members / F.lit(GROUP)) if isinstance(members, Column) else F.ceil(F.col(members) / F.lit(GROUP))).cast("int")


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", tasks: int = 64) -> DataFrame:
    """``left`` joined with ``right``, which has a row a key; rows of a hot key of ``left`` are dealt over ``tasks`` by ``by``."""
    left = left.withColumn("_task", F.pmod(F.xxhash64(by), F.lit(tasks)).cast("int"))
    needed_ = left.select(key, "_task").distinct()  # at most ``tasks`` rows a key
    return left.join(needed_.join(right, key), [key, "_task"], how).drop("_task")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs(a, b, task)`` with whether they link; ``sets(doc_id, shingles)``.

    ``task`` deals the pairs of an ``a`` that has many; its set is sent once to each of its tasks.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                need = needed(len(p), len(q), percent)
                linked.append(overlap(p, q, need) >= need)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).join(pairs.select("a", "task").distinct(), "a")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, ["a", "task"]).select("a", "b", "x", "y").mapInArrow(check, "a long, b long, linked boolean")


def _sets(found: DataFrame) -> DataFrame:
    """The nodes' prefixes and sets, one of each id: of a repeated id always the smallest.

    Ids alone are counted; only the rows of repeated ones, as a rule none, are aggregated, so that who reads
    prefixes needs no sets and who reads sets doesn't sort them.
    """
    sets = found.where("shingles is not null").select("doc_id", "n_shingles", "keys", "places", "shingles")
    twice = written(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    if twice.isEmpty():
        return sets
    smallest = F.min(F.struct("n_shingles", "keys", "places", "shingles")).alias("s")
    chosen = sets.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(smallest).select("doc_id", "s.*")
    return written(sets.join(twice, "doc_id", "left_anti").unionByName(chosen))


def links(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between nodes that suffice for the components: (a, b), a < b.  ``found`` is a written ``nodes``."""
    sets = _sets(found)
    entry = F.explode(F.arrays_zip("keys", "places")).alias("e")
    entries = sets.select("doc_id", F.col("n_shingles").alias("n"), entry).select("doc_id", "n", F.col("e.keys").alias("key"), F.col("e.places").alias("at"))

    centre = F.min(F.struct("doc_id", "n", "at"))
    lists = entries.groupBy("key").agg(centre.alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", F.col("c.doc_id").alias("a"), F.col("c.n").alias("na"), F.col("c.at").alias("pa"), "members")
    star = entries.join(lists, "key").where((F.col("doc_id") != F.col("a")) & _may_link(F.col("na"), F.col("pa"), F.col("n"), F.col("at"), percent))
    star = star.groupBy("a", F.col("doc_id").alias("b")).agg(F.max("members").alias("members")).select("a", "b", spread("b", "members").alias("task"))
    star = written(verified(written(star), sets, percent))

    # members that no comparison has joined yet, list by list
    label = component_of(star.where("linked").select("a", "b"))
    named = entries.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    # the smaller set of a pair needs its common shingle earlier, as its overlap is at least that of two sets of its size
    early = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    mixed_lists = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.when(early, 1)).alias("members")).where("lo < hi and members > 0").select("key", "members")
    rest = named.join(mixed_lists, "key")
    left = rest.where(early).select("key", spread("doc_id", "members").alias("task"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("label").alias("la"))
    tasks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("members") / F.lit(GROUP)).cast("int") - 1)).alias("task")
    right = rest.select("key", tasks, F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("label").alias("lb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    across = left.join(right, ["key", "task"]).where(ordered & (F.col("la") != F.col("lb")) & _may_link(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent))
    across = across.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("task").alias("task")).join(star.select("a", "b"), ["a", "b"], "left_anti")
    across = written(across)
    return star.where("linked").select("a", "b").unionByName(verified(across, sets, percent).where("linked").select("a", "b"))


def component_of(edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest node each node of ``edges(a, b)`` is connected with."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    label = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("to"))
        # the hook's own hook: chains halve
        jump = spread_join(hook, hook.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "node", "left").select("node", F.coalesce("far", "to").alias("to"))
        jump = written(jump)
        label = jump.select(F.col("node").alias("doc_id"), F.col("to").alias("label")) if label is None else spread_join(label, jump.withColumnRenamed("node", "label"), "label", "doc_id", "left").select("doc_id", F.coalesce("to", "label").alias("label"))
        label = written(label)
        x, y = jump.select(F.col("node").alias("a"), F.col("to").alias("ta")), jump.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = spread_join(spread_join(edges, x, "a", "b"), y, "b", "a").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a < b").distinct()
        edges = written(moved)
        if edges.isEmpty():
            return label


def components(docs: DataFrame, percent: int = PERCENT, block_bytes: int | None = None) -> DataFrame:
    """``docs(doc_id, text)``, a row each: doc_id, n_shingles, component_id."""
    found = written(nodes(docs, percent, block_bytes))
    label = component_of(links(found, percent))
    each = found.select("doc_id", "n_shingles", "same")
    return spread_join(each, label.select(F.col("doc_id").alias("same"), "label"), "same", "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "same").alias("component_id"))


def distinct(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one whose id is the component's.

    Of several rows of that id the one of the smallest text stays, a null text only where none has
    another; rows of null id all stay.
    """
    docs, restore = shielded(docs, "doc_id", "text")
    found = components(docs.select("doc_id", "text"), percent).where("doc_id = component_id").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    kept = docs.where("doc_id is not null").join(found, "doc_id", "left_semi").withColumn("_first", first).where("_first = 1").drop("_first")
    return restore(docs.where("doc_id is null").unionByName(kept))
