"""Repeated passages by suffix arrays: every byte that a string of ``LENGTH`` bytes covers which starts twice.

Which texts have to meet is told by anchors.  Of the ``SEED``-byte strings in a window of ``LENGTH`` bytes the one
of least hash is the window's anchor, so equal windows have equal anchors at the same place in them.  An anchor owns
the windows it is the anchor of; these lie side by side, and the text they cover is its context.  Anchors whose seed
stands nowhere else in the corpus own no repeat and are dropped by counting; equal contexts go on as one, with their
number.  The contexts of a seed meet in one task, unless it has more than ``MANY`` different ones: then each is cut
into an eighth of its windows, keyed by what all windows of the eighth have in common, and so on, down to single
windows, which are equal or apart.  So no group is unbounded and none is left out.

A task builds enhanced suffix arrays over the owned windows of its contexts.  Equal windows stand at the same place
from their anchor, so suffixes are sorted place by place: from the anchor on directly, and one byte further to the
left by that byte and the order just found.  The longest common prefix of neighbours is what they share up to the
anchor and the least of the common prefixes between them from there on.  A scan with a stack walks the tree of the
common-prefix intervals of at least ``LENGTH`` bytes; an interval whose suffixes have different bytes before them, or
one of which starts its context, can't be extended to the left, so it is a maximal repeat, and all suffixes of the
interval are its occurrences, not only neighbours.  Maximal repeats of one place lie inside each other, so an
occurrence is returned with the longest, and each repeat with the next shorter one around it, its parent: a repeat's
occurrences are its own and its children's.  A repeat longer than a context comes in pieces that overlap.

``groups`` returns the maximal repeats, ``remove`` the documents without repeated bytes.  Nulls: a null text is empty;
rows of null id are documents; ids are taken as longs.  Repeated rows are occurrences of each other.  An empty table
gives no rows; texts shorter than ``LENGTH`` bytes have no window.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import plain_texts, release, slices
from .common import mixed, written

LENGTH = 400
SEED = 64
MANY = 4096
SHARD_BYTES = 4 << 20  # of contexts in a task's suffix arrays
STEP = 8  # parts into which the windows of a seed with many contexts are cut, level by level
SLICE_BYTES = 4 << 20

KEY = "doc long, digest long"
ANCHORS = f"{KEY}, at int, lo int, hi int, core long, whole long"
CONTEXT = "core long, whole long, many long, lo int, hi int, level int, text binary"
GROUPS = "core long, whole long, at int, length int, repeat int, parent int, n long"

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` (a power of two) bytes from each position on, by doubling."""
    h, wide = _BYTES[data], 1
    while wide < seed:
        h = h[:-wide] * (np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * wide)) + h[wide:]
        wide *= 2
    return mixed(h)


def least_in_window(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of ``wide`` keys from each position on."""
    have = 1
    while 2 * have <= wide:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (wide - have)], keys[wide - have :]) if have < wide else keys


def owned(data: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchors of all documents ``data[bounds[d]:bounds[d+1]]``: document, place, first and last window owned (places in ``data``)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    keys = seed_hashes(data, seed) & np.uint64(0xFFFFFFFF00000000)
    anchor = (least_in_window(keys | np.arange(len(keys), dtype=np.uint64), length - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= bounds[doc + 1])
    anchor, doc = anchor[inside], doc[inside]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    last = np.append(new[1:], len(anchor)) - 1
    return doc[new], anchor[new], inside[new], inside[last]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchors(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, size=SLICE_BYTES):
        texts = plain_texts(batch.column("text"))
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        doc, at, lo, hi = owned(data, bounds, length, seed)
        view = memoryview(np.ascontiguousarray(data))
        core = np.fromiter((digest(view[a : a + seed]) for a in at.tolist()), np.uint64, len(at)).view(np.int64)
        whole = np.fromiter((digest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
        take = pa.array(doc)
        small = lambda x: pa.array(x.astype(np.int32))
        # place in the document; windows from the anchor, so that equal contexts have equal numbers
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("digest").take(take), small(at - bounds[doc]), small(lo - at), small(hi - at), pa.array(core), pa.array(whole)], names=["doc", "digest", "at", "lo", "hi", "core", "whole"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The contexts a document stands for, cut from its text."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                rows.append((w["core"], w["whole"], w["many"], w["lo"], w["hi"], text[w["at"] + w["lo"] : w["at"] + w["hi"] + length]))
                if len(rows) == 4096:
                    yield _context_batch(rows)
                    rows = []
        if rows:
            yield _context_batch(rows)


def _context_batch(rows: list[tuple], level: int = 0) -> pa.RecordBatch:
    core, whole, many, lo, hi, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(whole, pa.int64()), pa.array(many, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([level] * len(rows), pa.int32()), pa.array(text, pa.binary())], names=["core", "whole", "many", "lo", "hi", "level", "text"])


def _widths(length: int, seed: int) -> list[int]:
    """How many windows a context may have, level by level, down to one."""
    out = [length - seed + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // STEP))
    return out


def _parts(batches: Iterator[pa.RecordBatch], length: int, wide: int, level: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut into parts of at most ``wide`` windows, at the same places from the anchor in all of them."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, parents = [], []
        for r in batch.to_pylist():
            for k in range(r["lo"] // wide, r["hi"] // wide + 1):  # windows k wide .. k wide + wide - 1 from the anchor
                first, last = k * wide, k * wide + wide - 1
                lo, hi = max(first, r["lo"]), min(last, r["hi"])
                cut = r["text"][lo - r["lo"] : hi - r["lo"] + length]
                shared = cut[last - lo : first + length - lo]  # what all windows of the part hold, owned here or not
                rows.append((_signed(digest(shared, seed=k & 0xFFFFFFFF)), _signed(digest(cut)), r["many"], lo, hi, cut))
                parents.append((r["core"], r["whole"]))
        if rows:
            out = _context_batch(rows, level)
            core, whole = zip(*parents, strict=True)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(core, pa.int64()), pa.array(whole, pa.int64())], names=[*out.schema.names, "from_core", "from_whole"])


class SuffixArrays:
    """Suffixes of aligned texts, sorted anew at each place, with the common prefixes of neighbours.

    ``texts`` are sorted by group and what stands right of the anchor, ``left`` tells how many bytes stand before it.
    Walked from the anchor to the left; texts that are too short drop out.
    """

    def __init__(self, texts: list[bytes], left: np.ndarray, group: np.ndarray):
        n = len(texts)
        self.left, self.group, self.n = left, group, n
        size = np.array([len(x) for x in texts])
        data, first = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1]
        column = np.arange(int((size - left).max()))
        inside = column < (size - left)[:, None]
        right = np.where(inside, data[np.where(inside, (first + left)[:, None] + column, 0)], 0)
        column = np.arange(1, int(left.max()) + 1)
        inside = column <= left[:, None]
        self.before = np.where(inside, data[np.where(inside, (first + left)[:, None] - column, 0)], 0)  # by distance from the anchor, less 1
        differ = right[1:] != right[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
        common = np.zeros(n, np.int64)
        common[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum((size - left)[1:], (size - left)[:-1])), 0)
        least = [common]  # least[k][i] is that of 2^k neighbours from i on
        while 2 ** len(least) < n:
            half, last = 2 ** (len(least) - 1), least[-1]
            least.append(np.minimum(last, np.append(last[half:], np.zeros(half, np.int64))))
        self.least = np.stack(least)
        self.rank = group.astype(np.int64)

    def step(self, back: int) -> None:
        """From ``back`` - 1 bytes before the anchor to ``back``: ranks by group, this byte, the ranks so far."""
        has = np.flatnonzero(self.left >= back)
        key = (self.group[has].astype(np.int64) << 8 | self.before[has, back - 1]) * self.n + self.rank[has]
        self.rank[has] = np.unique(key, return_inverse=True)[1]

    def sorted(self, some: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``some`` texts, ascending, their suffixes in order and what each has in common with the one before, 0 where that ends left of the anchor."""
        order = some[np.argsort(self.rank[some], kind="stable")]
        a, b = order[:-1], order[1:]
        same = self.rank[a] == self.rank[b]
        span = np.where(same, b - a, 1)
        level = np.frexp(span)[1] - 1  # floor of the logarithm
        start = np.where(same, a + 1, 0)
        least = np.minimum(self.least[level, start], self.least[level, start + span - (1 << level)])
        return order, np.concatenate(([0], np.where(same, back + least, 0)))


def maximal_repeats(common: list[int], before: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (first, last, length) of a suffix array whose common prefix of ``least`` or more can't be extended to the left.

    ``common[i]`` is that of suffixes i - 1 and i; ``before`` the byte before each, negative where it isn't known.
    The stack holds the open intervals: their length, first suffix, and the byte before all of them, or -1 when these differ.
    """
    stack: list[list[int]] = []
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        first, byte = i - 1, before[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            byte = byte if byte == own else -1
            if byte < 0:
                yield first, i - 1, length
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = byte if byte == stack[-1][2] else -1
            else:
                stack.append([now, first, byte])


def _solved(table: pa.Table, length: int) -> pa.Table:
    """The maximal repeats of a task's contexts: a row for every place that has one, with the longest."""
    release()
    seen: dict[tuple[int, int], dict] = {}
    for r in table.to_pylist():
        seen.setdefault((r["core"], r["whole"]), r)  # two equal rows of documents send a context twice
    rows = sorted(seen.values(), key=lambda r: (r["core"], r["text"][-r["lo"] :], r["whole"]))
    number = {c: np.array([r[c] for r in rows], np.int64) for c in ("core", "whole", "many", "lo", "hi")}
    sizes = np.array([len(r["text"]) for r in rows])
    group = np.cumsum(np.diff(number["core"], prepend=number["core"][0]) != 0)
    arrays = SuffixArrays([r["text"] for r in rows], -number["lo"], group)
    del seen, rows
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    labels = 0
    for back in range(int(-number["lo"].min()) + 1):
        if back:
            arrays.step(back)
        order, common = arrays.sorted(np.flatnonzero((number["lo"] <= -back) & (number["hi"] >= -back)), back)
        starts = np.flatnonzero((common < length) & (np.append(common[1:], 0) >= length))
        if not len(starts):
            continue
        # the byte before each suffix, negative where the context begins; where it is one byte throughout, the place before has the repeat
        before = np.where(number["lo"][order] < -back, arrays.before[order, min(back, arrays.before.shape[1] - 1)].astype(np.int64) if arrays.before.shape[1] else -1, -1)
        ends = np.flatnonzero((common >= length) & (np.append(common[1:], 0) < length))
        rims, padded = np.stack((starts, ends + 1), axis=1).reshape(-1), np.append(before, -1)
        low, high = np.minimum.reduceat(padded, rims)[::2], np.maximum.reduceat(padded, rims)[::2]
        diverse = (low < 0) | (low < high)
        for a, b in zip(starts[diverse].tolist(), ends[diverse].tolist(), strict=True):
            part = before[a : b + 1]
            found = sorted(maximal_repeats([0, *common[a + 1 : b + 1].tolist()], part.tolist(), length), key=lambda x: x[2])
            inner = np.full(b + 1 - a, -1)  # the longest repeat of each suffix
            parent, total, many = [], [], np.concatenate(([0], np.cumsum(number["many"][order[a : b + 1]])))
            for k, (x, y, _) in enumerate(found):  # outer ones first
                parent.append(labels + int(inner[x]) if inner[x] >= 0 else -1)
                total.append(int(many[y + 1] - many[x]))
                inner[x : y + 1] = k
            spot = np.flatnonzero(inner >= 0)
            k = inner[spot]
            for column, values in zip(columns, (order[a + spot], np.full(len(spot), -back), np.array([x[2] for x in found])[k], labels + k, np.array(parent)[k], np.array(total)[k]), strict=True):
                column.append(values)
            labels += len(found)
    where, places, lengths, repeat, parents, totals = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in columns)
    # a context that stands for several is a repeat as far as it goes
    alone = np.flatnonzero(number["many"] > 1)
    c = np.concatenate((where, alone))
    place = np.concatenate((places, number["lo"][alone]))
    size_of = np.concatenate((lengths, sizes[alone]))
    label = np.concatenate((repeat, labels + np.arange(len(alone))))
    above = np.concatenate((parents, np.full(len(alone), -1)))
    n = np.concatenate((totals, number["many"][alone]))
    small = lambda x: pa.array(x.astype(np.int32))
    return pa.table([pa.array(number["core"][c]), pa.array(number["whole"][c]), small(place), small(size_of), small(label), small(above), pa.array(n)], names=["core", "whole", "at", "length", "repeat", "parent", "n"])


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", tasks: int = 64) -> DataFrame:
    """``left`` joined with ``right``, which has few rows a key; ``left``'s rows of a hot key are dealt over ``tasks`` by ``by``."""
    left = left.withColumn("_task", F.pmod(F.xxhash64(by), F.lit(tasks)).cast("int"))
    right = left.select(*keys, "_task").distinct().join(right, keys)  # at most ``tasks`` rows a key
    return left.join(right, [*keys, "_task"], how).drop("_task")


def _found(contexts: DataFrame, length: int, widths: list[int], many: int, shard_bytes: int, level: int = 0) -> DataFrame:
    """Repeats of written contexts, by (core, whole); seeds with more than ``many`` contexts are cut finer."""
    groups = contexts.groupBy("core").agg(F.count(F.lit(1)).alias("different"), F.sum("many").alias("all")).where("all > 1").select("core", "different")
    live = dealt_join(contexts, groups, ["core"], "whole")
    hot = F.col("different") > many if level + 1 < len(widths) else F.lit(False)  # single windows of one key are equal
    total = contexts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    task = F.pmod(F.xxhash64("core"), F.lit(max(1, -(-total // shard_bytes)))).alias("task")
    found = written(live.where(~hot).select(task, "core", "whole", "many", "lo", "hi", "text").groupBy("task").applyInArrow(lambda t: _solved(t, length), GROUPS))
    if level + 1 == len(widths):
        return found
    split = live.where(hot).select("core", "whole", "many", "lo", "hi", "text").mapInArrow(lambda b: _parts(b, length, widths[level + 1], level + 1), f"{CONTEXT}, from_core long, from_whole long")
    split = written(split)
    if split.isEmpty():
        return found
    parts = written(split.groupBy("core", "whole").agg(F.sum("many").alias("many"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.lit(level + 1).alias("level"), F.first("text").alias("text")))
    deeper = _found(parts, length, widths, many, shard_bytes, level + 1)
    origin = split.select("core", "whole", "from_core", "from_whole")
    back = dealt_join(origin, deeper, ["core", "whole"], "from_whole").select(F.col("from_core").alias("core"), F.col("from_whole").alias("whole"), "at", "length", "repeat", "parent", "n")
    return found.unionByName(back)


def _own(docs: DataFrame) -> DataFrame:
    """Documents with their key: rows of equal id and text are one document that is there twice."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))


def groups(docs: DataFrame, length: int = LENGTH, seed: int = SEED, many: int = MANY, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repeats of ``docs(doc_id, text)`` by context, and the contexts' places.

    The first: core, whole (the context), at (from the anchor), length, repeat, parent (numbers within a core) and n, the occurrences.
    The second: doc, digest, at (of the anchor), lo, hi (its windows), core, whole.  Both are written.
    """
    own = _own(docs)
    anchors = written(own.select("doc", "digest", "text").mapInArrow(lambda batches: _anchors(batches, length, seed), ANCHORS))
    shared = anchors.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("core")
    members = written(dealt_join(anchors, shared, ["core"], "digest"))
    nodes = members.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("doc", "digest", "at", "lo", "hi")).alias("rep"))
    wanted = nodes.select("rep.doc", "rep.digest", F.struct("core", "whole", "many", "rep.at", "rep.lo", "rep.hi").alias("w")).groupBy("doc", "digest").agg(F.collect_list("w").alias("wanted"))
    contexts = written(own.select("doc", "digest", "text").join(wanted, ["doc", "digest"]).select("text", "wanted").mapInArrow(lambda batches: _contexts(batches, length), CONTEXT))
    return _found(contexts, length, _widths(length, seed), many, shard_bytes), members


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            kept, sizes, runs = [], [], []
            for text, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                own = _merged(spans or [])
                bounds = [0, *[x for s in own for x in s], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                sizes.append(len(text))
                runs.append([{"a": a, "b": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, kind)], names=["doc_id", "kept", "n_bytes", "removed"])


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED, many: int = MANY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, kept (the bytes that stay), n_bytes, removed (maximal runs a to b, bytes of the text)."""
    found, members = groups(docs, length, seed, many, shard_bytes)
    spans = found.groupBy("core", "whole").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("b")))).alias("s"))
    joined = lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x)))
    spans = spans.select("core", "whole", F.aggregate("s", F.array().cast("array<struct<a:int,b:int>>"), joined).alias("s"))
    placed = dealt_join(members, spans, ["core", "whole"], "digest").select("doc", "digest", F.transform("s", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b"))).alias("s"))
    by_doc = placed.groupBy("doc", "digest").agg(F.flatten(F.collect_list("s")).alias("spans"))
    own = _own(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.join(by_doc, ["doc", "digest"], "left").select("doc_id", "text", "spans").mapInArrow(_removed, f"doc_id {kind}, kept binary, n_bytes long, removed array<struct<a:int,b:int>>")
