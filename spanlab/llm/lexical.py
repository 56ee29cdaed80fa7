"""Ranked lexical search by variable-size block maxima.

``build`` indexes every document.  A shard is a slice of documents of about ``SHARD_BYTES`` of text;
its row holds, packed, the shard's terms, for each the documents it is in and how often, and the
documents' lengths.  Once the corpus's number of documents and mean length are known, a second pass
gives every posting its impact and cuts every posting list into blocks: dynamic programming over the list
finds the cuts that minimise the sum, over postings, of block maximum less impact, at ``BLOCK_COST`` a block
and at most ``LONGEST`` postings in one.

``search`` takes its queries in blocks of ``QUERY_BYTES``, so what the tasks are sent is bounded however many there
are.  On a shard, the weighted maxima of a query's blocks, summed over the documents they span, bound every
document's score; the sum changes at the starts and ends of blocks only, where a pivot would be moved.  The
documents of the highest bounds are scored first; then all those whose bound isn't below the k-th
best score.  Only blocks that span one of them are read, all others are skipped, and what is read is scored in full, so the result is exact.  Shards are searched in rounds, each about eight times
as large as all before it together: the k-th best score of a round is the bar of the next, so what all shards of a round return
is a few hundred rows a query, not k a shard.

A term's weight and a document's impact are whole numbers:

    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))
    impact = 10^9 tf div (1000 tf + 20 m),  m = 50 + (50 n N) div L

Nulls: a null text has no terms; a null item text finds nothing; documents of null id are ranked, behind all others of their score.
Repeated rows, of documents or items, count and are ranked each.  An empty table gives no rows.  A very long text is a
shard of its own.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_words import letters_of, plain_texts, release, slices, terms_of
from .blocks import from_planes, packed, planes, unpacked
from .common import written

LETTERS = letters_of("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SHARD_BYTES = 8 << 20
QUERY_BYTES = 1 << 20
BLOCK_COST = 400_000  # in units of impact, which is below 10^6
LONGEST = 64
ROUND = 8

POSTINGS = "place double, n_docs long, n_terms long, ids binary, lengths binary, terms binary, sizes binary, docs binary, counts binary"
BLOCKS = "place double, ids binary, terms binary, sizes binary, docs binary, impacts binary, cuts binary, block_sizes binary"
FOUND = "item long, doc_id long, score long"


@dataclass
class Index:
    """``shards``: a row a shard, with blocks; documents with a term, and terms of all of them."""

    shards: DataFrame
    documents: int
    terms: int
    number: int


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _postings(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row a shard: its postings by term, documents ascending."""
    for batch in slices(batches, size=size):
        words = terms_of(plain_texts(batch.column("text")), LETTERS)
        n, terms = batch.num_rows, len(words.dictionary)
        ids = batch.column("doc_id").to_pylist()
        key, count = np.unique(words.codes * n + words.doc, return_counts=True)
        term, doc = key // max(n, 1), key % max(n, 1)
        length = np.diff(words.bounds)
        place = xxhash.xxh64_intdigest(repr((ids[:1], ids[-1:], n)).encode() + length.tobytes()) / 2**64
        stored = np.array([[d or 0, d is None] for d in ids], np.int64).astype("<i8").tobytes()
        row = (place, int((length > 0).sum()), int(length.sum()), packed(stored), planes(length, 8), packed(b"\n".join(words.dictionary)), planes(np.bincount(term, minlength=terms), 4), planes(doc, 4), planes(count, 4))
        kinds = (pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["place", "n_docs", "n_terms", "ids", "lengths", "terms", "sizes", "docs", "counts"])


def optimal_cuts(lists: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST) -> list[list[int]]:
    """For each row of ``lists`` (impacts, of which ``sizes`` count) the ends of its blocks.

    best(i) is the least error of the first i postings: over the start j of the last block,
    best(j) + (i - j) * (its maximum) - (its sum) + cost.  All rows go through it side by side, with the
    ``longest`` last starts in a ring, at the precision of 256 units of impact.
    """
    n, wide = lists.shape
    values, cost = np.ascontiguousarray(lists.T >> 8).astype(np.int64 if wide > 1 << 18 else np.int32), cost >> 8
    top = np.zeros((longest, n), values.dtype)
    rest = np.full((longest, n), np.iinfo(values.dtype).max // 2, values.dtype)  # best(j) less the sum since
    width = np.zeros((longest, 1), values.dtype)
    start = np.zeros(longest, np.int64)
    tried = np.empty_like(rest)
    best, columns = np.zeros(n, values.dtype), np.arange(n)
    back = np.zeros((wide + 1, n), np.int32)
    for i in range(1, wide + 1):
        r = (i - 1) % longest
        top[r], rest[r], width[r], start[r] = 0, best, 0, i - 1
        used = slice(0, min(i, longest))
        np.maximum(top[used], values[i - 1], out=top[used])
        rest[used] -= values[i - 1]
        width[used] += 1
        np.multiply(top[used], width[used], out=tried[used])
        tried[used] += rest[used]
        pick = tried[used].argmin(axis=0)
        best = tried[pick, columns] + cost
        back[i] = start[pick]
    ends = []
    for k, size in enumerate(sizes.tolist()):
        own, at, chain = [], size, back[:, k]
        while at:
            own.append(at)
            at = int(chain[at])
        ends.append(own[::-1])
    return ends


def _cut_all(impacts: np.ndarray, sizes: np.ndarray, cost: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Block ends of every list, one after the other, and how many each list has; a list of one posting is a block, one without any has none."""
    first, ends = _starts(sizes), [None] * len(sizes)
    level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for k in np.unique(level[sizes > 1]).tolist():  # lists of like length side by side
        chosen = np.flatnonzero((level == k) & (sizes > 1))
        step = max(1, (1 << 22) // (1 << k))
        for own in (chosen[a : a + step] for a in range(0, len(chosen), step)):
            wide = int(sizes[own].max())
            at = first[own][:, None] + np.arange(wide)
            inside = np.arange(wide) < sizes[own][:, None]
            for j, e in zip(own.tolist(), optimal_cuts(np.where(inside, impacts[np.where(inside, at, 0)], 0), sizes[own], cost, longest), strict=True):
                ends[j] = e
    ends = [e or [1] * int(n) for e, n in zip(ends, sizes, strict=True)]
    return np.fromiter((x for e in ends for x in e), np.int64), np.fromiter(map(len, ends), np.int64, len(ends))


def _blocked(batches: Iterator[pa.RecordBatch], documents: int, terms: int, cost: int, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n, sizes = from_planes(r["lengths"], 8).astype(np.int64), from_planes(r["sizes"], 4).astype(np.int64)
            doc, tf = from_planes(r["docs"], 4).astype(np.int64), from_planes(r["counts"], 4).astype(np.int64)
            m = 50 + 50 * n * documents // max(terms, 1)
            impacts = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
            cuts, blocks = _cut_all(impacts, sizes, cost, longest)
            row = (r["place"], r["ids"], r["terms"], r["sizes"], r["docs"], planes(impacts, 4), planes(cuts, 4), planes(blocks, 4))
            kinds = (pa.float64(), *[pa.binary()] * 7)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["place", "ids", "terms", "sizes", "docs", "impacts", "cuts", "block_sizes"])
        release()


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block_cost: int = BLOCK_COST, longest: int = LONGEST) -> Index:
    """The index of ``docs(doc_id, text)``, written to the shared folder."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    raw = written(own.mapInArrow(lambda batches: _postings(batches, shard_bytes), POSTINGS))
    row = raw.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first()
    documents, terms = row[0] or 0, row[1] or 0
    return Index(written(raw.mapInArrow(lambda batches: _blocked(batches, documents, terms, block_cost, longest), BLOCKS)), documents, terms, row[2])


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - _starts(size)[:-1], size) + np.arange(size.sum())


class Shard:
    """One row of the index, opened for the terms asked for."""

    def __init__(self, row: dict, wanted: dict[bytes, int]):
        names = unpacked(row["terms"]).split(b"\n")
        self.row, self.at = row, {wanted[t]: k for k, t in enumerate(names) if t and t in wanted}
        self.sizes = from_planes(row["sizes"], 4).astype(np.int64)

    def open(self) -> None:
        stored = np.frombuffer(unpacked(self.row["ids"]), "<i8").reshape(-1, 2)
        self.ids, self.absent = stored[:, 0], stored[:, 1]
        self.docs, self.impacts, cuts, self.blocks = (from_planes(self.row[c], 4).astype(np.int64) for c in ("docs", "impacts", "cuts", "block_sizes"))
        self.block = _starts(self.blocks)  # of each term its first block
        stop = cuts + np.repeat(_starts(self.sizes)[:-1], self.blocks)
        self.first = np.concatenate(([0], stop[:-1])) if len(stop) else stop  # of each block its first posting
        self.size = stop - self.first
        self.begin, self.end = self.docs[self.first], self.docs[stop - 1]
        self.most = np.maximum.reduceat(self.impacts, self.first) if len(stop) else stop


def best_of(shard: Shard, weights: list[tuple[int, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard with score above 0 and not below ``bar``, at most ``k``, best first, and their scores.

    ``weights``: the query's terms and their weights.
    """
    found = scores = np.zeros(0, np.int64)
    bar = max(bar, 1)
    own = [(shard.at[t], w) for t, w in weights if t in shard.at]
    if not own:
        return found, scores
    term, w = np.array(own, np.int64).T
    block, weight = _ranges(shard.block[term], shard.blocks[term]), np.repeat(w, shard.blocks[term])
    # every list's block maximum over the documents its blocks span, summed by document
    rise = np.zeros(len(shard.ids) + 1, np.int64)
    np.add.at(rise, shard.begin[block], weight * shard.most[block])
    np.add.at(rise, shard.end[block] + 1, -weight * shard.most[block])
    bound = np.cumsum(rise)[:-1]
    open_ = np.flatnonzero(bound >= bar)
    if len(open_) > 4 * k:  # the most promising ones first, they raise the bar for the others
        head = np.argpartition(-bound[open_], 4 * k)[: 4 * k]
        parts = [np.sort(open_[head]), np.delete(open_, head)]
    else:
        parts = [open_]
    for part in parts:
        part = part[bound[part] >= bar]
        if not len(part):
            continue
        # only blocks that span one of these documents are read
        there = np.zeros(len(shard.ids) + 1, np.int64)
        there[part + 1] = 1
        there = np.cumsum(there)
        read = there[shard.end[block] + 1] > there[shard.begin[block]]
        posting = _ranges(shard.first[block[read]], shard.size[block[read]])
        total = np.zeros(len(shard.ids), np.int64)
        np.add.at(total, shard.docs[posting], np.repeat(weight[read], shard.size[block[read]]) * shard.impacts[posting])
        new = part[total[part] >= bar]
        found, scores = np.concatenate((found, new)), np.concatenate((scores, total[new]))
        keep = np.lexsort((shard.ids[found], shard.absent[found], -scores))[:k]
        found, scores = found[keep], scores[keep]
        if len(found) == k:
            bar = max(bar, int(scores[-1]))
    return found, scores


def _queries(block: list[tuple[int, str]]) -> tuple[list[bytes], list[list[int]]]:
    """The distinct terms of a block of items, and for each item its terms as places among them."""
    words = terms_of(pa.array([t for _, t in block], pa.string()), LETTERS)
    return words.dictionary, [np.unique(words.codes[a:b]).tolist() for a, b in zip(words.bounds, words.bounds[1:], strict=False)]


def _searched(index: Index, block: list[tuple[int, str]], k: int) -> list[DataFrame]:
    """Candidates of a block of items, round by round: the item's place in the block, doc_id, score."""
    names, asked = _queries(block)
    wanted = {name: t for t, name in enumerate(names)}

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(names), np.int64)
            for r in batch.to_pylist():
                shard = Shard(r, wanted)
                for t, place in shard.at.items():
                    n[t] += shard.sizes[place]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["term", "df"])

    df = index.shards.select("terms", "sizes").mapInArrow(frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the block
    weight = {r.term: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r.df + 1))) for r in df}
    queries = [[(t, weight[t]) for t in own if weight.get(t, 0) > 0] for own in asked]
    bars, found, past = [0] * len(block), [], 0.0
    while past < 1 and any(queries):
        upto = min(1.0, max(past * (ROUND + 1), ROUND / max(index.number, 1)))

        def search(batches: Iterator[pa.RecordBatch], bars: tuple[int, ...] = tuple(bars)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    shard, rows = Shard(r, wanted), []
                    shard.open()
                    for item, weights in enumerate(queries):
                        docs, scores = best_of(shard, weights, k, bars[item])
                        rows.append((np.full(len(docs), item), shard.ids[docs], shard.absent[docs] > 0, scores))
                    item, ids, absent, scores = (np.concatenate(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), pa.array(ids, mask=absent), pa.array(scores)], names=["item", "doc_id", "score"])
                release()

        part = index.shards.where((F.col("place") >= past) & (F.col("place") < upto))
        found.append(written(best(part.mapInArrow(search, FOUND), k)))
        reached = best(_union(found), k)
        for r in reached.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k).collect():  # a row an item of the block
            bars[r.item] = max(bars[r.item], r.bar)
        past = upto
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def best(rows: DataFrame, k: int, key: str = "item") -> DataFrame:
    """The ``k`` best rows of each item with their rank; first by parts of an item's rows, then of those."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = F.row_number().over(Window.partitionBy(key, F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.select(key, "doc_id", "score").withColumn("rank", part).where(F.col("rank") <= k).withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 50, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``queries(item_id, text)``: the ``k`` best documents of each: item_id, rank, doc_id, score."""
    spark = queries.sparkSession
    total = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // query_bytes))
    dealt = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    kind = queries.schema["item_id"].dataType.simpleString()
    out = []
    for b in range(n):
        block = [tuple(r) for r in dealt.where(F.col("_b") == b).select("item_id", "text").collect()]  # about query_bytes of text
        if block:
            parts = _searched(index, block, k)
            if parts:
                names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item long, item_id {kind}")
                out.append(best(_union(parts), k).join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return _union(out) if out else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
