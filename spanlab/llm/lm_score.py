"""Language-model scores by a weighted backoff automaton.

The model is a trigram model with Dirichlet-smoothed backoff, counted from the training
documents (those whose crc32 of the id's digits leaves a remainder other than ``HELD`` on
division by ``FOLDS``):

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = (c(v w) + K p(w)) / (c(v) + K)
    p(w | u v) = (c(u v w) + L p(w | v)) / (c(u v) + L)

As an automaton: a state for every history of one or two words, with an arc for every n-gram seen
after it, weighted log10 p(w | history), and a failure arc weighted log10 K / (c(v) + K) or
L / (c(u v) + L) to the state of the history without its first word, down to the empty state,
whose arcs carry log10 p(w).  A text is read once from left to right: while the state has no arc
for the word, its failure arc is taken; the arc then taken leads to the state of the longest
history that ends in the word.  A text starts in a state of its own and ends with an end token.

The counts come from the exchange in ``blocks``: every block of documents asks for the
totals of the words (by the words themselves) and of the pairs and triples of words (by hashes,
kept to ``GRAM_BITS`` bits below their shard, at which one gram in some ten million shares its
count with another, at every size of the corpus) it holds and builds the part of the automaton that its texts can reach.  Nothing else is gathered, and what
is gathered follows the input.

Nulls: a null text is empty (its end token is scored); ids are taken as longs; a null id counts as the text "" in the
remainder rule.  Repeated rows are counted and scored each; an empty table gives no rows.
Without training documents N and V are 0 and every word is unknown.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import plain_texts, release, slices, words_of
from .blocks import ascending, blocked, counted, from_ascending, from_counted, packed, shard_bounds, shards_of, unpacked, within_shard
from .common import mixed

FOLDS, HELD = 5, 1
STRENGTH = (1500.0, 5.0)  # K and L, the best of ten settings on the held-out texts of a 10,000-document sample
GRAM_BITS = 44
_START = np.uint64(0x5851F42D4C957F2D)

ASKED = "shard int, block int, n_words int, words binary, word_counts binary, grams binary, gram_counts binary"
TOTALS = "block int, shard int, words binary, grams binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Block:
    """The token sequences of a block: words, ends, pairs and triples, and the sorted keys it asks about."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        words = words_of(plain_texts(table.column("text")), lower=True)
        n = len(self.ids)
        self.held = np.fromiter(_held(self.ids), bool, n)
        self.end = len(words.dictionary)
        self.names = [*words.dictionary, b""]
        length = np.diff(words.bounds) + 1
        self.stop = np.cumsum(length)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), length)
        first = self.stop - length
        ends = np.zeros(int(self.stop[-1]) if n else 0, bool)
        ends[self.stop - 1] = True
        self.token = np.full(len(ends), self.end, np.int32)
        self.token[~ends] = words.codes
        hashes = np.concatenate((mixed(words.hashes()), np.array([0], np.uint64)))
        step = np.uint64(0x9E3779B97F4A7C15)
        own = hashes[self.token]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[first] = _START
        pair = mixed(before * step + own)
        # a text's first token has no triple; its second one's begins at the start
        past = np.empty_like(own)
        past[1:] = pair[:-1]
        triple = mixed((past ^ np.uint64(0xD6E8FEB86659FD93)) * step + own)
        third = np.ones(len(own), bool)
        third[first] = False
        self.grams, at = np.unique(np.concatenate((pair, triple[third])), return_inverse=True)
        self.pair = at[: len(own)].astype(np.int32)
        self.triple = np.full(len(own), -1, np.int32)
        self.triple[third] = at[len(own) :]
        self.order = np.lexsort((np.array(self.names, object), hashes)) if len(np.unique(hashes)) < len(hashes) else np.argsort(hashes)
        self.hashes = hashes[self.order]

    def asked(self, block: int, shards: int) -> pa.Table:
        train = ~self.held[self.doc]
        words = np.bincount(self.token[train], minlength=self.end + 1)[self.order]
        grams = np.bincount(self.pair[train], minlength=len(self.grams)) + np.bincount(self.triple[train & (self.triple >= 0)], minlength=len(self.grams))
        names = [self.names[i] for i in self.order]
        w, g = shard_bounds(self.hashes, shards), shard_bounds(self.grams, shards)
        place = within_shard(self.grams, shards, GRAM_BITS)
        rows = [(s, block, w[s + 1] - w[s], packed(b"\n".join(names[w[s] : w[s + 1]])), counted(words[w[s] : w[s + 1]]), ascending(place[g[s] : g[s + 1]]), counted(grams[g[s] : g[s + 1]])) for s in range(shards) if w[s] < w[s + 1] or g[s] < g[s + 1]]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "block", "n_words", "words", "word_counts", "grams", "gram_counts"])


def _totals(table: pa.Table) -> pa.Table:
    """One shard: adds up what all blocks sent and answers each in its own order."""
    release()
    rows = table.to_pylist()
    known: dict[bytes, int] = {}
    names = [unpacked(r["words"]).split(b"\n") if r["n_words"] else [] for r in rows]
    for own, r in zip(names, rows, strict=True):
        for name, n in zip(own, from_counted(r["word_counts"]).tolist(), strict=True):
            known[name] = known.get(name, 0) + n
    grams = [from_ascending(r["grams"]) for r in rows]
    cuts = np.cumsum([len(g) for g in grams])[:-1]
    counts = np.concatenate([from_counted(r["gram_counts"]) for r in rows])
    keys = np.concatenate(grams)
    del grams
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.empty_like(counts)
    total[order] = np.repeat(np.add.reduceat(counts[order], new), np.diff(np.append(new, len(keys)))) if len(keys) else counts
    del keys, order
    answer = [(r["block"], r["shard"], counted(np.array([known[x] for x in own], np.int64)), counted(t)) for r, own, t in zip(rows, names, np.split(total, cuts), strict=True)]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*answer, strict=True), kinds, strict=True)], names=["block", "shard", "words", "grams"])


Arcs = list[float | None]


def traverse(triples: list[int], pairs: list[int], words: list[int], arcs: Arcs, unigram: list[float], failure: list[float], failure_1: list[float], start: float) -> float:
    """Log10 probability of one text in a single pass that carries the state, the pair and word before.

    ``arcs`` and ``failure`` are by pairs and triples (None and 0.0 where a gram wasn't seen),
    ``failure_1`` by words; ``start`` is the failure of the state in which a text starts.
    """
    total, fail_2, fail_1 = 0.0, 0.0, start
    for t, p, w in zip(triples, pairs, words, strict=True):
        arc = arcs[t] if t >= 0 else None
        if arc is None:
            total += fail_2
            arc = arcs[p]
            if arc is None:
                total += fail_1
                arc = unigram[w]
        total += arc
        fail_2, fail_1 = failure[p], failure_1[w]
    return total


def _scored(table: pa.Table, totals: pa.Table, tokens: int, vocabulary: int, strength: tuple[float, float]) -> pa.Table:
    release()  # what the worker's last task left
    block = Block(table)
    answers = sorted(totals.to_pylist(), key=lambda r: r["shard"])
    count = np.zeros(block.end + 1, np.int64)
    count[block.order] = np.concatenate([from_counted(r["words"]) for r in answers])
    seen = np.concatenate([from_counted(r["grams"]) for r in answers])
    p = (count + 0.5) / (tokens + 0.5 * (vocabulary + 1))
    unigram = np.log10(p)
    # the end token closes every training text, so its count is also the start state's
    history = np.append(count, count[block.end])
    failure_1 = np.log10(strength[0] / (history + strength[0]))
    failure = np.log10(strength[1] / (seen + strength[1]))
    before = np.concatenate(([block.end + 1], block.token[:-1]))
    first = np.concatenate(([0], block.stop[:-1]))
    before[first] = block.end + 1
    weight = np.zeros(len(block.grams))
    weight[block.pair] = (seen[block.pair] + strength[0] * p[block.token]) / (history[before] + strength[0])
    t = np.flatnonzero(block.triple >= 0)
    weight[block.triple[t]] = (seen[block.triple[t]] + strength[1] * weight[block.pair[t]]) / (seen[block.pair[t - 1]] + strength[1])
    arcs = [w if n else None for w, n in zip(np.log10(weight).tolist(), seen.tolist(), strict=True)]
    uni, fail_1, fail, known = unigram.tolist(), failure_1.tolist(), failure.tolist(), count > 0
    rows, a = [], 0
    for d, b in enumerate(block.stop.tolist()):
        own = block.token[a:b]
        rows.append((block.ids[d], bool(block.held[d]), b - a, int(known[own].sum()), tokens, math.fsum(unigram[own].tolist()), traverse(block.triple[a:b].tolist(), block.pair[a:b].tolist(), own.tolist(), arcs, uni, fail, fail_1, fail_1[block.end + 1])))
        a = b
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _held(ids: Iterable[int | None]) -> Iterator[bool]:
    return (zlib.crc32(("" if d is None else str(d)).encode()) % FOLDS == HELD for d in ids)


def training_size(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training documents: two numbers, from counts by word hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(plain_texts(batch.column("text")), lower=True)
            train = ~np.fromiter(_held(batch.column("doc_id").to_pylist()), bool, batch.num_rows)
            n = np.bincount(words.codes[train[words.doc]], minlength=len(words.dictionary))
            key = np.append(mixed(words.hashes())[n > 0], np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.append(n[n > 0], train.sum()))], names=["word", "n"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    row = own.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").agg(F.sum("n"), F.count("n")).first()
    return row[0] or 0, row[1]


def asked_of(table: DataFrame, n: int) -> DataFrame:
    """What ``n`` blocks ask of the shards: a row where a block has keys of a shard."""
    return table.groupBy("block").applyInArrow(lambda key, t: Block(t).asked(key[0].as_py(), shards_of(n)), ASKED)


def score(docs: DataFrame, strength: tuple[float, float] = STRENGTH, block_bytes: int | None = None) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table, n = blocked(docs, block_bytes) if block_bytes else blocked(docs)
    tokens, vocabulary = training_size(docs)
    totals = asked_of(table, n).groupBy("shard").applyInArrow(_totals, TOTALS)
    return table.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(lambda left, right: _scored(left, right, tokens, vocabulary, strength), SCORES)
