"""Quality rules: repetition rules and a hashed n-gram likelihood ratio against the raw corpus.

Words and word pairs are hashed into ``BUCKETS`` cells.  Two multinomials over the cells are
estimated, one from trusted documents and one from all documents; a document's score is the
mean log ratio over its n-grams, so that its length doesn't matter, and a document stays when
the score reaches the model's threshold.  No random draw is involved: the same document gets the
same verdict every time.

The corpus counts cover every document.  The classifier is fitted on a bounded sample of labelled
rows: at most ``TRUSTED`` of each quality, those of the smallest hashed ids, so their id list can
be broadcast.  Four fifths of those labelled 1 are the trusted documents.  The rest, which the
model hasn't seen, and those labelled 0 set the threshold: the cut that parts the two best, but no
higher than what all but ``LOST`` of the good ones reach.  Rows labelled both ways are left out.
Every task adds its documents' n-grams into arrays of ``BUCKETS`` counters before anything is
shuffled.

Nulls: a null text has no words; a null id is scored like any other and is never trusted.
Empty texts fail the length rule.  Repeated rows get a row each.  Without trusted documents, or
without good ones to set the threshold, the rules decide alone.  Extra columns are ignored by ``assess`` and kept
by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_words import Words, plain_texts, slices, words_of
from .common import mixed, shielded

BUCKETS = 1 << 16
TRUSTED = 20_000
LOST = 0.005
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def cells(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Cell and document of every word and every pair of neighbouring words."""
    h = mixed(words.hashes())[words.codes]
    doc = words.doc
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    second = mixed(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    every = np.concatenate((h, second)) >> np.uint64(48)
    return every.astype(np.int64), np.concatenate((doc, doc[pair]))


class Model(NamedTuple):
    """Log P(cell | trusted) - log P(cell | all documents) for each cell, and the least mean to stay."""

    weights: np.ndarray
    threshold: float


def sample(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """(doc_id, good, trusted) of at most ``most`` documents of each quality, in the order of their ids' hashes."""
    each = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    part = lambda q: each.where(F.col("hi") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    good = F.col("hi") == 1
    return part(1).unionByName(part(0)).select("doc_id", good.alias("good"), (good & (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) > 0)).alias("trusted"))


def ratios(docs: DataFrame, chosen: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """log P(cell | trusted) - log P(cell | all documents) for each of BUCKETS cells; ``chosen`` is a ``sample``."""
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen.where("trusted").select("doc_id", "trusted")), "doc_id", "left")  # the list is bounded by TRUSTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            cell, doc = cells(words_of(plain_texts(batch.column("text"))))
            mark = np.asarray(pc.fill_null(batch.column("trusted"), False).to_numpy(zero_copy_only=False)).astype(bool)
            raw += np.bincount(cell, minlength=BUCKETS)
            good += np.bincount(cell[mark[doc]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], names=["cell", "raw", "good"])

    rows = marked.select("text", "trusted").mapInArrow(count, "cell int, raw long, good long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.cell], good[r.cell] = r.raw, r.good
    if not good.any():
        return np.zeros(BUCKETS)
    # the trusted estimate backs off to the corpus with a weight of one count a cell, so that a
    # small trusted sample moves the ratios little and never pulls them all to one side
    common = (raw + alpha) / (raw.sum() + alpha * BUCKETS)
    return np.log((good + BUCKETS * common) / (good.sum() + BUCKETS)) - np.log(common)


def cut(good: np.ndarray, bad: np.ndarray, lost: float = LOST) -> float:
    """The score that parts good from bad best, but at most what all but the share ``lost`` of the good reach."""
    if not len(good):
        return -math.inf
    low = float(np.quantile(good, lost, method="lower"))
    if not len(bad):
        return low
    seen = np.unique(np.concatenate((good, bad)))
    at = np.append((seen[1:] + seen[:-1]) / 2, low)
    gain = np.searchsorted(np.sort(bad), at) / len(bad) - np.searchsorted(np.sort(good), at) / len(good)
    return min(float(at[gain >= gain.max() - 1e-12].min()), low)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of ``docs(doc_id, text)``: ratios of all of them, threshold of the labelled ones that pass the rules."""
    chosen = sample(labels)
    weights = ratios(docs, chosen)
    if not weights.any():
        return Model(weights, -math.inf)
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen.where("not trusted").select("doc_id", "good")), "doc_id")  # bounded as the sample is
    rows = _assessed(seen, Model(weights, 0.0)).where("not base_failed").groupBy("doc_id", "good").agg(F.max("llr").alias("llr")).collect()  # at most 2 * TRUSTED
    return Model(weights, cut(np.array([r.llr for r in rows if r.good]), np.array([r.llr for r in rows if not r.good])))


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def rules(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The base rules' figures of every text."""
    n = len(texts)
    raw = np.frombuffer(texts.cast(pa.large_binary()).buffers()[2] or b"", np.uint8)
    at = np.frombuffer(texts.cast(pa.large_binary()).buffers()[1], np.int64)[texts.cast(pa.large_binary()).offset :][: n + 1]
    raw, at = raw[at[0] : at[-1]], at - at[0]
    table = np.zeros((2, 256), bool)
    table[0, list(SYMBOLS)] = True
    table[1] = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters
    table[1, list(_SPACES)] = False

    lists = pc.split_pattern(texts, "\n")
    edges = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    edges, line = edges - edges[0], np.asarray(coded.indices).astype(np.int64)
    wordy = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary))).astype(np.int64) > 0
    owner = np.repeat(np.arange(n), np.diff(edges))[wordy[line]]
    key = owner * max(1, len(wordy)) + line[wordy[line]]
    lines, first = np.bincount(owner, minlength=n), np.bincount(np.unique(key) // max(1, len(wordy)), minlength=n)

    doc, w = words.doc, mixed(words.hashes())[words.codes]
    start = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    h = np.zeros(len(start), np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[start + k]
    h = mixed(h ^ mixed(doc[start].astype(np.uint64)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, start[twice], 1)
    np.add.at(edge, start[twice] + WINDOW, -1)
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": _per_doc(table[1][raw], at),
        "n_symbols": _per_doc(table[0][raw], at),
        "n_dup_lines": lines - first,
        "n_repeat_words": _per_doc(np.cumsum(edge[:-1]) > 0, words.bounds),
    }


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _assessed(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, ``text`` among them) with the figures, base_failed, llr and kept added."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in FIGURES), T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    shared, threshold = docs.sparkSession.sparkContext.broadcast(model.weights), model.threshold  # BUCKETS numbers

    def assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = plain_texts(batch.column("text"))
            words = words_of(texts)
            got = rules(texts, words)
            cell, doc = cells(words)
            n = batch.num_rows
            llr = np.bincount(doc, weights=shared.value[cell], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
            failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
            columns = [*batch.columns, *(pa.array(got[c].astype(np.int64)) for c in FIGURES), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(assess, schema)


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, the base rules' figures, base_failed, llr and the verdict ``kept``."""
    return _assessed(docs.select("doc_id", "text"), model).drop("text")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with their own columns only."""
    inner, restore = shielded(docs, "text")
    return restore(_assessed(inner, model).where("kept"))
