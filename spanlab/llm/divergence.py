"""How the sources of a language differ in their words.

``audit`` keeps, in each language, the terms that at least ``LEAST_DOCS`` of its documents hold, and
gives each group (language, source) and each language a smoothed whole-number share of every kept term,

    p = 1 + floor(SCALE * (count + 2) / (N + 2 V)),    f(p, q) = floor((p - q)^2 / (p + q)),

and sums f over the kept terms for every pair of sources of a language, and lists for every group the terms
it has more of than its language.

Counting is an exchange of packed arrays: a slice of documents sends each shard of the (language, term) hash range its terms
there with their groups and counts, so a shard has all there is of a term, whichever source holds a third of all rows.
A shard splits its terms.  Heavy ones, in at least ``DENSE`` of the language's groups, become a dense
tile of shares, terms by groups, and every pair of rows of it is summed directly.  Light ones are posting lists.
Were a light term in no group, a pair's sum would be that of the groups' floor shares p0, the same for every
light term; each posting corrects this against all other groups, once for every distinct share of a group, and each
pair of postings of one term corrects what the two corrections count twice.  The parts are whole numbers, so their sum
over the shards is exact.

Nulls: null text, language and source are ''.  A group without terms, or a language without kept terms, has its pairs all
the same (in the latter of value 0).  Repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_words import letters_of, plain_texts, release, slices, terms_of
from .blocks import from_planes, packed, planes, shard_bounds, unpacked
from .common import mixed, written

LETTERS = letters_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SLICE_BYTES = 8 << 20
SHARD_BYTES = 12 << 20
LEAST_DOCS = 10
TOP = 10
DENSE = 0.5  # share of a language's groups from which on a term is heavy
TILE = 512  # terms of a dense tile
_SPLIT = (31_250, 32_000)

SENT = "shard int, lang string, groups binary, terms binary, docs binary, sizes binary, owners binary, counts binary"
KEPT = "shard int, lang string, groups binary, terms binary, sizes binary, owners binary, counts binary, n_kept long"
MASS = "lang string, source string, n long"
PAIRS = "lang string, a string, b string, value long"
TERMS = "lang string, source string, item string, value long"


def _joined(names: list[str]) -> bytes:
    """Names as one value; lengths in front, so any character may be in them."""
    raw = [x.encode() for x in names]
    return packed(np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw))


def _names(data: bytes) -> list[bytes]:
    data = unpacked(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = (n + 1) * 8 + np.cumsum(np.frombuffer(data, "<i8", n, 8))
    return [data[a:b] for a, b in zip([(n + 1) * 8, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def _sent(batches: Iterator[pa.RecordBatch], shards: int, size: int) -> Iterator[pa.RecordBatch]:
    """For each language of a slice and each shard: its terms there, their documents, and counts by group."""
    for batch in slices(batches, size=size):
        words = terms_of(plain_texts(batch.column("text")), LETTERS)
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        lang, source = np.asarray(langs.indices).astype(np.int64), np.asarray(sources.indices).astype(np.int64)
        names, of = sources.dictionary.to_pylist(), words.doc
        hashes = mixed(words.hashes())
        rows = []
        for k, name in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(lang[of] == k)
            term, doc = words.codes[own], of[own]
            group_names, group = np.unique(source[doc], return_inverse=True)
            spread = mixed(hashes ^ np.uint64(xxhash.xxh64_intdigest(name)))
            order = np.argsort(spread, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            term = rank[term]
            pairs = np.unique(term * (batch.num_rows + 1) + doc) // (batch.num_rows + 1)  # a term once a document
            key, count = np.unique(term * max(len(group_names), 1) + group, return_counts=True)
            there, owner = key // max(len(group_names), 1), key % max(len(group_names), 1)
            docs, sizes = np.bincount(pairs, minlength=len(order)), np.bincount(there, minlength=len(order))
            used = np.flatnonzero(docs)
            bounds, post = shard_bounds(spread[order][used], shards), np.concatenate(([0], np.cumsum(sizes[used])))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[s], bounds[s + 1]
                p = slice(post[a], post[b])
                rows.append((s, name, _joined([names[g] for g in group_names]), packed(b"\n".join(words.dictionary[order[t]] for t in used[a:b])), planes(docs[used[a:b]], 4), planes(sizes[used[a:b]], 4), planes(owner[p], 4), planes(count[p], 4)))
        if rows:
            kinds = (pa.int32(), pa.string(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])


def _kept(table: pa.Table, least: int) -> pa.Table:
    """A shard's terms of one language that enough documents hold, with their postings by group."""
    release()
    rows = table.to_pylist()
    groups: dict[bytes, int] = {}
    terms: dict[bytes, int] = {}
    docs, keys, counts = [], [], []
    for r in rows:
        own_groups = np.fromiter((groups.setdefault(g, len(groups)) for g in _names(r["groups"])), np.int64)
        own_terms = np.fromiter((terms.setdefault(t, len(terms)) for t in unpacked(r["terms"]).split(b"\n")), np.int64)
        docs.append((own_terms, from_planes(r["docs"], 4)))
        keys.append(np.repeat(own_terms, from_planes(r["sizes"], 4)) << 32 | own_groups[from_planes(r["owners"], 4)])
        counts.append(from_planes(r["counts"], 4).astype(np.int64))
    held = np.zeros(len(terms), np.int64)
    for t, n in docs:
        np.add.at(held, t, n.astype(np.int64))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, at, np.concatenate(counts))
    kept = held >= least
    stay = kept[key >> 32]
    sizes = np.bincount(key[stay] >> 32, minlength=len(terms))[kept]
    names = [t for t, k in zip(terms, kept.tolist(), strict=True) if k]
    row = (rows[0]["shard"], rows[0]["lang"], _joined([g.decode() for g in groups]), packed(b"\n".join(names)), planes(sizes, 4), planes(key[stay] & 0xFFFFFFFF, 4), planes(count[stay], 8), len(names))
    kinds = (pa.int32(), pa.string(), *[pa.binary()] * 5, pa.int64())
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in KEPT.split(", ")])


def _mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of kept terms by group, shard by shard."""
    for batch in batches:
        for r in batch.to_pylist():
            names = [g.decode() for g in _names(r["groups"])]
            n = np.zeros(len(names), np.int64)
            np.add.at(n, from_planes(r["owners"], 4).astype(np.int64), from_planes(r["counts"], 8).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n)], names=["lang", "source", "n"])


def share(count: np.ndarray, mass: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (mass + 2 vocabulary)), exact for counts up to 10^14."""
    whole = mass + 2 * vocabulary
    high, rest = np.divmod((count + 2) * _SPLIT[0], whole)
    return 1 + high * _SPLIT[1] + rest * _SPLIT[1] // whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def dense_pairs(shares: np.ndarray) -> np.ndarray:
    """Sums of f over the rows of a tile (terms by groups), for every pair of columns."""
    n = shares.shape[1]
    out = np.zeros((n, n), np.int64)
    tile = np.ascontiguousarray(shares.T)
    for i in range(n):
        out[i, i + 1 :] = gap(tile[i], tile[i + 1 :]).sum(axis=1)
    return out + out.T


def sparse_pairs(term: np.ndarray, group: np.ndarray, p: np.ndarray, floor: np.ndarray, terms: int) -> np.ndarray:
    """The same for posting lists: ``group`` and share ``p`` of each posting, ascending by ``term``; groups not listed have their floor share."""
    n = len(floor)
    base = gap(floor[:, None], floor[None, :])
    out = base * terms
    one = np.zeros((n, n), np.int64)  # [g, h]: the postings of g, against h's floor
    pair, many = np.unique(group << 32 | p, return_counts=True)  # a share is below 2^31
    for g in np.unique(pair >> 32).tolist():
        own = pair >> 32 == g
        one[g] = ((gap((pair[own] & 0xFFFFFFFF)[:, None], floor[None, :]) - base[g]) * many[own][:, None]).sum(axis=0)
    np.fill_diagonal(one, 0)
    out += one + one.T
    size = np.diff(np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term)))
    first = np.repeat(np.cumsum(size) - size, size)
    for back in range(1, int(size.max(initial=1))):  # postings of one term that stand ``back`` apart
        b = np.flatnonzero(np.arange(len(term)) - first >= back)
        a = b - back
        x, y, gx, gy = p[a], p[b], group[a], group[b]
        both = gap(x, y) - gap(x, floor[gy]) - gap(floor[gx], y) + base[gx, gy]
        np.add.at(out, (gx, gy), both)
        np.add.at(out, (gy, gx), both)
    np.fill_diagonal(out, 0)
    return out


def _summed(kept: pa.Table, groups: pa.Table, top: int, dense: float, what: str) -> pa.Table:
    """Pair sums of a language's terms in one shard, or each group's best terms in it."""
    release()
    names, masses = groups.column("source").to_pylist(), np.asarray(groups.column("n")).astype(np.int64)
    by_pair: list[tuple] = []
    for r in kept.to_pylist():
        lang, v = r["lang"], groups.column("v")[0].as_py()
        terms, sizes = unpacked(r["terms"]).split(b"\n"), from_planes(r["sizes"], 4).astype(np.int64)
        place = {g: k for k, g in enumerate(names)}
        own = np.fromiter((place[g.decode()] for g in _names(r["groups"])), np.int64)
        group, count = own[from_planes(r["owners"], 4)], from_planes(r["counts"], 8).astype(np.int64)
        term, n = np.repeat(np.arange(len(sizes)), sizes), len(names)
        p = share(count, masses[group], v)
        if what == "terms":
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, term, count)
            q = share(total, np.int64(masses.sum()), v)[term]
            value, more = gap(p, q), p > q
            # dictionary order of the terms in bytes, which is that of code points
            rank = np.empty(len(terms), np.int64)
            rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
            order = np.lexsort((rank[term], -value, group))
            order = order[more[order]]
            start = np.flatnonzero(np.diff(group[order], prepend=-1))
            within = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            by_pair += [(lang, names[group[i]], terms[term[i]].decode(), int(value[i])) for i in order[within < top].tolist()]
            continue
        heavy = sizes >= max(2, dense * n)
        out = np.zeros((n, n), np.int64)
        floor = share(np.zeros(n, np.int64), masses, v)
        rows = np.flatnonzero(heavy)
        for a in range(0, len(rows), TILE):
            tile = np.tile(floor, (len(rows[a : a + TILE]), 1))
            spot = np.full(len(sizes), -1)
            spot[rows[a : a + TILE]] = np.arange(len(tile))
            inside = spot[term] >= 0
            tile[spot[term[inside]], group[inside]] = p[inside]
            out += dense_pairs(tile)
        light = ~heavy[term]
        out += sparse_pairs(term[light], group[light], p[light], floor, int((~heavy).sum()))
        i, j = np.nonzero(np.triu(out, 1))
        by_pair += [(lang, names[a], names[b], int(x)) for a, b, x in zip(i.tolist(), j.tolist(), out[i, j].tolist(), strict=True)]
    columns = list(zip(*by_pair, strict=True)) or [()] * 4
    schema = TERMS if what == "terms" else PAIRS
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, dense: float = DENSE, slice_bytes: int = SLICE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs(text, lang, source)``: lang, source, part, item, value, rank; parts are ``pair`` and ``term``."""
    own = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    shards = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    sent = own.mapInArrow(lambda batches: _sent(batches, shards, slice_bytes), SENT)
    kept = written(sent.groupBy("shard", "lang").applyInArrow(lambda t: _kept(t, least), KEPT))
    kept = kept.where("n_kept > 0")

    mass = kept.select("lang", "groups", "owners", "counts").mapInArrow(_mass, MASS).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.sum("n_kept").alias("v"))
    groups = own.select("lang", "source").distinct()
    groups = written(groups.join(mass, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    asked = written(kept.select("shard", "lang").join(groups, "lang"))  # a language's groups for each of its shards

    def summed(what: str, schema: str) -> DataFrame:
        return kept.groupBy("shard", "lang").cogroup(asked.groupBy("shard", "lang")).applyInArrow(lambda left, right: _summed(left, right, top, dense, what), schema)

    half = summed("pairs", PAIRS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a != b")
    pairs = every.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    terms = summed("terms", TERMS).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
