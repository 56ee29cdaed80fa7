"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training windows.

A benchmark item gives a window for every run of ``n`` consecutive words, a shorter item one
window of all its words.  Training texts are scanned once, a row a word position: the hash of
the words from there on probes the windows' hashes, once for each size that windows have, and
a hit is kept when its words are the window's.  A row holds no copy of its text: positions
that meet no window are dropped where they are made.

The benchmark's windows are counted first.  Up to ``broadcast_windows`` of them are broadcast;
beyond that positions are shuffled as (id, hash of the text, start, hash of the window), nothing
wider, and the texts of those that meet a window are read again to verify them.

Nulls: a null text, of a document or an item, has no words and no hits.  Items without words
give no window.  Repeated document rows give a row each, repeated items count once by
item_id.  Empty tables give no rows or no hits.  Extra columns are ignored by ``hits`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded

BROADCAST_WINDOWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """The words of a lower-cased text, null as none."""
    line = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(line, " "), "")


def windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``benchmark(item_id, text)``, a row a distinct window: window (its words), size, hash, items (ids as strings)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).alias("i"))
    window = starts.select("item_id", F.slice("w", F.col("i"), n).alias("window"))
    # a passage of many items is one window
    return window.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select("window", F.size("window").alias("size"), F.xxhash64("window").alias("hash"), "items")


KEY = ("doc_id", "text_hash")


def places(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For every row of ``docs`` one row with ``n_words``, and a row for every occurrence of a window: doc_id, text_hash, n_words, start, size, items."""
    wanted = windows(benchmark, n)
    shape = wanted.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most n rows
    small = sum(r["n"] for r in shape) <= broadcast_windows

    # after the last word comes a null: its row stands for the document
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.concat(words_of(F.col("text")), F.array(F.lit(None).cast("string"))).alias("w"))
    each = texts.select(*KEY, "w", F.posexplode_outer("w").alias("start", "word"))
    ended = F.col("word").isNull()
    # words beyond the end are nulls, which the hash skips
    hashes = [F.xxhash64(*(F.get("w", F.col("start") + i) for i in range(r["size"]))) for r in sorted(shape, key=lambda r: r["size"])]
    probes = F.when(ended, F.lit(None)).otherwise(hashes[0]) if len(hashes) == 1 else F.explode_outer(F.when(~ended, F.array(*hashes))) if hashes else F.lit(None).cast("long")
    spots = each.select(*KEY, "w", "start", "word", probes.alias("hash"))
    count = F.when(ended, F.col("start")).cast("long").alias("n_words")
    if small:
        met = spots.join(F.broadcast(wanted), "hash", "left").where(ended | (F.slice("w", F.col("start") + 1, F.col("size")) == F.col("window")))
        return met.select(*KEY, count, F.when(~ended, F.col("start")).alias("start"), "size", "items")
    met = spots.where(~ended).select(*KEY, "start", "hash").join(wanted, "hash").select(*KEY, F.struct("start", "size", "window", "items").alias("s"))
    met = met.groupBy(*KEY).agg(F.collect_set("s").alias("spots")).toDF("_doc", "_text", "spots")  # at most the document's words times n
    rows = texts.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_text")), "left")
    true = F.filter("spots", lambda s: F.slice(F.col("w"), s["start"] + 1, s["size"]) == s["window"])
    rows = rows.select(*KEY, (F.size("w") - 1).cast("long").alias("n_words"), true.alias("spots"))
    hit = rows.where(F.size("spots") > 0).select(*KEY, F.explode("spots").alias("s")).select(*KEY, F.lit(None).cast("long").alias("n_words"), "s.start", "s.size", "s.items")
    return rows.select(*KEY, "n_words", *(F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in ("start", "size", "items"))).unionByName(hit)


def covered(spans: Column) -> Column:
    """Number of words inside sorted spans (start, size), overlaps once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        new = F.greatest(end - F.greatest(acc["upto"], s["start"]), F.lit(0))
        return F.struct((acc["n"] + new).cast("long").alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs(doc_id, text)``: one row each: doc_id, text_hash, n_words, spans, items, n_hit, contaminated.

    A document is contaminated when at least a twentieth of its words, and at least one, are hit.
    """
    found = places(docs, benchmark, n, broadcast_windows).groupBy(*KEY).agg(
        F.count("n_words").alias("_rows"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "size")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = found.select(*KEY, "n_words", "spans", "items", covered(F.col("spans")).alias("n_hit"), F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_row")).drop("_row")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, mode: str = "documents", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without its contaminated documents, or (mode "spans") without the hit words of all documents.

    In mode "spans" a removed word goes with the separators after it; other text stays as it is.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    docs, restore = shielded(docs, "doc_id", "text")
    each = docs.withColumn("_hash", F.xxhash64("text"))
    found = hits(docs.select("doc_id", "text"), benchmark, n, broadcast_windows)
    found = (found.where("contaminated") if mode == "documents" else found.where("n_hit > 0")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), F.col("spans").alias("_spans")).dropDuplicates(["_doc", "_text"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text"))
    if mode == "documents":
        return restore(each.join(found, same, "left_anti"))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", 0)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    parts = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    hit = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    left = each.join(found, same, "left").withColumn("_parts", F.when(F.col("_spans").isNotNull(), parts))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), hit), lambda i: F.get("_parts", i))
    return restore(left.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))))
