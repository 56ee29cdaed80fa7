"""Best-fit packing of token pieces into sequences by minimum bin slack.

Whether pieces fit together depends on their lengths alone, and there are at most
``capacity`` lengths.  So the work splits in two:

* the histogram of lengths, at most ``capacity`` rows whatever the corpus, goes to the
  driver, where minimum bin slack runs on counts: the largest length left opens a bin,
  a bitset subset-sum finds the fullest combination of the lengths left for the rest of
  it, and that combination is removed as often as the counts allow, which leaves some
  length too few for another one.  So there are at most capacity / length patterns a length;
* every piece gets its rank among the pieces of its length (counted per small bucket,
  so that a length a third of all pieces share is dealt over many tasks), and the rank
  alone says which bin of which pattern it fills and where.

Documents longer than ``capacity`` are cut into pieces of it, the last one shorter;
shorter ones stay whole.  Nulls: a null text is an empty document (only the end id); a
null document id is kept; ids are taken as longs.  Ties: pieces of equal length are ranked by document id, then
piece, then checksum.  Repeated rows are packed once each.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_words import slices
from .common import written
from .wordids import SLICE_BYTES, word_ids

BUCKET_ROWS = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack over lengths with multiplicities: (number of bins, length -> copies in each)."""
    left = {size: n for size, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    patterns = []
    while left:
        order = [size for size in order if size in left]
        seed = order[0]
        use = {seed: 1}
        room = capacity - seed
        reach, steps, full = 1, [], (1 << (room + 1)) - 1
        for size in order:
            if size > room or reach >> room & 1:
                continue
            copies, chunk = min(left[size] - (size == seed), room // size), 1
            while copies > 0 and not reach >> room & 1:
                chunk = min(chunk, copies)
                steps.append((reach, size, chunk))
                reach |= reach << size * chunk & full
                copies -= chunk
                chunk *= 2
        at = reach.bit_length() - 1
        for before, size, chunk in reversed(steps):
            if not before >> at & 1:
                use[size] = use.get(size, 0) + chunk
                at -= size * chunk
        bins = min(left[size] // n for size, n in use.items())
        for size, n in use.items():
            left[size] -= n * bins
            if not left[size]:
                del left[size]
        patterns.append((bins, use))
    return patterns


def seats(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, copies a bin, first bin, offset of the first copy)."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for bins, use in patterns:
        offset = 0
        for size, copies in use.items():
            rows.setdefault(size, []).append((taken.get(size, 0), copies, first, offset))
            taken[size] = taken.get(size, 0) + copies * bins
            offset += size * copies
        first += bins
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """``docs(doc_id, text)`` as token pieces of at most ``capacity`` ids (uint32, little endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        for batch in slices(batches, size=SLICE_BYTES):
            ids, ends = words.encode(batch.column("text"))
            at, rows = 0, []
            for doc, upto in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids[at:upto], end_id).astype("<u4")
                at = upto
                for p, start in enumerate(range(0, len(own), capacity)):
                    raw = own[start : start + capacity].tobytes()
                    rows.append((doc, p, start, len(raw) // 4, zlib.crc32(raw), raw))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pieces of ``docs`` with their place: sequence_id and offset (gapless from 0 in each sequence).

    Returns doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, vocabulary, end_id, capacity))
    histogram = {r.length: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = seats(fill_patterns(histogram, capacity))
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacity, not by the corpus
    buckets = spark.createDataFrame([(size, -(-n // BUCKET_ROWS)) for size, n in histogram.items()], "length long, buckets long")

    # each length gets buckets by its own number of pieces; the joined table has a row a length
    dealt = table.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).cast("int"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own_rank", F.row_number().over(own) - 1)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = ranked.join(sizes, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length, rank):
        import pandas as pd

        sizes, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for size in np.unique(sizes):
            here = sizes == size
            runs, r = shared.value[int(size)], ranks[here]
            first, copies, bins, start = runs[np.searchsorted(runs[:, 0], r, side="right") - 1].T
            sequence[here] = bins + (r - first) // copies
            offset[here] = start + (r - first) % copies * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("seat", seat("length", (F.col("earlier") + F.col("own_rank")).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "seat.sequence_id", "seat.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: sequence_id, ids, and the document of every piece in order (each group holds at most `capacity` ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
