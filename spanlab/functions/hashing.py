"""Stable hashes: the same draw in every engine and on every partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_index(key: Column, n: int | Column) -> Column:
    """First 8 bytes of sha256(key), big-endian, mod n."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    half = lambda at: F.conv(F.substring(F.sha2(key, 256), at, 8), 16, 10).cast("long")
    return (half(1) % n * (F.lit(1 << 32) % n) + half(9)) % n  # in whole numbers, n below 2**31


def index_counts(rows: DataFrame, key: Column, answers: dict[str, Column], n: int) -> DataFrame:
    """name, index, answer, n: how many rows have each answer of a name and each ``stable_index`` of "<key>|<name>".

    A batch of keys is hashed in Python, which takes less time than ``sha2`` on short texts, and counted before it leaves the task.
    """
    names = list(answers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                tail, given = f"|{name}".encode(), batch.column(i + 1).dictionary_encode(null_encoding="encode")
                first = np.frombuffer(b"".join([hashlib.sha256(k + tail).digest() for k in keys]), ">u8")[::4]
                size = len(given.dictionary)
                found = np.bincount(given.indices.to_numpy(zero_copy_only=False) * n + (first % n).astype(np.int64), minlength=size * n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (size * n)), pa.array(np.tile(np.arange(n), size)), given.dictionary.take(pa.array(np.repeat(np.arange(size), n))), pa.array(found)], names=["name", "index", "answer", "n"])

    made = rows.select(key.cast("binary"), *(a.cast("string").alias(f"a{i}") for i, a in enumerate(answers.values()))).mapInArrow(count, "name string, index long, answer string, n long")
    return made.groupBy("name", "index", "answer").agg(F.sum("n").alias("n")).where("n > 0")


def sha1_bucket(key: Column, n: int = 200) -> Column:
    """First 4 bytes of sha1(key) mod n."""
    return (F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") % n).cast("long")


def draw(seed: str, *keys: Column) -> Column:
    """Sort key of a seeded draw without replacement."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)), 256)


def unit(key: Column) -> Column:
    """A number in (0, 1] from the first 52 bits of sha256(key)."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
