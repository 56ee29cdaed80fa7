"""Corpus-wide counts by an exchange of packed arrays.

Documents are dealt into blocks of about ``BLOCK_BYTES`` of text by the hash of their id and text.
A block sends each shard the keys (hashes) it holds there with its own counts, sorted and packed,
one row a shard; the shard adds up the counts of all blocks and answers every block with the
totals of just the keys it sent, in the order sent.  So no table of counts is ever held whole
by the driver or a task, no key is sent more than once by a block however often it occurs
there, and both sides of the exchange grow with the input.

Shards are sized by what one may hold, ``SHARD_BLOCKS`` blocks' keys, and a row is sent only where
a block has keys of the shard.  So there are never more rows than keys: where there are so many
shards that a row holds one key, the exchange is the plain shuffle by key, pre-aggregated by block.

A block is read twice, when it asks and when it uses the answers.  It is the same set of
documents both times, and what is asked is sorted, so the order in which rows arrive doesn't
matter, nor does a lost executor: any task can be run again.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
SHARD_BLOCKS = 2


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs(doc_id, text)`` with a block number, null text as empty, and how many blocks there are.

    The text takes part in the dealing, so that rows of null or equal id are dealt over the blocks too.
    """
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    where = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    return docs.select(where, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), n


def shards_of(blocks: int) -> int:
    """How many shards the keys of so many blocks take."""
    return max(1, -(-blocks // SHARD_BLOCKS))


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes begins and the last ends: shards split the hash range evenly."""
    starts = np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(hashes, starts), len(hashes))


def within_shard(hashes: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """The place of hashes in their shard's range, to so many bits; it ascends with the hash."""
    return hashes * np.uint64(shards) >> np.uint64(64 - bits)


def packed(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as byte planes, so that high bytes lie together and compress away."""
    return packed(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def from_planes(data: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(unpacked(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(flat.T).view(f"<u{width}").reshape(-1)


def ascending(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as the planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)), 8)


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 8), dtype=np.uint64)


def counted(values: np.ndarray) -> bytes:
    return planes(values, 8)


def from_counted(data: bytes) -> np.ndarray:
    return from_planes(data, 8).astype(np.int64)
