"""White-space words of Arrow text batches as dense codes, positions and 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 3 << 20


@dataclass
class Words:
    """``codes[bounds[d]:bounds[d+1]]`` are document d's words as places in ``dictionary``."""

    codes: np.ndarray
    bounds: np.ndarray
    dictionary: list[bytes]

    @property
    def doc(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """64-bit hash of every dictionary word, the same in all tasks."""
        return np.fromiter(map(xxhash.xxh64_intdigest, self.dictionary), np.uint64, len(self.dictionary))


def plain_texts(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    texts = pc.fill_null(texts, "")
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of characters other than space and \\t to \\r; ``lower`` turns A-Z to a-z first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds, codes = bounds - bounds[0], np.asarray(coded.indices).astype(np.int64)
    dictionary = coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in dictionary:  # what a split leaves at the ends of a text
        kept = codes != dictionary.index(b"")
        bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
        codes = codes[kept]
    return Words(codes, bounds, dictionary)


def letters_of(spans: str) -> np.ndarray:
    """What each byte becomes when terms are runs of the ASCII characters in ``spans`` and of all others:
    itself, A-Z as a-z, a space where no term goes on."""
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    for c in spans.encode():
        table[c] = c + 32 if 0x41 <= c <= 0x5A else c
    return table


def terms_of(texts: pa.Array, letters: np.ndarray) -> Words:
    """Terms are the maximal runs of bytes that ``letters`` (of ``letters_of``) doesn't turn into a space."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2] if len(texts) else None
    plain = letters[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data else np.zeros(0, np.uint8)
    return words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(plain)))


def release() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task stays small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where about ``size`` bytes of text have come together; a row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        so_far = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        cuts = [0, *np.flatnonzero(np.diff(so_far // size, prepend=0)).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()
