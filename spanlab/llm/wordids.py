"""Fast exact token ids from a public word-level BPE vocabulary.

The vocabulary file describes a pipeline that drops white space, so the ids of a
text are the ids of its white-space separated chunks, one after another.  That
makes every distinct chunk worth encoding only once per worker:

* Arrow splits a batch of texts into chunks and dictionary-encodes them;
* chunks not met before are encoded by the ``tokenizers`` library and cached;
* the batch is then assembled with array gathers, no Python loop over tokens.

Chunks written with ASCII and plain Latin-1 letters only are split into the
vocabulary's word pieces here (the split is fully determined on that alphabet)
and reach the library's BPE model directly; every other chunk goes through the
library's whole pipeline.  Both give the ids ``Tokenizer.encode`` gives
(`tests/llm/test_tokens.py` compares them).  The cache is emptied when it grows
past ``CACHE_CHUNKS``, so a worker's memory stays bounded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 600_000
SLICE_BYTES = 8 << 20
# How the public vocabulary splits words, and the byte alphabet of such vocabularies.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\n {_LETTERS}0-9]+")
_SENTINEL = "\x01"


def _byte_alphabet() -> dict[int, str]:
    """Visible stand-ins that byte-level vocabularies use for the 256 byte values."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class WordIds:
    """``encode(texts)`` gives the ids of all texts end to end and where each text's ids end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.direct = Tokenizer(self.full.model)
        self.direct.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [s.content for s in self.full.get_added_tokens_decoder().values()]
        vocab = self.full.get_vocab(with_added_tokens=False)
        self.dtype = np.uint16 if self.full.get_vocab_size() <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.bytemap = _byte_alphabet()
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool = np.zeros(0, self.dtype)
        self.at = np.zeros(1, np.int64)

    # -- encoding of chunks that were not met before ---------------------------------

    def _library(self, chunks: list[str]) -> list[np.ndarray]:
        got = self.full.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in got]

    def _pieces(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks end to end, and the number of ids of each."""
        pieces = _PIECES.findall("\n".join(chunks).lower())
        words = " ".join(p for p in pieces if p != "\n").encode().decode("latin-1").translate(self.bytemap_spaced())
        cut = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        texts, step, flat = words.split(" "), 2000, []
        for e in self.direct.encode_batch_fast([" ".join(texts[i : i + step]) for i in range(0, len(texts), step)], add_special_tokens=False):
            flat.append(np.array(e.ids, self.dtype))
        ids = np.concatenate(flat) if flat else np.zeros(0, self.dtype)
        per_piece = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(per_piece) != len(texts):
            raise ValueError("word pieces and ids do not line up")
        owner = np.cumsum(cut)[~cut]
        return ids, np.bincount(owner, weights=per_piece, minlength=len(chunks)).astype(np.int64)

    def bytemap_spaced(self) -> dict[int, str]:
        return {b: c for b, c in self.bytemap.items() if b != 0x20}

    def _learn(self, chunks: list[str]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if _PLAIN.fullmatch(c) and not any(s in c for s in self.special) else other).append(c)
        new, sizes = [], []
        if plain:
            ids, n = self._pieces(plain)
            new.append(ids)
            sizes.append(n)
        if other:
            got = self._library(other)
            new += got
            sizes.append(np.array([len(g) for g in got], np.int64))
        base = len(self.slot)
        self.slot.update(zip(plain + other, range(base, base + len(chunks)), strict=True))
        self.pool = np.concatenate([self.pool, *new]).astype(self.dtype, copy=False)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])

    # -- whole batches ---------------------------------------------------------------

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: Arrow strings, null as empty.  Returns (ids, end position of every text)."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.diff(sizes // SLICE_BYTES, prepend=0)).tolist()
        got = [self._encode(texts.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True) if b > a]
        if not got:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        before = np.cumsum([0, *(len(ids) for ids, _ in got[:-1])])
        return np.concatenate([ids for ids, _ in got]), np.concatenate([e + n for (_, e), n in zip(got, before, strict=True)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        if len(self.slot) + len(words) > CACHE_CHUNKS:
            self._clear()
        get = self.slot.get
        slots = [get(w, -1) for w in words]
        if -1 in slots:
            self._learn([w for w, s in zip(words, slots, strict=True) if s < 0])
            slots = [get(w) for w in words]
        if not len(codes):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        where = np.array(slots, np.int64)[codes]
        first, size = self.at[where], np.diff(self.at)[where]
        ends = np.cumsum(size)
        take = np.repeat(first - (ends - size), size) + np.arange(ends[-1])
        per_text = np.concatenate(([0], ends))[bounds[1:] - bounds[0]]
        return self.pool[take], per_text


_held: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own encoder of a vocabulary file; kept while the worker lives."""
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]
