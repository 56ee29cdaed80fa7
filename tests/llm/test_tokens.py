"""Token ids, token files, packing."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanlab.llm import packing, token_files
from spanlab.llm.common import vocabulary_path
from spanlab.llm.wordids import WordIds, word_ids

ODD = ["aB", "é", "É", "ß", "ñ", "'s", "don't", "'", "0", "12", ".", "###", " ", " ", "中", "文", "é", "ǅ", "İ", "Σ", "ς", "ſ", "K", "½", "²", "ª", "<|endoftext|>", "\x01", "\x00", "\x1c", "\x85", "\n", "\t", "😀", "ﬁ", "Å", " ", "  "]


@pytest.fixture(scope="module")
def library():
    return WordIds(vocabulary_path()).full


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys(library, texts):
    rng = random.Random(1)
    cases = ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(3000)] + [t or "" for t in texts.values()]
    ids, ends = WordIds(vocabulary_path()).encode(pa.array(cases))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [ids_of(library, t) for t in cases]


def test_small_cache_changes_nothing(library, texts, monkeypatch):
    from spanlab.llm import wordids

    monkeypatch.setattr(wordids, "CACHE_CHUNKS", 10)
    monkeypatch.setattr(wordids, "SLICE_BYTES", 100)
    cases = [t or "" for t in texts.values()]
    ids, ends = WordIds(vocabulary_path()).encode(pa.array(cases))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [ids_of(library, t) for t in cases]


def test_files_round_trip(spark, docs, library, tmp_path):
    manifest = token_files.write_tokens(docs, vocabulary_path(), 2, str(tmp_path / "out"), shard_bytes=5000)
    assert manifest.count() > 3
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_tokens(manifest).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at, expected = 0, []
    for doc, text in rows:
        ids = [*ids_of(library, text), 2]
        expected.append((doc, at, ids))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    assert all((d1 is None) or (d2 is not None and d1 <= d2) for (d1, _, _), (d2, _, _) in zip(expected, expected[1:], strict=False))


def test_index_gives_any_record_and_damage_is_seen(spark, docs, library, tmp_path):
    row = token_files.write_tokens(docs.where("doc_id = 7"), vocabulary_path(), 2, f"file://{tmp_path}/one").first().asDict()
    row["data"] = row["data"].removeprefix("file://")
    width, ids, offsets, counts = token_files.read_index(row["index"])
    data = open(row["data"], "rb").read()
    record = token_files.unframe(memoryview(data), int(offsets[0]))
    text = docs.where("doc_id = 7").first().text
    assert np.frombuffer(record, f"<u{width}").tolist() == [*ids_of(library, text), 2] and ids.tolist() == [7] and counts.tolist() == [len(record) // width]
    for at in (0, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            token_files.unframe(memoryview(bytes(bad)), 0)


def test_empty_table(spark, empty, tmp_path):
    manifest = token_files.write_tokens(empty, vocabulary_path(), 2, str(tmp_path / "none"))
    assert manifest.count() == 0 and token_files.read_tokens(manifest).count() == 0
    assert packing.pack(empty, vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
    patterns = packing.fill_patterns(counts, 64)
    used = {}
    for bins, use in patterns:
        assert bins > 0 and sum(size * n for size, n in use.items()) <= 64
        for size, n in use.items():
            used[size] = used.get(size, 0) + n * bins
    assert used == counts and len(patterns) <= sum(64 // size for size in counts)


def best_fill(left, room):
    reach = {0}
    for size, n in left.items():
        for _ in range(n):
            reach |= {r + size for r in reach if r + size <= room}
    return max(reach)


def test_each_bin_is_the_fullest_there_is():
    rng = random.Random(9)
    counts = {rng.randint(1, 30): rng.randint(1, 5) for _ in range(8)}
    left = dict(counts)
    for bins, use in packing.fill_patterns(counts, 32):
        seed = max(size for size, n in left.items() if n)
        without = {size: n - (size == seed) for size, n in left.items()}
        assert sum(size * n for size, n in use.items()) == seed + best_fill(without, 32 - seed)
        for size, n in use.items():
            left[size] -= n * bins


def test_packing(spark, docs, library):
    capacity = 256
    rows = packing.pack(docs, vocabulary_path(), 1, capacity).collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*ids_of(library, r.text), 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            raw = np.array(ids[a : a + capacity], "<u4").tobytes()
            expected.append((r.doc_id, p, a, len(raw) // 4, zlib.crc32(raw), raw))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    assert sorted((tuple(r[:5]) + (bytes(r.ids),) for r in rows), key=key) == sorted(expected, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / capacity) + 2
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packing.pack(docs, vocabulary_path(), 1, capacity)).collect()}
    assert sum(whole.values()) == sum(r.length for r in rows)


def test_worker_keeps_its_encoder():
    assert word_ids(vocabulary_path()) is word_ids(vocabulary_path())
