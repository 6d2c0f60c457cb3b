"""Token ids, wavelet-matrix shards and packing against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import Placement, cut, pack_documents, plan_sequences
from tessera.llm.tokens import Encoder, ids_crc32, tokenizer_path
from tessera.llm.wavelet import Shard, build, read_shards, write_shards
from tests.llm.conftest import ODD_ROWS

ENCODER = Encoder(tokenizer_path())


def plain_ids(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab é1²\n\t '!,._-\x85\x1cß日\u00a0ªNO\r<|endoftext|>sžıɏ×÷µ½", max_size=60))
def test_chunks_never_change_the_ids(text):
    assert ENCODER.closed([text])[0].tolist() == plain_ids(text)


def test_memory_of_chunks_is_bounded():
    small = Encoder(tokenizer_path(), most_chunks=5)
    texts = [f"word{i} other{i}, third" for i in range(50)]
    assert [x.tolist() for x in small.closed(texts)] == [plain_ids(t) for t in texts]
    assert len(small) < 15


def test_wavelet_matrix_against_an_array():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 300, n).astype(np.uint32) ** 2 for n in (5, 0, 70000, 1, 200)]
    shard, tokens = Shard(build([1, None, 3, 4, 9], docs)), np.concatenate(docs)
    assert (shard.tokens() == tokens).all() and shard.doc_ids == [1, None, 3, 4, 9]
    for i in (0, 5, 65535, 65536, len(tokens) - 1):
        assert shard.access(i) == tokens[i]
    for token in (int(tokens[3]), int(tokens[-1]), 7):
        where = np.flatnonzero(tokens == token)
        for end in (0, 1, 65536, 70000, len(tokens)):
            assert shard.rank(token, end) == (where < end).sum()
        assert shard.count(token, 100, 66000) == ((where >= 100) & (where < 66000)).sum()
        for k in range(0, len(where), 37):
            assert shard.select(token, k) == where[k]
        with pytest.raises(IndexError):
            shard.select(token, len(where))
    with pytest.raises(IndexError):
        shard.access(len(tokens))


@pytest.mark.parametrize("lengths", [[], [0], [3], [1, 0, 2]])
def test_wavelet_matrix_of_little(lengths):
    docs = [np.full(n, 7, np.uint32) for n in lengths]
    shard = Shard(build(list(range(len(docs))), docs))
    assert shard.tokens().tolist() == [7] * sum(lengths)


def expected_tokens(rows):
    at, out = 0, []
    for doc_id, text in rows:
        ids = plain_ids(text)
        out.append((doc_id, at, len(ids), ids_crc32(np.array(ids))))
        at += len(ids)
    return out


def test_shards_round_trip(spark, documents):
    manifest = write_shards(documents, shard_tokens=20_000)
    assert manifest.count() > 3
    got = sorted(tuple(r) for r in read_shards(manifest).collect())
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    assert got == expected_tokens(rows)


def test_shards_of_odd_rows(odd, empty):
    got = read_shards(write_shards(odd, shard_tokens=10)).collect()
    want = sorted((plain_ids(r[1]) for r in ODD_ROWS), key=len)
    assert sorted(r["n_tokens"] for r in got) == [len(x) for x in want]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted((r[0] for r in ODD_ROWS), key=lambda k: (k is not None, k or 0))
    assert read_shards(write_shards(empty)).count() == 0


def test_cut_leaves_the_first_piece_short():
    assert [x.tolist() for x in cut(10, 4)] == [[0, 2, 6], [2, 4, 4]]
    assert [x.tolist() for x in cut(8, 4)] == [[0, 4], [4, 4]]
    assert [x.tolist() for x in cut(3, 4)] == [[0], [3]]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_places_every_piece_once(pieces):
    patterns = plan_sequences(pieces, 64)
    used = {}
    for pattern, times in patterns:
        assert sum(pattern) <= 64 and times > 0
        for length in pattern:
            used[length] = used.get(length, 0) + times
    assert used == pieces
    placement, taken = Placement(patterns, 64), set()
    for length, n in pieces.items():
        sequence, offset = placement.place(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            cells = {(s, o + k) for k in range(length)}
            assert o + length <= 64 and not taken & cells
            taken |= cells
    ends = {}
    for s, o in taken:
        ends[s] = max(ends.get(s, 0), o + 1)
    assert sum(ends.values()) == len(taken)  # no gaps


def test_plan_finds_exact_complements():
    assert len(plan_sequences({40: 5, 24: 5}, 64)) == 1
    assert sum(t for _, t in plan_sequences({40: 6, 20: 6, 4: 6}, 64)) == 6
    assert sum(t for _, t in plan_sequences({30: 8, 18: 8, 11: 8, 5: 8}, 64)) == 8
    many = {n: 1000 for n in range(1, 65)}
    total = sum(n * k for n, k in many.items())
    assert sum(t for _, t in plan_sequences(many, 64)) == -(-total // 64)


def check_packing(rows, texts, size=1024):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(r)
    want = []
    for doc_id, text in texts:
        ids = np.array(plain_ids(text))
        for piece, (start, length) in enumerate(zip(*cut(len(ids), size), strict=True)):
            want.append((doc_id, piece, int(start), int(length), ids_crc32(ids[start : start + length])))
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted((k for k, v in by_doc.items() for _ in v), key=key) == sorted(want, key=key)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= size
    return len(at), -(-sum(at.values()) // size)


def test_packing_of_documents(documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    used, least = check_packing(pack_documents(documents).collect(), texts)
    assert used <= 1.02 * least + 1


def test_packing_of_odd_rows(odd, empty):
    check_packing(pack_documents(odd).collect(), [r[:2] for r in ODD_ROWS])
    assert pack_documents(empty).count() == 0
