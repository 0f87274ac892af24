import zlib

import numpy as np
import pytest

from claimloom.llm import token_files as T
from claimloom.llm.tokens import public_path, tokenizer


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 40000).astype(np.uint32) - 1 if n else np.zeros(0, np.uint32)
    lengths = T.code_lengths(np.bincount(ids, minlength=3))
    data = T.pack_block(np.array([7]), np.array([False]), np.array([n]), ids, T.canonical_codes(lengths), lengths)
    docs, null, n_ids, got = T.read_block(data, T.Decoder(lengths))
    assert got.tolist() == ids.tolist() and docs.tolist() == [7] and n_ids.tolist() == [n]


def test_lengths_are_limited_and_optimal():
    counts = np.array([1 << k for k in range(30)])
    got = T.code_lengths(counts, limit=8)
    assert got.max() <= 8 and sum(2.0 ** -int(x) for x in got) <= 1
    free = T.code_lengths(np.array([5, 1, 1, 2]), limit=20)
    assert free.tolist() == [1, 3, 3, 2]
    assert T.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]


def test_codes_are_prefix_free_in_canonical_order():
    lengths = T.code_lengths(np.arange(1, 200))
    codes = T.canonical_codes(lengths)
    words = sorted(format(int(c), f"0{n}b") for c, n in zip(codes, lengths, strict=True))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


def brute(docs, end_id):
    tok = tokenizer(public_path()).tok
    rows = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, end_id]) for r in docs.collect()]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, documents, monkeypatch, small):
    if small:
        monkeypatch.setattr(T, "BLOCK_IDS", 1000)
        monkeypatch.setattr(T, "FILE_IDS", 20000)
    got = {r["doc_id"]: tuple(r)[1:] for r in T.read(spark, T.write(documents, end_id=1)).collect()}
    at = 0
    for doc, ids in brute(documents, 1):
        assert got[doc] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows(spark, odd_docs, no_docs):
    got = T.read(spark, T.write(odd_docs, end_id=1), value="ids").collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=key) == sorted(brute(odd_docs, 1), key=key)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert T.read(spark, T.write(no_docs)).count() == 0
