import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom.llm import packing
from claimloom.llm.sharding import best_fit_decreasing
from claimloom.llm.tokens import public_path, tokenizer


def expected_pieces(docs, seq_len, end_id):
    tok, out = tokenizer(public_path()).tok, []
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, end_id], "<u4")
        for k in range(0, len(ids), seq_len):
            part = ids[k : k + seq_len]
            out.append((r["doc_id"], k // seq_len, k, len(part), zlib.crc32(part.tobytes())))
    return out


def check(docs, seq_len, parts=packing.PARTS):
    got = packing.pack(docs, seq_len=seq_len, end_id=0, parts=parts).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected_pieces(docs, seq_len, 0), key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(bins), sum(r["length"] for r in got)


@pytest.mark.parametrize("parts", [packing.PARTS, 1, 3])
def test_documents(documents, parts):
    used, total = check(documents, 2048, parts)
    assert used <= total / 2048 * (1.03 if parts > 3 else 1.15) + 1


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 64)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sum_of_squares_is_as_good_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 3000)
    runs, used = packing.sum_of_squares(np.bincount(sizes, minlength=101), 100)
    assert sum(runs.count) == 3000
    plain = max(b for _, b, _ in best_fit_decreasing(dict(Counter(sizes.tolist())), 100)) + 1
    assert used <= 1.01 * plain


@pytest.mark.parametrize("times", [1, 40, 3000])
def test_batches_lose_next_to_nothing(times):
    """The number of sequences is that of the items one by one, within a part of a thousand."""
    lengths = np.clip(np.random.default_rng(9).lognormal(4.0, 0.9, 2000).astype(int), 1, 255)
    counts = np.bincount(lengths, minlength=257) * times
    _, one_by_one = packing.sum_of_squares(counts if times < 100 else counts // times * 100, 256, parts=10**9)
    _, used = packing.sum_of_squares(counts, 256, parts=512)
    scale = times / 100 if times >= 100 else 1
    assert used <= 1.001 * one_by_one * scale + 1
    least = -(-int((counts * np.arange(257)).sum()) // 256)
    assert used >= least


def test_each_item_has_least_squares():
    """Against the rule written out."""
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(1, 20, 200).tolist(), reverse=True)
    runs, _ = packing.sum_of_squares(np.bincount(sizes, minlength=21), 20)
    assert set(runs.count) == {1} and list(runs.length) == sizes
    gaps, at = {}, {}
    for s, b, offset in zip(runs.length, runs.sequence, runs.offset, strict=True):
        open_ = defaultdict(int)
        for g in gaps.values():
            if g:
                open_[g] += 1

        def squares(g, s=s, open_=open_):
            n = dict(open_)
            n[g] = n[g] - 1
            if g > s:
                n[g - s] = n.get(g - s, 0) + 1
            return sum(x * x for x in n.values())

        fits = [g for g in open_ if g >= s]
        if fits:
            assert squares(gaps[b]) == min(map(squares, fits))
            assert gaps[b] == min(g for g in fits if squares(g) == squares(gaps[b]))
        else:
            assert b not in gaps
        assert offset == at.get(b, 0)
        at[b] = offset + s
        gaps[b] = gaps.get(b, 20) - s
