import random
import re

import numpy as np
import pytest

from claimloom.llm import near_duplicates as N
from claimloom.operators.components import components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(rows, n=5, threshold=0.8):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    sets = []
    for t in keys:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent, links = list(range(len(keys))), [0] * len(keys)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = {}
    for i, t in enumerate(keys):
        classes.setdefault(root(i), []).extend(d for d in texts[t] if d is not None)
    return [(d, min(classes[root(i)], default=None), links[i], len(texts[t])) for i, t in enumerate(keys) for d in texts[t]]


def near_copies(n, words=60, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((1000 + k, " ".join(own)))
    return out


@pytest.mark.parametrize("small", [64, 4])
def test_against_brute_force(spark, odd_docs, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)  # 4: many blocks of one component
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + near_copies(40) + near_copies(3, seed=2) + near_copies(5, words=9, seed=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, N.jaccard_join(docs).collect()))) == sorted(map(str, brute(rows)))


def test_keep_one(spark, odd_docs, no_docs, monkeypatch):
    got = N.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["1", "2", "None", "5", "6", "7", "7"])
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    assert N.keep_one(odd_docs).count() == 7
    assert N.jaccard_join(no_docs).count() == 0 and N.keep_one(no_docs).count() == 0


def test_bands_reach_the_recall():
    bands, rows = N.plan_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 192
    assert N.plan_bands(1.0, 0.99)[0] == 1
    with pytest.raises(ValueError):
        N.plan_bands(0.01, 0.9999, most_hashes=4)


def test_recall_next_to_the_threshold(spark):
    """Of 400 pairs with a Jaccard of 0.8 to 0.83 none is lost (planned: 0.04), nor any that brute force links."""
    rng, rows, pairs = random.Random(8), [], 0
    while pairs < 400:
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(60, 200))]
        other, grams = list(base), len(base) - 4
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(len(base))] = f"x{rng.randrange(10**7)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(grams)} for w in (base, other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.83:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = N.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["class_id"] != r["doc_id"] // 2 * 2 or r["n_links"] != 1 for r in got) == 0 and len(got) == 800


def test_hubs_and_copies_are_split(spark, monkeypatch):
    from claimloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_PARTS", 10)
    rows = near_copies(60) + [(i, "the same words stand in this text over and over again") for i in range(90)] + [(2000 + i, f"{i} alone") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, N.jaccard_join(docs).collect()))) == sorted(map(str, brute(rows)))


def test_rows_equal_in_id_and_text_keep_the_first(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, text, None), (2, text, "z")], "doc_id long, text string, source string")
    assert [tuple(r) for r in N.keep_one(docs).collect()] == [(1, text, "a")]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(5, 5), (None, 1), (1, 0), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("small", [64, 4])
def test_keep_one_keeps_one_of_each_brute_force_class(spark, odd_docs, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None]
    rows = list(enumerate(t for _, t in rows + near_copies(40) + near_copies(3, seed=2) + near_copies(5, words=9, seed=3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.keep_one(docs).collect()) == sorted({c for _, c, _, _ in brute(rows)})


@pytest.mark.parametrize("seed", range(30))
def test_fewer_pairs_connect_the_same(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(10**6, 40, replace=False) for _ in range(3)]
    sets = [np.unique(np.where(rng.random(40) < rng.choice([0, 0.05, 0.15]), rng.integers(0, 10**6, 40), base[k % 3])).astype(np.uint64) for k in range(rng.integers(2, 60))]
    sides = [(sets, None), (sets[::2], sets[1::2])]
    for left, right in sides:
        joined = []
        for pairs in (N._similar, N._connecting):
            shift = 0 if right is None else len(left)
            label = list(range(len(sets)))
            for i, partners in pairs(left, right, 0.8):
                for j in partners.tolist():
                    a, b = label[i], label[j + shift]
                    label = [min(a, b) if x in (a, b) else x for x in label]
            joined.append(label)
        assert joined[0] == joined[1]
