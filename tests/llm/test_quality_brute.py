"""The classifier against the same rules in plain Python, number by number."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import quality as Q

STOP = set(b".,;:'\"()-?")
GAP = {9, 10, 13, 32}


def is_mark(b):
    word = 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123
    return b < 128 and not word and b not in GAP and b not in STOP


def plain_measures(text):
    raw = (text or "").encode()
    size = max(len(raw), 1)
    count = lambda f, part=raw: sum(1 for b in part if f(b))
    upper, lower = (lambda b: 65 <= b < 91), (lambda b: 97 <= b < 123)
    words = [bytes(w) for w in raw.replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
    n = max(len(words), 1)
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    run = best = 1 if words else 0
    for same in again:
        run = run + 1 if same else 1
        best = max(best, run)
    shouted = marked = 0
    lines = raw.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    if words:
        for x in lines:
            capitals = count(upper, x)
            shouted += len(x) if 2 * capitals > max(capitals + count(lower, x), 1) else 0
            marked += len(x) if 20 * count(is_mark, x) > len(x) else 0
    return [
        math.log1p(len(raw)), count(upper) / max(count(upper) + count(lower), 1), count(is_mark) / size, count(lambda b: 48 <= b < 58) / size, count(lambda b: b >= 128) / size,
        raw.count(b"\n") * 1000 / size, sum(map(len, words)) / n, len(set(words)) / n, sum(again) / n, math.log1p(max(best - 1, 0)), sum(is_mark(w[-1]) for w in words) / n,
        shouted / size, marked / size,
    ]


def gain_of(parts, ridge):
    return sum(sum(g for g, _ in p) ** 2 / (sum(h for _, h in p) + ridge) for p in parts)


def best_cut(rows, ridge, least):
    """(gain, cut) of a list of bins, each a list of (g, h)."""
    best = (0.0, -1)
    every = [x for b in rows for x in b]
    for k in range(1, len(rows)):
        left, right = [x for b in rows[:k] for x in b], [x for b in rows[k:] for x in b]
        if len(left) >= least and len(right) >= least:
            gain = gain_of([left, right], ridge) - gain_of([every], ridge)
            if best[1] < 0 or gain > best[0] + 1e-12:
                best = (gain, k)
    return best


def value(rows, ridge):
    every = [x for b in rows for x in b]
    return sum(g for g, _ in every) / (sum(h for _, h in every) + ridge)


def plain_tree(rows, leaves, ridge, least):
    parts = [(0, len(rows))]
    while len(parts) < leaves:
        cuts = [(*best_cut(rows[a:b], ridge, least), i) for i, (a, b) in enumerate(parts) if b - a > 1]
        gain, k, i = max(cuts, default=(0.0, -1, 0))
        if gain <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, a + k), (a + k, b)]
    out = [0.0] * len(rows)
    for a, b in parts:
        out[a:b] = [value(rows[a:b], ridge)] * (b - a)
    return out


def plain_fit(x, y, edges, rounds, rate, leaves, ridge, least):
    """Tables of the one-feature rounds, and each row's sum."""
    bins = [[sum(v >= e for e in edge) for v in col] for col, edge in zip(zip(*x, strict=True), edges, strict=True)]
    tables = [[0.0] * (len(e) + 1) for e in edges]
    share = sum(y) / len(y)
    z = [math.log(share / (1 - share))] * len(y)
    for _ in range(rounds):
        for j, table in enumerate(tables):
            rows = [[] for _ in table]
            for i, b in enumerate(bins[j]):
                p = 1 / (1 + math.exp(-z[i]))
                rows[b].append((y[i] - p, p * (1 - p)))
            step = [rate * v for v in plain_tree(rows, leaves, ridge, least)]
            tables[j] = [a + b for a, b in zip(table, step, strict=True)]
            z = [a + step[b] for a, b in zip(z, bins[j], strict=True)]
    return tables, z


def test_measures(documents, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + [r["text"] for r in documents.limit(150).collect()] + ["A\n\nB!! #$%\n", "\n", "é É\tx\r\n"]
    got = Q.measures(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_measures(t) for t in texts], rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_tables_of_cyclic_boosting(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=90) * 0.3 > 0).astype(float)
    options = {"rounds": 6, "rate": 0.2, "leaves": 3, "ridge": 1.0, "least": 4}
    model = Q.fit(x, y, bins=8, pair_rounds=0, n_pairs=0, **options)
    tables, z = plain_fit(x.tolist(), y.tolist(), [e.tolist() for e in model.edges], **options)
    for a, b in zip(model.tables, tables, strict=True):
        assert np.allclose(a, b, atol=1e-9)
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in z], atol=1e-9)


def test_a_pair_step_is_the_best_tree_of_two_cuts():
    rng = np.random.default_rng(5)
    g, h, n = rng.normal(size=(5, 4)), rng.uniform(0.1, 1, (5, 4)), np.full((5, 4), 3.0)
    gain, plane = Q._plane(g, h, n, 1.0, 3)

    def leaf(area):
        return g[area].sum() / (h[area].sum() + 1.0)

    def score(areas):
        return sum(g[a].sum() ** 2 / (h[a].sum() + 1.0) for a in areas)

    every = (slice(None), slice(None))
    first = [((slice(0, k), every[1]), (slice(k, None), every[1])) for k in range(1, 5)] + [((every[0], slice(0, k)), (every[0], slice(k, None))) for k in range(1, 4)]
    halves = max(first, key=score)
    areas = []
    for rows, cols in halves:
        r, c = range(*rows.indices(5)), range(*cols.indices(4))
        cuts = [((slice(r.start, k), cols), (slice(k, r.stop), cols)) for k in r[1:]] + [((rows, slice(c.start, k)), (rows, slice(k, c.stop))) for k in c[1:]]
        two = max(cuts, key=score, default=None)
        areas += two if two and score(two) - score([(rows, cols)]) > 1e-9 else [(rows, cols)]
    assert math.isclose(gain, score(areas) - score([every]), rel_tol=1e-9)
    for a in areas:
        assert np.allclose(plane[a], leaf(a))


def test_scores_of_the_whole_table(spark, documents, sf_dir):
    """Look-ups by hand for every document, and labels of held-out rows unseen."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = Q.train(documents, labels)
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = Q.score(documents, model, 0.7).collect()
    assert len(got) == len(rows)
    for r in got:
        x = [np.float32(v) for v in plain_measures(rows[r["doc_id"]])]
        b = [sum(v >= e for e in edge) for v, edge in zip(x, model.edges, strict=True)]
        z = model.base + sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[model.coarse[i][b[i]], model.coarse[j][b[j]]] for i, j, t in model.pairs)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-6) or min(abs(v - e) for v, edge in zip(x, model.edges, strict=True) for e in edge) < 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    seen = labels.where(~Q.held_out(labels["doc_id"]))
    assert all(np.allclose(a, b) for a, b in zip(Q.train(documents, seen).tables, model.tables, strict=True))
