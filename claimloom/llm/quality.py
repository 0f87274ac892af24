"""Quality classifier: a generalised additive model with pairwise interactions.

A document becomes a dozen measures of its whole text (``FEATURES``), each put into bins.
Cyclic boosting goes round the features and adds to each feature's table a small step
towards a shallow tree on that feature alone; then round the pairs with the largest gain
on what is left, with shallow trees on two features. A score is the sum of one table entry
for each feature and pair, through the logistic function, so scoring is array look-ups.

The model is fitted on the driver from at most ``sample_rows`` labelled documents (those
with the smallest hashes of their ids), a bounded sample; every document is scored on its whole
text. Rows with crc32(doc_id as text) mod 4 = 2 are held out.

Defined results: null and empty texts have measures of zero and are scored like any other;
repeated rows get equal scores; a null ``doc_id`` is not held out and has no label; several
labels of a document count by their mean (0.5 and more: good), null ones not at all; without
labels, or with labels of one kind, every score is the share of good labels, taken as 1
where there are none; extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import flat, slices

FEATURES = (
    "log_bytes", "upper_share", "mark_share", "digit_share", "beyond_ascii_share", "lines_per_kb", "word_length",
    "distinct_share", "repeat_share", "longest_repeat", "marked_words", "shouted_bytes", "marked_bytes",
)

_UPPER, _LOWER, _DIGIT, _GAP, _LINE, _STOP, _MARK, _BEYOND = range(8)
_KIND = bytearray([_MARK]) * 256
for _b in range(256):
    if ord("A") <= _b <= ord("Z"):
        _KIND[_b] = _UPPER
    elif ord("a") <= _b <= ord("z"):
        _KIND[_b] = _LOWER
    elif ord("0") <= _b <= ord("9"):
        _KIND[_b] = _DIGIT
    elif _b in (9, 13, 32):
        _KIND[_b] = _GAP
    elif _b == 10:
        _KIND[_b] = _LINE
    elif _b in b".,;:'\"()-?":
        _KIND[_b] = _STOP
    elif _b >= 0x80:
        _KIND[_b] = _BEYOND


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between the bounds ``at``."""
    upto = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=upto[1:])
    return np.diff(upto[at]).astype(np.int64)


def measures(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, bounds = flat(texts)
    n = len(bounds) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    if not len(raw):
        return out
    size = np.maximum(np.diff(bounds), 1)
    kind = np.frombuffer(raw.tobytes().translate(bytes(_KIND)), np.uint8)
    upper, lower, digit, line, mark, beyond = (kind == k for k in (_UPPER, _LOWER, _DIGIT, _LINE, _MARK, _BEYOND))
    n_upper, n_lower, n_beyond = _sums(upper, bounds), _sums(lower, bounds), _sums(beyond, bounds)
    out[:, 0] = np.log1p(np.diff(bounds))
    out[:, 1] = n_upper / np.maximum(n_upper + n_lower, 1)
    out[:, 2] = _sums(mark, bounds) / size
    out[:, 3] = _sums(digit, bounds) / size
    out[:, 4] = n_beyond / size
    out[:, 5] = _sums(line, bounds) * 1000 / size
    gap = (kind == _GAP) | line
    begin = ~gap
    begin[1:] &= gap[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    begin[inner] = ~gap[inner]
    at = np.flatnonzero(begin)
    if not len(at):
        return out
    text_at = np.searchsorted(at, bounds)
    n_words = np.maximum(np.diff(text_at), 1)
    ink = ~gap
    packed = raw[ink]
    offsets = np.append(np.cumsum(ink, dtype=np.int64)[at] - 1, len(packed))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(text_at))
    out[:, 6] = _sums(ink, bounds) / n_words
    pairs = np.unique((doc << 32) | code)
    out[:, 7] = np.bincount(pairs >> 32, minlength=n) / n_words
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])
    out[:, 8] = _sums(again, text_at) / n_words
    broken = np.flatnonzero(~again)  # runs of one word repeated
    run = np.diff(np.append(broken, len(code)))
    longest = np.zeros(n)
    np.maximum.at(longest, doc[broken], run)
    out[:, 9] = np.log1p(np.maximum(longest - 1, 0))
    last = offsets[1:] - 1
    final = kind[ink][last]
    out[:, 10] = _sums(final == _MARK, text_at) / n_words
    # by lines: bytes of those that are mostly capitals, and of those rich in marks
    starts = np.union1d(inner, np.flatnonzero(line[:-1]) + 1) if len(raw) > 1 else inner
    stops = np.append(starts, len(raw))
    width = np.diff(stops)
    capitals, letters, marks = _sums(upper, stops), _sums(upper | lower, stops), _sums(mark, stops)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    out[:, 11] = np.bincount(owner, np.where(2 * capitals > np.maximum(letters, 1), width, 0), minlength=n) / size
    out[:, 12] = np.bincount(owner, np.where(20 * marks > width, width, 0), minlength=n) / size
    return out


@dataclass
class Model:
    """Bin edges, tables and interactions; ``base`` is added to every score."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    ok = (nl >= least) & (nt - nl >= least)
    if not ok.any():
        return 0.0, -1
    gain = np.where(ok, gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge), 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, ridge: float, least: int) -> np.ndarray:
    """Values of a tree of few leaves on one feature's bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b], ridge, least), i) for i, (a, b) in enumerate(parts) if b - a > 1]
        gain, k, i = max(cuts, default=(0.0, -1, 0))
        if gain <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _plane(g: np.ndarray, h: np.ndarray, n: np.ndarray, ridge: float, least: int) -> tuple[float, np.ndarray]:
    """Gain and values of a tree of four leaves at most on a table of two features' bins."""

    def cut(g, h, n):
        return max(((*_best_cut(g.sum(1 - ax), h.sum(1 - ax), n.sum(1 - ax), ridge, least), ax) for ax in (0, 1)), key=lambda x: x[0])

    out, total = np.zeros_like(g), 0.0
    gain, k, ax = cut(g, h, n)
    if k < 0 or gain <= 1e-9:
        out[:] = _leaf(g.sum(), h.sum(), ridge)
        return 0.0, out
    total += gain
    for side in (slice(0, k), slice(k, None)):
        area = (side, slice(None)) if ax == 0 else (slice(None), side)
        more, q, ax2 = cut(g[area], h[area], n[area])
        if q > 0 and more > 1e-9:
            total += more
            for s2 in (slice(0, q), slice(q, None)):
                inner = (s2, slice(None)) if ax2 == 0 else (slice(None), s2)
                out[area][inner] = _leaf(g[area][inner].sum(), h[area][inner].sum(), ridge)
        else:
            out[area] = _leaf(g[area].sum(), h[area].sum(), ridge)
    return total, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, leaves: int = 3, ridge: float = 1.0, least: int = 10) -> Model:
    """Cyclic boosting of one-feature tables, then of two-feature tables."""
    if not len(y) or y.min() == y.max():
        return Model(0.0, constant=float(y.mean()) if len(y) else 1.0)
    edges = []
    for j in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))
        edges.append(cut.astype(np.float32))
    base = float(np.log(y.mean() / (1 - y.mean())))
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    z = np.full(len(y), base)
    size = [np.bincount(b[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(b[:, j], y - p, minlength=len(t))
            h = np.bincount(b[:, j], p * (1 - p), minlength=len(t))
            step = rate * _tree(g, h, size[j], leaves, ridge, least)
            t += step
            z += step[b[:, j]]
    model.coarse = [(np.arange(len(t)) * min(16, len(t))) // len(t) for t in model.tables]
    c = np.stack([m[b[:, j]] for j, m in enumerate(model.coarse)], axis=1)
    wide = [int(m.max()) + 1 for m in model.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        cell = c[:, i] * wide[j] + c[:, j]
        return tuple(np.bincount(cell, w, minlength=wide[i] * wide[j]).reshape(wide[i], wide[j]) for w in (y - p, p * (1 - p), np.ones(len(y))))

    gains = [(_plane(*grids(i, j), ridge, least)[0], i, j) for i in range(len(wide)) for j in range(i)]
    chosen = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for i, j in chosen]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            step = rate * _plane(*grids(i, j), ridge, least)[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> Model:
    """Fit on at most ``sample_rows`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.orderBy(*order).limit(sample_rows)  # 12 bytes a row: bounded by the parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                x = measures(s.column(1))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", "good", *FEATURES])

    schema = "doc_id long, good int, " + ", ".join(f"{f} float" for f in FEATURES)
    found = _rows(docs).join(F.broadcast(sample), "doc_id").mapInArrow(run, schema).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    found = found.take(pc.sort_indices(found, sort_keys=[(k, "ascending") for k in ("doc_id", *FEATURES)]))  # one model whatever the tasks' order
    x = np.stack([np.asarray(found[f]) for f in FEATURES], axis=1)
    return fit(x, np.asarray(found["good"], np.float64), **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score at or above the threshold) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(sent.value.score(measures(s.column(1))))], ["doc_id", "score"])

    scored = _rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents at or above the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index("text")
            for s in slices(batch, "text"):
                good = sent.value.score(measures(s.column(at))) >= threshold
                yield s.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
