"""Combination of mass functions on any frame, by group.

The adaptive fold is neither associative nor commutative, so a group's masses are needed
together, in canonical order. On the binary frame ``functions.evidence.fold`` is one native
expression, for a few groups; ``folded`` does the same for tables, step by step over all
groups of an Arrow batch at once, which takes a tenth of the time. A dictionary of focal
elements does for frames of more hypotheses. Groups are one claim's sources. The associative rules do without: ``dempster_binary`` is a plain
aggregate with map-side partial sums, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import TINY, binary, clip

Mass = dict[tuple[int, bool], float]


PARTS = ("m0", "m1", "th", "cf", "ms")


def _step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``functions.evidence.adaptive_step`` on rows of PARTS."""
    (a0, a1, at, ac, am), (b0, b1, bt, bc, bm) = a.T, b.T
    pos_a, pos_b = a0 + a1 + at, b0 + b1 + bt
    k = a0 * b1 + a1 * b0 + ac * (pos_b + bc + bm) + bc * (pos_a + am) + am * pos_b + bm * pos_a
    m0, m1, th, ms = a0 * (b0 + bt) + at * b0, a1 * (b1 + bt) + at * b1, at * bt, am * bm
    rest = m0 + m1 + th + ms
    middle, open_ = (k >= 0.1) & (k < 0.5), am > 0.03
    with np.errstate(divide="ignore", invalid="ignore"):
        by = np.where((k < 0.1) | middle | open_ | (rest <= TINY), 1.0, 1 + 0.5 * k / rest)
    over = np.where(k < 0.1, 1 - k, 1.0)  # divided by, not multiplied with its inverse: both hypotheses of a balanced claim must stay equal to the last bit
    lost = np.where(k < 0.5, 0.0, np.where(open_, k, 0.5 * k + np.where(rest < TINY, 0.5 * k, 0.0)))
    return np.stack([m0 * by / over, m1 * by / over, th * by / over, np.where(middle, k, 0.0), ms * by / over + lost], axis=1)


def _canonical(m: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the rows by group, then by their sets in order {0}, {0,1}, {1}, each with its mass."""
    held = m[:, [0, 2, 1]]
    some = held > 0
    place = np.cumsum(some, axis=1) - 1
    sets, values = np.full((len(m), 3), -1), np.zeros((len(m), 3))
    row, col = np.nonzero(some)
    sets[row, place[row, col]], values[row, place[row, col]] = col, held[row, col]
    return np.lexsort((values[:, 2], sets[:, 2], values[:, 1], sets[:, 1], values[:, 0], sets[:, 0], group))


def fold_lists(lists: pa.Array) -> pa.Array:
    """The masses of each list combined in canonical order; null for an empty one."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = lists.flatten()
    m = np.stack([np.asarray(flat.field(i), np.float64) for i in range(len(PARTS))], axis=1) if len(flat) else np.zeros((0, len(PARTS)))
    m = m[_canonical(m, np.repeat(np.arange(len(size)), size))]
    begin = np.cumsum(size) - size
    out = np.zeros((len(size), len(PARTS)))
    some = np.flatnonzero(size)
    out[some] = m[begin[some]]
    for j in range(1, int(size.max(initial=0))):
        some = some[size[some] > j]
        out[some] = _step(out[some], m[begin[some] + j])
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(len(PARTS))], list(PARTS), mask=pa.array(size == 0))


def folded(grouped: DataFrame, column: str) -> DataFrame:
    """``grouped`` with the list of binary masses in ``column`` replaced by their combination.

    A group's masses are one row (40 bytes each); its fold takes one step a mass.
    """
    names = grouped.columns
    kinds = ", ".join(f"{n} " + ("struct<" + ", ".join(f"{p}: double" for p in PARTS) + ">" if n == column else k) for n, k in grouped.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([fold_lists(c) if n == column else c for n, c in zip(names, batch.columns, strict=True)], names)

    return grouped.mapInArrow(run, kinds)


def meet(a: tuple[int, bool], b: tuple[int, bool]) -> tuple[int, bool]:
    (x, p), (y, q) = a, b
    if p and q:
        return x | y, True
    if p:
        return y & ~x, False
    return (x & ~y, False) if q else (x & y, False)


def conjunctive(a: Mass, b: Mass) -> Mass:
    out: Mass = {}
    for x, v in a.items():
        for y, w in b.items():
            if v * w:
                out[z] = out.get(z := meet(x, y), 0.0) + v * w
    return out


def _split(m: Mass) -> tuple[Mass, float]:
    return {k: v for k, v in m.items() if k != (0, False)}, m.get((0, False), 0.0)


def dempster(a: Mass, b: Mass) -> Mass | None:
    m, k = _split(conjunctive(a, b))
    return None if abs(k - 1) < TINY else {x: v / (1 - k) for x, v in m.items()}


def moved(a: Mass, b: Mass, to: tuple[int, bool]) -> Mass:
    """Conflict goes to one element: the frame (closed) or the vacuous (0, True) (open)."""
    m, k = _split(conjunctive(a, b))
    if k:
        m[to] = m.get(to, 0.0) + k
    return m


def dubois_prade(a: Mass, b: Mass) -> Mass:
    """Each conflicting pair's mass goes to the union of the pair."""
    out: Mass = {}
    for x, v in a.items():
        for y, w in b.items():
            z = meet(x, y)
            if z == (0, False):
                z = (x[0] | y[0], False)
            out[z] = out.get(z, 0.0) + v * w
    return {k: v for k, v in out.items() if v}


def inagaki(a: Mass, b: Mass, gamma: float, full: int) -> Mass:
    whole = conjunctive(a, b)
    m, k = _split(whole)
    if k < TINY:
        return whole
    rest = sum(m.values())
    shared, lost = (1 - gamma) * k, gamma * k
    if rest > TINY:
        m = {x: v + shared * v / rest for x, v in m.items()}
    else:
        lost += shared
    if lost:
        m[full, True] = m.get((full, True), 0.0) + lost
    return m


def discount(m: Mass, alpha: float, full: int) -> Mass:
    out = {x: alpha * v for x, v in m.items() if x != (full, False) and alpha * v > 0}
    if (rest := alpha * m.get((full, False), 0.0) + 1 - alpha) > 0:
        out[full, False] = rest
    return out


def commonality(m: Mass, target: int) -> float:
    return sum(v for (x, neg), v in m.items() if not neg and x & target == target)


def cautious(a: Mass, b: Mass, full: int) -> Mass:
    """Least commonalities, turned back over the subsets of the frame."""
    q = {s: min(commonality(a, s), commonality(b, s)) for s in range(1, full + 1)}
    q[0] = 1.0
    out: Mass = {}
    for s in range(full + 1):
        v = sum((-1) ** (t & ~s).bit_count() * q[t] for t in range(full + 1) if t & s == s)
        if v > 1e-12:
            out[s, False] = v
    return out


def canonical_key(m: Mass) -> list:
    """Order of masses: by elements (hypotheses in order, complement last), then by value."""
    def bits(x: int) -> tuple[int, ...]:
        return tuple(i for i in range(x.bit_length()) if x >> i & 1)

    return sorted((bits(x), neg, v) for (x, neg), v in m.items())


def combine_all(masses: Iterable[Mass], full: int) -> Mass | None:
    """Adaptive fold in canonical order; null for no masses or total conflict."""
    ordered = sorted(masses, key=canonical_key)
    if not ordered:
        return None
    acc: Mass | None = ordered[0]
    for m in ordered[1:]:
        k = conjunctive(acc, m).get((0, False), 0.0)
        if k < 0.1:
            acc = dempster(acc, m)
        elif k < 0.5:
            acc = conjunctive(acc, m)
        else:
            acc = inagaki(acc, m, 1.0 if sum(v for (_, neg), v in acc.items() if neg) > 0.03 else 0.5, full)
        if acc is None:
            return None
    return acc


def text_key(x: int, neg: bool) -> str:
    """Wire format: ascending indices with commas, ~ before a complement."""
    return ("~" if neg else "") + ",".join(str(i) for i in range(x.bit_length()) if x >> i & 1)


def parse_key(text: str) -> tuple[int, bool]:
    neg = text.startswith("~")
    return sum(1 << int(i) for i in text.removeprefix("~").split(",") if i), neg


def combine_groups(rows: DataFrame, keys: list[str], hypotheses: int) -> DataFrame:
    """Combined masses of each group as a map in wire format.

    ``rows`` has the keys, ``masses`` (map of wire keys) and ``alpha`` (reliability). A group in
    total conflict has null masses and an error instead of failing the job.
    """
    full = (1 << hypotheses) - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [discount({parse_key(k): float(v) for k, v in (m or {}).items()}, float(a), full) for m, a in zip(pdf["masses"].map(dict), pdf["alpha"], strict=True)]
        got = combine_all(held, full)
        row = {k: pdf[k].iloc[0] for k in keys} | {"n_sources": len(pdf), "masses": None if got is None else {text_key(*x): v for x, v in got.items()}, "error": "total conflict" if got is None else None}
        return pd.DataFrame([row])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_sources long, masses map<string,double>, error string"
    return rows.select(*keys, "masses", "alpha").groupBy(*keys).applyInPandas(run, schema)


def as_elements(masses: Column) -> Column:
    """A map in wire format as an array of (mask, neg, m)."""
    def one(e: Column) -> Column:
        bits = F.filter(F.split(F.regexp_replace(e["key"], "^~", ""), ","), lambda x: x != "")
        mask = F.aggregate(bits, F.lit(0), lambda s, x: s + F.expr("1").cast("int") * F.pow(F.lit(2), x.cast("int")).cast("int"))
        return F.struct(mask.alias("mask"), e["key"].startswith("~").alias("neg"), e["value"].alias("m"))

    return F.transform(F.map_entries(masses), one)


def dempster_binary(m0: Column, m1: Column, th: Column) -> Column:
    """Aggregate: Dempster's rule over a whole group of positive binary masses at once.

    Commonalities multiply, so sums of logarithms do, with partial sums before the shuffle.
    """
    log = lambda x: F.sum(F.when(x > 0, F.ln(x)))
    none = lambda x: F.max(F.when(x > 0, 0).otherwise(1)) == 1
    product = lambda x: F.when(none(x), F.lit(0.0)).otherwise(F.exp(log(x)))
    qt = product(th)
    a, b = product(m0 + th) - qt, product(m1 + th) - qt
    total = a + b + qt
    return F.when(total > TINY, binary(a / total, b / total, qt / total))


def alternative_set(bel: Column, pl: Column) -> Column:
    """Aggregate: the strongest of a set of alternatives, as a binary mass."""
    top, wide = F.greatest(F.least(F.max(bel), F.lit(1.0)), F.lit(0.0)), F.least(F.max(pl), F.lit(1.0))
    wide = F.greatest(wide, top)
    return binary(top, F.greatest(1 - wide, F.lit(0.0)), wide - top)


def effective_strength(evidence_type: Column, locality: Column, source_strength: Column, weight: Column, intra: Column) -> Column:
    """Reliability of a stored mass: calibrated weight with locality, else what was stored, else a half."""
    stored = clip(source_strength, 0.0, 1.0)
    local = F.when(locality.startswith("intra"), intra).otherwise(F.lit(1.0))
    calibrated = clip(weight * local, 0.0, 1.0)
    return F.when(evidence_type.isNull(), F.coalesce(stored, F.lit(0.5))).otherwise(F.coalesce(calibrated, stored, F.lit(0.5)))
