"""N-gram Jaccard join by MinHash banding.

1. Equal texts are one class from the start (key: 128-bit digest of the text); the rest
   works on distinct texts.
2. Texts become sets of word n-grams; MinHash signatures are cut into bands. ``plan_bands``
   chooses rows and bands for the recall asked for at the threshold.
3. A shuffle on band hashes links each text of a bucket to the smallest one there: a bucket
   of m texts makes m - 1 links, never all pairs. The components of these links hold every
   pair that shares a band.
4. Within a component all pairs are verified on their full n-gram sets. Large components are
   cut into blocks of bounded texts and bytes, and each pair of blocks is a task of bounded size; small ones share
   tasks. A task returns for each text its number of links and one link to the root of what it
   joined, so its rows do not grow with the pairs.
5. The components of verified links are the classes.

Words are runs of letters (lower case), digits and characters beyond ASCII. A text of fewer
than n words has one n-gram of all its words.

Defined results: null, empty and wordless texts have no n-grams, so they only match their
exact copies (null counts as empty); repeated rows are copies of each other; a null
``doc_id`` is kept and never names a class unless the class has no other; extra columns
take no part; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.skew import BROADCAST_BYTES, join_split
from ..session import stored
from .decontamination import words_of
from .textblocks import ragged, release, slices

#: Texts of a block: at least SMALL, and beyond SMALL**2 texts in a component more, up to LARGE.
SMALL, LARGE = 64, 2048
#: Bytes of text of a block, about.
TASK_BYTES = 4 << 20
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def plan_bands(threshold: float, recall: float, most_hashes: int = 192) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) that still reach the recall.

    A pair at the threshold shares a band with probability 1 - (1 - threshold^rows)^bands.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    raw = np.frombuffer(dictionary.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    up, down = _powers(_BASE, len(raw) + 1), _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    value = (sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]]
    return _mixed(value + np.diff(offsets).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts in a row, repeats included, and the offsets."""
    found, count = words_of(texts)
    size = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    offsets = np.concatenate(([0], np.cumsum(size)))
    if not len(found):
        return np.zeros(0, np.uint64), offsets
    d = found.dictionary_encode()
    word = word_hashes(d.dictionary)[np.asarray(d.indices)]
    begin = np.cumsum(count) - count
    at = ragged(begin, size)
    last = np.repeat(begin + count, size)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((word, np.zeros(n, np.uint64)))
    for k in range(n):
        value = padded[at + k] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        out += value if not (count < n).any() else np.where(at + k < last, value, np.uint64(0))
    return _mixed(out), offsets


def signatures(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each text (texts x bands); texts without n-grams get zeros."""
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    small = (grams >> np.uint64(32)).astype(np.uint32)
    rng = np.random.Generator(np.random.PCG64(20240229))
    scale = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    starts = offsets[full]
    for b in range(bands):
        held = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            k = b * rows + r
            value = small * scale[k]
            value ^= shift[k]
            held = _mixed(held * np.uint64(0x100000001B3) + np.minimum.reduceat(value, starts))
        out[full, b] = held
    return out


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    grams, offsets = ngrams(texts, n)
    return [np.unique(grams[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class _Sets:
    """The sets of one side in order of size, ready to be compared with one set after the other.

    ``right`` None compares the sets of ``left`` with the later ones of left.
    """

    def __init__(self, left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
        self.own, self.threshold = right is None, threshold
        right = left if right is None else right
        sizes = np.array([len(x) for x in right])
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.words = np.unique(np.concatenate(left if self.own else [*left, *right]))
        self.flat = np.concatenate([np.searchsorted(self.words, right[i]) for i in self.order.tolist()])
        self.ends = np.cumsum(self.sizes)
        self.rank = np.empty(len(sizes), np.int64)
        self.rank[self.order] = np.arange(len(sizes))
        self.mark = np.zeros(len(self.words), np.int32)

    def reach(self, i: int, size: int) -> tuple[int, int]:
        """The places that set i has to be compared with: a set is at the threshold only with sizes within its factor."""
        lo = int(self.rank[i]) + 1 if self.own else int(np.searchsorted(self.sizes, math.ceil(self.threshold * size - 1e-9)))
        return lo, int(np.searchsorted(self.sizes, math.floor(size / self.threshold + 1e-9), side="right"))

    def similar(self, marked: np.ndarray, begin: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        """Which of the sets, whose marks stand in a row, are at the threshold with one of this size."""
        shared = np.add.reduceat(marked, begin)
        return shared >= self.threshold * (size + sizes - shared) - 1e-9


def _similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left`` those of ``right`` (None: the later ones of left) at the threshold."""
    by = _Sets(left, right, threshold)
    for i, a in enumerate(left):
        lo, hi = by.reach(i, len(a))
        if lo >= hi:
            continue
        at = np.searchsorted(by.words, a)
        by.mark[at] = 1
        first = int(by.ends[lo] - by.sizes[lo])
        ok = by.similar(by.mark[by.flat[first : by.ends[hi - 1]]], by.ends[lo:hi] - by.sizes[lo:hi] - first, len(a), by.sizes[lo:hi])
        by.mark[at] = 0
        if ok.any():
            yield i, by.order[lo:hi][ok]


def _connecting(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Some of the pairs of ``_similar`` that connect all that those connect.

    A set is not compared with one that it is connected with already. It meets the others in
    growing steps, so that in a group of near copies each meets but a few.
    """
    by = _Sets(left, right, threshold)
    theirs = np.arange(len(by.order))
    mine = theirs if by.own else np.arange(len(left)) + len(theirs)
    for i, a in enumerate(left):
        here = int(by.rank[i]) if by.own else i
        label = mine[here]
        lo, hi = by.reach(i, len(a))
        open_, step = np.arange(lo, hi), 8
        open_ = open_[theirs[open_] != label]
        if not len(open_):
            continue
        at = np.searchsorted(by.words, a)
        by.mark[at] = 1
        while len(open_):
            now, open_ = open_[:step], open_[step:]
            sizes = by.sizes[now]
            ok = by.similar(by.mark[by.flat[ragged(by.ends[now] - sizes, sizes)]], np.cumsum(sizes) - sizes, len(a), sizes)
            if ok.any():
                labels, first = np.unique(theirs[now[ok]], return_index=True)
                yield i, by.order[now[ok][first]]
                theirs[np.isin(theirs, labels)] = label
                if not by.own:
                    mine[np.isin(mine, labels)] = label
                open_ = open_[theirs[open_] != label]
            step *= 8
        by.mark[at] = 0


def _verify(table: pa.Table, n: int, threshold: float, counted: bool = True) -> pa.Table:
    """Links of one task: texts of one or several components, or of two blocks of one.

    Where links are not ``counted``, only as many pairs are compared as the classes need.
    """
    pairs = _similar if counted else _connecting
    table = table.combine_chunks()
    keys = table["node"].to_pylist()
    seen: dict[int, int] = {}
    for i, k in enumerate(keys):
        seen.setdefault(k, i)  # repeated rows of one representative
    keep = sorted(seen.values())
    table = table.take(pa.array(keep))
    keys = table["node"].to_pylist()
    comp, side, whole = table["comp"].to_pylist(), table["side"].to_pylist(), table["whole"].to_pylist()
    sets = _sets(table["text"].combine_chunks(), n)
    links = np.zeros(len(keys), np.int64)
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    groups: dict[int, list[int]] = {}
    for i, c in enumerate(comp):
        groups.setdefault(c, []).append(i)
    for members in groups.values():
        if whole[members[0]]:
            left, right = members, None
        else:
            left, right = [i for i in members if side[i] == 0], [i for i in members if side[i] == 1]
            if not left or not right:
                continue
        to = left if right is None else right
        for i, partners in pairs([sets[i] for i in left], None if right is None else [sets[i] for i in right], threshold):
            links[left[i]] += len(partners)
            for j in partners.tolist():
                links[to[j]] += 1
                a, b = root(left[i]), root(to[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
    on = [i for i in range(len(keys)) if links[i]]
    release()
    return pa.table({"node": pa.array([keys[i] for i in on], pa.int64()), "peer": pa.array([keys[root(i)] for i in on], pa.int64()), "links": pa.array(links[on])})


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, counted: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """Each row's (doc_id, key), each text (key, first_id, n_copies, n_links if ``counted``, root), and the number of rows."""
    bands, rows = plan_bands(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch):
                grams, offsets = ngrams(s.column(2), n)
                held = signatures(grams, offsets, bands, rows).view(np.int64)
                some = np.diff(offsets) > 0
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)), pa.array(held[some].reshape(-1)))
                size = pc.fill_null(pc.binary_length(s.column(2)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), size, hashes], ["doc_id", "key", "size", "bands"])

    signed = stored(base.mapInArrow(sign, "doc_id long, key binary, size long, bands array<long>"), "signed")
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # numbers are those written
    total = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n_copies"), F.lit(0)).alias("rows")).first()
    exploded = texts.select("node", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = join_split(exploded, buckets, "band", "n", total["texts"] * bands).where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    parts = components(edges).join(texts.select("node", "key", "first_id", "size"), "node")
    parts = stored(parts, "candidates")
    sizes = parts.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    block = F.greatest(F.lit(SMALL), F.least(F.lit(LARGE), F.ceil(F.col("m") / SMALL)))
    pieces = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / TASK_BYTES))
    whole = (F.col("m") <= 2 * SMALL) & (F.col("bytes") <= 2 * TASK_BYTES)
    blocks = sizes.select("root", F.col("m").alias("members"), F.when(whole, F.lit(1)).otherwise(pieces).cast("long").alias("blocks"))
    members = join_split(parts, blocks, "root", "members", total["texts"]).withColumnRenamed("root", "comp")
    members = stored(members, "members")
    own = lambda c: F.coalesce(F.sum(F.when(F.col("blocks") == 1, c).otherwise(0)), F.lit(0))
    small = members.agg(own(F.lit(1)).alias("small"), own(F.col("size")).alias("bytes"), F.count("*").alias("n")).first()
    shared = max(1, small["small"] // (2 * SMALL), small["bytes"] // TASK_BYTES)
    lookup = members.select("key", "node", F.coalesce("first_id", F.lit(-1)).alias("first_id"), "comp", "blocks")
    if small["n"] * 64 <= BROADCAST_BYTES:  # else a sort-merge join
        lookup = F.broadcast(lookup)
    rep = base.select(F.coalesce("doc_id", F.lit(-1)).alias("first_id"), "key", "text").join(lookup, ["key", "first_id"])
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rep = rep.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    rep = rep.select(
        "node", "comp", "text",
        F.when((F.col("mine") == F.col("other")) | (F.col("mine") < F.col("other")), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        (low == high).alias("whole"),
        F.when(F.col("blocks") == 1, F.xxhash64(F.pmod(F.xxhash64("comp"), F.lit(shared)))).otherwise(F.xxhash64("comp", low, high)).alias("task"),
    )
    verified = stored(rep.groupBy("task").applyInArrow(lambda t: _verify(t, n, threshold, counted), "node long, peer long, links long"), "links")
    classes = components(verified.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    counts = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    named = texts.select("node", "key", "first_id", "n_copies").join(counts, "node", "left").join(classes, "node", "left")
    named = named.select("key", "first_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "key"), stored(named, "named"), total["rows"]


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_copies.

    ``class_id`` is the smallest doc_id of the documents that links connect, ``n_links`` the
    number of different texts at the threshold or above, ``n_copies`` the rows with this
    very text, this one included.
    """
    rows, named, total = _classes(docs, n, threshold, recall)
    ids = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members"))
    named = join_split(named, ids, "root", "members", total).select("key", "class_id", "n_links", "n_copies", F.col("n_copies").alias("copies"))
    return join_split(rows, stored(named, "classes"), "key", "copies", total).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The documents without all but one of each class: the one of the smallest doc_id stays.

    All columns are kept. Rows equal in doc_id and text count as one document: the first of them
    in the order of their columns as JSON.
    """
    rows, named, _ = _classes(docs, n, threshold, recall, counted=False)
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("best"))
    chosen = chosen.select(F.col("best.key").alias("key"), F.col("best.first_id").alias("first_id"), F.lit(True).alias("stays"))
    copies = rows.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    told = copies.join(chosen, (copies.key == chosen.key) & copies.doc_id.eqNullSafe(chosen.first_id), "left").select(copies.doc_id, copies.key, "times", F.coalesce("stays", F.lit(False)).alias("stays"))
    told = stored(told.where("not stays or times > 1"), "told")  # rows to go, and rows that stand several times
    sums = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("stays").cast("int")), F.lit(0)).alias("repeated")).first()
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    here = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("told_id"), key.alias("told_key"))
    marks = told.select(F.col("doc_id").alias("mark_id"), F.col("key").alias("mark_key"), "stays")
    if sums["n"] * 64 <= BROADCAST_BYTES:  # else a sort-merge join
        marks = F.broadcast(marks)
    met = here.join(marks, (F.col("told_key") == F.col("mark_key")) & F.col("told_id").eqNullSafe(F.col("mark_id")), "left")
    out = met.where("stays is null").select("row.*")
    if sums["repeated"]:
        once = met.where("stays").groupBy("told_id", "told_key").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row.*")
        out = out.unionByName(once)
    return out
