"""Best-fit packing of token sequences by the sum-of-squares rule.

A document is its ids and an end id; only longer ones than a sequence are cut. An item
goes into the open sequence for which the sum over gaps g of N(g)^2 becomes smallest, N(g)
being the number of open sequences with g free places; ties go to the tightest fit, and a
new sequence is opened only for an item that fits into none. Items come in order of
falling length.

Only lengths matter for that rule, so it runs in the driver on the histogram of lengths, item by item at
every size: about a hundred thousand items a second, in one thread. The driver holds the open sequences as
runs of consecutive numbers and writes out where items go as it proceeds. The items find their places in
parallel. For that the items of a length are listed in at most ``PARTS`` equal batches, and an item's rank
among those of its length names the batch; the batches have no part in which sequence takes an item.

Defined results: null and empty texts are one end id; repeated rows are documents of their
own; null ids are kept; extra columns of the input take no part; no rows give no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, stored
from .files import filesystem
from .textblocks import ragged, slices
from .tokens import public_path, tokenizer

#: Batches of a length, and runs that the driver holds.
PARTS, RUNS_HELD = 512, 1 << 18
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with ``end_id`` behind them, and the new offsets."""
    sizes = np.diff(offsets) + 1
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(int(to[-1]), end_id, "<u4")
    out[ragged(to[:-1], sizes - 1)] = ids
    return out, to


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int) -> DataFrame:
    """The pieces of all documents; ``nth`` numbers those of one length within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            for s in slices(batch):
                e = tok.encode(s.column(1))
                ids, to = with_end(e.ids, e.offsets, end_id)
                sizes = np.diff(to)
                count = -(-sizes // seq_len)
                doc = np.repeat(np.arange(s.num_rows), count)
                piece = ragged(np.zeros(len(count), np.int64), count)
                start = piece * seq_len
                length = np.minimum(seq_len, sizes[doc] - start)
                view, begin = memoryview(ids).cast("B"), (to[doc] + start) * 4
                crc = np.fromiter((zlib.crc32(view[a : a + n]) for a, n in zip(begin.tolist(), (length * 4).tolist(), strict=True)), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.searchsorted(ranked, ranked, side="left") + seen[ranked]
                seen += np.bincount(length, minlength=seq_len + 1)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )
        tok.done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


class Runs:
    """Where items of ``length`` go: sequences from ``sequence`` on, one each, at ``offset``.

    A run holds ``count`` items of batch ``slot`` of the length, from the ``first`` of the batch on.
    """

    def __init__(self):
        self.length, self.slot, self.first, self.count, self.sequence, self.offset = (array("q") for _ in range(6))

    def add(self, *values: int) -> None:
        for column, value in zip((self.length, self.slot, self.first, self.count, self.sequence, self.offset), values, strict=True):
            column.append(value)

    def spill(self) -> None:
        """Called after each length."""


class StoredRuns(Runs):
    """Runs that go to files below ``path``, RUNS_HELD and those of one length at once."""

    def __init__(self, path: str):
        super().__init__()
        self._fs, self._at = filesystem(path)
        self._fs.create_dir(self._at, recursive=True)
        self._files = 0

    def spill(self, least: int = RUNS_HELD) -> None:
        if len(self.length) >= least:
            columns = {k: v for k, v in vars(self).items() if not k.startswith("_")}
            pq.write_table(pa.table({k: pa.array(np.asarray(v, np.int64)) for k, v in columns.items()}), f"{self._at}/part-{self._files:05d}.parquet", filesystem=self._fs)
            self._files += 1
            for v in columns.values():
                del v[:]


def batch_size(count: int, parts: int = PARTS) -> int:
    return -(-count // parts)


def sum_of_squares(counts: np.ndarray, seq_len: int, parts: int = PARTS, runs: Runs | None = None) -> tuple[Runs, int]:
    """Place counts[l] items of each length l < seq_len: the runs, and the number of sequences."""
    runs, used, base = Runs() if runs is None else runs, 0, seq_len + 1
    n = [0] * base  # open sequences by gap
    stacks: list[list[list[int]]] = [[] for _ in range(base)]  # those sequences, as first and count
    for s in np.flatnonzero(counts)[::-1].tolist():
        total = int(counts[s])
        batch = batch_size(total, parts)

        def key(g: int, s: int = s) -> int:
            # what the gap that goes and the one that remains add to the squares, then the gap; a full
            # sequence is closed and counts for nothing
            return (1 - 2 * n[g] if g == s else 2 * (n[g - s] - n[g]) + 2) * base + g

        heap = [key(g) for g in range(s, seq_len) if n[g]]
        heapify(heap)
        for slot in range(batch_size(total, batch)):
            took: dict[int, list[list[int]]] = {}  # by gap, sequences as first and count
            for _ in range(min(batch, total - slot * batch)):
                while heap and (not n[heap[0] % base] or key(heap[0] % base) != heap[0]):
                    heappop(heap)  # as it was before a later change
                if heap:
                    gap = heap[0] % base
                    n[gap] -= 1
                    top = stacks[gap][-1]
                    to = top[0]
                    top[0], top[1] = to + 1, top[1] - 1
                    if not top[1]:
                        stacks[gap].pop()
                else:
                    gap, to, used = seq_len, used, used + 1
                if gap > s:
                    n[gap - s] += 1
                    _append(stacks[gap - s], to)
                _append(took.setdefault(gap, []), to)
                for g in (gap - s, gap, gap + s):  # as the gap that goes, and as the one that remains
                    if s <= g < seq_len and n[g]:
                        heappush(heap, key(g))
            first = 0
            for gap, held in took.items():
                for begin, count in held:
                    runs.add(s, slot, first, count, begin, seq_len - gap)
                    first += count
        runs.spill()
    return runs, used


def _append(held: list[list[int]], sequence: int) -> None:
    if held and sum(held[-1]) == sequence:
        held[-1][1] += 1
    else:
        held.append([sequence, 1])


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = 2048, end_id: int = 0, parts: int = PARTS) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path or public_path(), seq_len, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(seq_len + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most seq_len rows
        counts[r["length"]] = r["n"]
    whole, counts[seq_len] = int(counts[seq_len]), 0
    path = scratch(spark, "places")
    runs, used = sum_of_squares(counts, seq_len, parts, StoredRuns(path))
    runs.spill(0)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = ranked.where(F.col("length") == seq_len).select(*keep, (F.col("rank") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    batches = spark.createDataFrame([(int(s), batch_size(int(counts[s]), parts)) for s in np.flatnonzero(counts)] or [(0, 1)], "length long, batch long")
    open_ = ranked.where(F.col("length") < seq_len).join(F.broadcast(batches), "length")  # at most seq_len rows
    slot = F.floor(F.col("rank") / F.col("batch"))
    open_ = open_.select(*keep, slot.alias("slot"), (F.col("rank") - slot * F.col("batch")).alias("within"))
    places = spark.read.schema("length long, slot long, first long, count long, sequence long, offset long").parquet(path)
    here = (F.col("within") >= F.col("first")) & (F.col("within") < F.col("first") + F.col("count"))
    found = open_.join(places, ["length", "slot"]).where(here)
    found = found.select(*keep, (F.col("sequence") + F.col("within") - F.col("first")).alias("sequence_id"), "offset")
    return found.unionByName(full) if whole else found
