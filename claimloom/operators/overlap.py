"""Pairs of members that share at least so many keys, without a row for each shared key of each pair.

The members of each key are written once, in order. A task takes members ``a`` in turn and counts, over the
lists of their keys, how often each larger ``b`` comes up; only pairs with enough of them become rows. The
lists come in parts of PART_ROWS entries, cut between values of ``b``, so that every pair is counted within
one part and a worker holds one part only. A pair has one of its keys among all but the ``least`` - 1 longest
lists of ``a``, so the longest are not walked but searched for the members found in the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored

#: Entries of the lists that a worker holds at once (8 bytes each), entries of the members of a task, and rows of a batch of results.
PART_ROWS, TASK_ROWS, OUT_ROWS = 12 << 20, 2 << 20, 1 << 17
#: A list is searched if it is so many times longer than those that were walked.
LONG = 4


def sharing(members: DataFrame, keys: Sequence[str], least: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b) with a < b of members (claim_id) that have at least ``least`` different keys in common; null keys match nothing."""
    spark = members.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    m = members.dropna(subset=["claim_id", *keys]).select(*keys, F.col("claim_id").cast("long").alias("member"))
    numbered = m.repartition(tasks, *keys).sortWithinPartitions(*keys, "member").mapInArrow(_numbered(len(keys)), "key long, member long")
    held = stored(numbered, "lists")
    rows = held.count()
    parts = -(-rows // part_rows)
    ends = held.approxQuantile("member", [k / parts for k in range(1, parts)], 0.001) if parts > 1 else []
    part = sum([F.when(F.col("member") >= int(x), 1).otherwise(0) for x in ends], F.lit(0))
    path = scratch(spark, "parts")
    held.withColumn("part", part).repartitionByRange(tasks, "part", "key").sortWithinPartitions("part", "key", "member").write.partitionBy("part").parquet(path)
    own = held.groupBy("member").agg(F.collect_list("key").alias("keys")).where(F.size("keys") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        for at in _parts(path):
            lists = _Lists(path, at)
            for batch in mine:
                yield from _found(lists, batch, least)

    return own.repartition(max(tasks, -(-rows // TASK_ROWS)), "member").mapInArrow(run, "a long, b long")


def _numbered(n: int):
    """Keys as numbers, each row once; a key's rows are together, so its number is its place among the keys of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in batch.columns[:n]:
                new[1:] |= np.asarray(pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False), bool)
            member = np.asarray(batch.column(n))
            first = tuple(c[0].as_py() for c in batch.columns[:n])
            new[0] = last is None or first != last[0]
            other = new.copy()
            other[1:] |= member[1:] != member[:-1]
            other[0] = new[0] or member[0] != last[1]
            key = code + np.cumsum(new)
            code, last = int(key[-1]), (tuple(c[-1].as_py() for c in batch.columns[:n]), member[-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(member[other])], ["key", "member"])

    return run


def _parts(path: str) -> list[str]:
    fs, at = pafs.FileSystem.from_uri(path)
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith("part="))


class _Lists:
    """The members of each key within a part, as numbers in the order of the members."""

    def __init__(self, path: str, part: str):
        fs, at = pafs.FileSystem.from_uri(f"{path}/{part}")
        files = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith("part-"))
        keys, starts, n = [], [], 0
        self.members = np.empty(sum(pq.read_metadata(x, filesystem=fs).num_rows for x in files), np.int64)
        for x in files:
            with fs.open_input_file(x) as source:
                for b in pq.ParquetFile(source).iter_batches(batch_size=1 << 17, columns=["key", "member"]):
                    k = np.asarray(b.column(0))
                    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                    keys.append(k[begin])
                    starts.append(begin + n)
                    self.members[n : n + len(k)] = b.column(1)
                    n += len(k)
        key, at = np.concatenate(keys), np.append(np.concatenate(starts), n)
        self.top = int(self.members.max())
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # a key may run over batches
        order = np.argsort(key[first], kind="stable")
        self.keys, self.begin = key[first][order], at[first][order]
        self.end = np.append(at[first[1:]], at[-1])[order]

    def of(self, keys: np.ndarray, above: int) -> list[np.ndarray]:
        """Their members above one."""
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        i = i[self.keys[i] == keys]
        lists = (self.members[x:y] for x, y in zip(self.begin[i].tolist(), self.end[i].tolist(), strict=True))
        return [x[np.searchsorted(x, above, "right") :] for x in lists if x[-1] > above]


def _common(lists: list[np.ndarray], least: int) -> np.ndarray:
    """What is in at least ``least`` of the lists."""
    if len(lists) < least:
        return np.zeros(0, np.int64)
    lists = sorted(lists, key=len)
    walked, n = lists[: len(lists) - least + 1], sum(len(x) for x in lists[: len(lists) - least + 1])
    for x in lists[len(walked) :]:
        if len(x) > LONG * n:
            break
        walked.append(x)
        n += len(x)
    every = np.sort(np.concatenate(walked))
    rest = lists[len(walked) :]
    k = least - len(rest)  # at least so many of those that were walked
    found = np.unique(every[: len(every) - k + 1][every[k - 1 :] == every[: len(every) - k + 1]])
    if rest and len(found):
        times = np.searchsorted(every, found, "right") - np.searchsorted(every, found, "left")
        for x in rest:
            times += x[np.minimum(np.searchsorted(x, found), len(x) - 1)] == found
        found = found[times >= least]
    return found


def _found(lists: _Lists, batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    wait, n = [], 0
    keys, to = np.asarray(batch.column(1).flatten()), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(1))))))

    def rows() -> pa.RecordBatch:
        b = np.concatenate([x for _, x in wait])
        a = np.repeat(np.array([x for x, _ in wait], np.int64), [len(x) for _, x in wait])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for a, x, y in zip(batch.column(0).to_pylist(), to[:-1].tolist(), to[1:].tolist(), strict=True):
        if a >= lists.top:
            continue
        b = _common(lists.of(keys[x:y], a), least)
        for k in range(0, len(b), OUT_ROWS):
            wait.append((a, b[k : k + OUT_ROWS]))
            n += len(wait[-1][1])
            if n >= OUT_ROWS:
                yield rows()
                wait, n = [], 0
    if wait:
        yield rows()
