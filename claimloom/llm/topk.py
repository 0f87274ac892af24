"""Exact top-k by inner product with a vector-approximation file.

``build`` stores vectors in blocks. The approximation file is a table: ids and one byte a component
(the cell of a grid between the least and the largest value of each component). The exact
integers lie in files beside it; a block's row says where. For a query, a cell bounds
each product q[d] * x[d] from both sides, so the cells alone bound every score.

Queries are asked block by block; a block of at most ``QUERY_BYTES`` is broadcast, and the file
stays where it is. There are two scans of the cells:

1. the kth largest lower bound that a task sees for a query; the largest of these over all
   tasks is a floor under the query's kth score;
2. only vectors whose upper bound is at the floor or above are read, by ranges of the exact
   files, in order of falling upper bound, until the kth exact score that the task holds is above
   every bound left. A task gives k rows for a query at most; they are ranked by query.

So shuffles hold k rows for each query and task, and no vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part, neither do rows without an id; a query's own id is no candidate; repeated
rows are candidates each, and of queries with one id the least vector is asked; only vectors of a query's own length are compared; ties go to
the smaller id; fewer candidates than k give fewer rows; extra columns take no part; a score that
64 bits cannot hold is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, stored
from .files import filesystem

#: Vectors of a block, queries bounded at once, and bytes of a block of queries.
BLOCK, STEP, QUERY_BYTES = 4096, 256, 4 << 20
CELLS = 256
#: Vectors of one block less than this many bytes apart are read at once.
JOIN_GAP = 16 << 10
FILE = "dim int, n int, ids binary, low binary, width binary, cells binary, file string, position long"
FOUND = "query_id long, vec_id long, score long"


def usable(vec: Column) -> Column:
    """Whether a vector can take part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def scaled(vec: Column, factor: int) -> Column:
    """Integers floor(factor * x)."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def _by_dim(batches: Iterator[pa.RecordBatch], size) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (dim, ids, vectors) of rows (id, vec) of one length; size(dim) rows at most."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush(dim: int, rest: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, vecs = (np.concatenate([x[i] for x in held[dim]]) for i in (0, 1))
        step = size(dim)
        full = len(ids) if rest else len(ids) // step * step
        for at in range(0, full, step):
            yield dim, ids[at : min(at + step, full)], vecs[at : min(at + step, full)]
        held[dim] = [(ids[full:], vecs[full:])]

    for batch in batches:
        ids, lists = np.asarray(batch.column(0)), batch.column(1)
        length = np.asarray(lists.value_lengths())
        values = np.asarray(lists.flatten(), dtype=np.int64)
        ends = np.cumsum(length)
        for dim in np.unique(length).tolist():
            mine = np.flatnonzero(length == dim)
            at = (ends[mine] - dim)[:, None] + np.arange(dim)
            held.setdefault(dim, []).append((ids[mine], values[at]))
            if sum(len(a) for a, _ in held[dim]) >= size(dim):
                yield from flush(dim, False)
    for dim in list(held):
        yield from flush(dim, True)


def _row(values: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[k]) for x, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def integer_rows(vectors: DataFrame, factor: int) -> DataFrame:
    """Usable vectors (id, vec) as integers."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).select("id", scaled(F.col("vec"), factor).alias("vec"))


def build(vectors: DataFrame, factor: int = 1024, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """The stored approximation file of ``vectors`` (id, vec), with the exact vectors beside it."""
    folder = folder or scratch(vectors.sparkSession, "va-exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, name = None, ""
        for dim, ids, v in _by_dim(batches, lambda dim: block):
            if not len(ids):
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                name = f"{root}/{uuid.uuid4().hex}.vec"  # of this attempt; the stored table names those of committed ones
                out = fs.open_output_stream(name, compression=None)
            low, high = v.min(axis=0).astype(np.float64), v.max(axis=0).astype(np.float64)
            width = np.maximum((high - low) / CELLS, 1e-9)
            cells = np.clip((v - low) // width, 0, CELLS - 1).astype(np.uint8)
            yield _row([dim, len(ids), ids.astype("<i8").tobytes(), low.tobytes(), width.tobytes(), cells.tobytes(), name, out.tell()], FILE)
            out.write(v.astype("<i8").tobytes())
        if out is not None:
            out.close()

    rows = integer_rows(vectors, factor).select("id", "vec")
    return stored(rows.mapInArrow(run, FILE), "va-file", **{"parquet.block.size": str(16 << 20)})


class Exact:
    """Vectors of one block, by ranges of its file, each read once."""

    def __init__(self, file: str, position: int, n: int, dim: int):
        self.fs, self.path = filesystem(file)
        self.position, self.dim = position, dim
        self.at = np.full(n, -1, np.int64)
        self.vectors = np.zeros((0, dim), np.int64)

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """Vectors of these places in the block."""
        new = np.unique(wanted[self.at[wanted] < 0])
        if len(new):
            size = 8 * self.dim
            cut = np.flatnonzero(np.diff(new) * size > JOIN_GAP + size) + 1
            got = []
            with self.fs.open_input_file(self.path) as f:
                for run in np.split(new, cut):
                    first, n = int(run[0]), int(run[-1] - run[0]) + 1
                    data = np.frombuffer(f.read_at(n * size, self.position + first * size), "<i8").reshape(n, self.dim)
                    got.append(data[run - first])
            self.at[new] = len(self.vectors) + np.arange(len(new))
            self.vectors = np.concatenate((self.vectors, *got))
        return self.vectors[self.at[wanted]]


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products (queries x vectors)."""
    q = queries.astype(np.float64)
    middle = (cells.astype(np.float64) + 0.5) * width + low
    centre = q @ middle.T
    # half a cell each way; values at the top edge lie in the last cell. The last terms cover rounding.
    reach = np.abs(q) @ (width / 2) + 1e-9 * (np.abs(q) @ np.abs(middle).max(axis=0)) + 1e-6
    return centre - reach[:, None], centre + reach[:, None]


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integer rows with a query; exact, or an error."""
    if float(np.abs(q.astype(np.float64)).sum()) * float(np.abs(x.astype(np.float64)).max(initial=0)) < 2**62:
        return x @ q
    return np.array([sum(a * b for a, b in zip(r, q.tolist(), strict=True)) for r in x.tolist()], dtype=object).astype(np.int64)


class Best:
    """The k best (score, id) of one query: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def kth(self) -> float:
        return int(self.scores[-1]) if len(self.scores) == self.k else -np.inf


def _cells(r: dict) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return np.frombuffer(r["ids"], "<i8"), (np.frombuffer(r["low"]), np.frombuffer(r["width"]), np.frombuffer(r["cells"], np.uint8).reshape(r["n"], r["dim"]))


def search(file: DataFrame, queries: DataFrame, k: int = 10, factor: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    spark = file.sparkSession

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, v in _by_dim(batches, lambda dim: max(1, QUERY_BYTES // (8 * dim))):
            if len(ids):
                yield _row([dim, ids.astype("<i8").tobytes(), v.astype("<i8").tobytes()], "dim int, ids binary, exact binary")

    distinct = stored(integer_rows(queries, factor).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    size = distinct.agg(F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()[0]
    asked = distinct.coalesce(max(1, 8 * size // QUERY_BYTES)).select("id", "vec")  # few blocks that are not full
    asked = stored(asked.mapInArrow(gather, "dim int, ids binary, exact binary").withColumn("number", F.monotonically_increasing_id()), "query-blocks")
    found = None
    for number in [r["number"] for r in asked.select("number").collect()]:  # one for each QUERY_BYTES of queries
        block = asked.where(F.col("number") == number).first()
        q_ids = np.frombuffer(block["ids"], "<i8")
        part = stored(_asked(file, block["dim"], q_ids, np.frombuffer(block["exact"], "<i8").reshape(len(q_ids), block["dim"]), k), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asked(file: DataFrame, dim: int, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """For one block of queries the k best of each task."""
    context = file.sparkSession.sparkContext
    own = file.where(F.col("dim") == dim)
    sent = context.broadcast((q_ids, q))  # QUERY_BYTES and the ids

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        best = np.full((len(q), k), -np.inf)
        for batch in batches:
            for r in batch.to_pylist():
                ids, cells = _cells(r)
                for a in range(0, len(q), STEP):
                    low, _ = bounds(q[a : a + STEP], *cells)
                    low[q_ids[a : a + STEP, None] == ids[None, :]] = -np.inf
                    both = np.concatenate((best[a : a + STEP], low), axis=1)
                    best[a : a + STEP] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(best.min(axis=1))], ["query_id", "floor"])

    low = own.select("dim", "n", "ids", "low", "width", "cells").mapInArrow(floors, "query_id long, floor double")
    rows = low.groupBy("query_id").agg(F.max("floor").alias("floor")).toArrow()  # a row for each query of the block
    of = dict(zip(rows["query_id"].to_pylist(), rows["floor"].to_pylist(), strict=True))
    floor = context.broadcast(np.array([of.get(i, -np.inf) for i in q_ids.tolist()]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, q), least = sent.value, floor.value.copy()
        best = [Best(k) for _ in q_ids]
        for batch in batches:
            for r in batch.to_pylist():
                ids, cells = _cells(r)
                vectors = Exact(r["file"], r["position"], r["n"], dim)
                for a in range(0, len(q), STEP):
                    _, high = bounds(q[a : a + STEP], *cells)
                    high[q_ids[a : a + STEP, None] == ids[None, :]] = -np.inf
                    reach = high >= np.maximum(least[a : a + STEP], np.finfo(np.float64).min)[:, None]
                    for i in np.flatnonzero(reach.any(axis=1)).tolist():
                        some = np.flatnonzero(reach[i])
                        some = some[np.argsort(-high[i, some], kind="stable")]
                        mine, at, step = best[a + i], 0, 4 * k
                        while at < len(some) and high[i, some[at]] >= least[a + i]:  # no bound left reaches the kth score
                            part = some[at : at + step]
                            part = part[high[i, part] >= least[a + i]]
                            mine.add(ids[part], _scores(vectors.rows(part), q[a + i]))
                            least[a + i] = max(least[a + i], mine.kth())
                            at, step = at + step, 2 * step
        cols = [np.concatenate([np.full(len(b.ids), i) for i, b in zip(q_ids.tolist(), best, strict=True)]), *(np.concatenate([getattr(b, x) for b in best]) for x in ("ids", "scores"))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], [f.split()[0] for f in FOUND.split(", ")])

    return own.mapInArrow(exact, FOUND)
