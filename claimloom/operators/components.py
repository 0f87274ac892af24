"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Rounds, ship
from .skew import hot_limit, join_split

#: Edges that a task contracts at once, and edges of the forest it holds before it lets them go.
STEP_EDGES, HELD_EDGES = 1 << 18, 1 << 20


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forest of these edges as stars: each node that is not the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        # the roots of both ends take the smaller label, then all nodes point to their root
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[leaf], nodes[label[leaf]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, from as many edges at a time as memory allows."""
    u = v = np.zeros(0, np.int64)
    fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + (1 << 16)]), pa.array(v[i : i + (1 << 16)])], ["u", "v"])

    waiting = 0
    for batch in batches:
        fresh.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        waiting += batch.num_rows
        if waiting >= STEP_EDGES:
            u, v = least_of(np.concatenate([u, *(x for x, _ in fresh)]), np.concatenate([v, *(y for _, y in fresh)]))
            fresh, waiting = [], 0
            if len(u) > HELD_EDGES:
                yield from out()
                u = v = np.zeros(0, np.int64)
    if waiting:
        u, v = least_of(np.concatenate([u, *(x for x, _ in fresh)]), np.concatenate([v, *(y for _, y in fresh)]))
    yield from out()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task replaces its own by stars. Only long nodes; others as they are."""
    if any(t != "bigint" for _, t in edges.dtypes):
        return edges
    return edges.mapInArrow(_contract, "u long, v long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """Rows, those of the largest hub, and the nodes that keep the edges from being stars around their smallest nodes."""
    up, down = F.count(F.when(F.col("v") < F.col("u"), 1)), F.count(F.when(F.col("v") > F.col("u"), 1))
    by = _both(edges).groupBy("u").agg(up.alias("up"), down.alias("down"))
    loose = F.count(F.when((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0)), 1))
    return tuple(by.agg(F.coalesce(F.sum(F.col("up") + F.col("down")), F.lit(0)), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0)), loose).first())


def _to_least(rows: DataFrame, low: DataFrame, state: tuple) -> DataFrame:
    """``rows`` with the least neighbour of their u; hubs, where there are any, stay in place."""
    if state[1] > hot_limit(state[0]):
        return join_split(rows, low, "u", "n", state[0])
    return rows.join(low.drop("n"), "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component.

    ``edges`` has columns u and v of one orderable type. Each task first replaces the edges it
    holds by stars (``contracted``). Each round is an aggregation and a
    join on the node, where the rows of hubs are not shuffled (``join_split``); nothing of the graph reaches
    the driver but the sums of ``_state``, which tell when only stars around smallest nodes are left. Rounds grow as the logarithm of the
    longest path. A round's table goes when the next is written. Self loops, repeated
    edges and edges with a null end are allowed; the latter are left out.
    """
    ship(edges.sparkSession)
    rounds = Rounds(edges.sparkSession, "edges")
    whole = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    whole = contracted(whole.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    now = rounds.put(whole.distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[2]:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        # large star: all larger neighbours of u go to the smallest one around u
        around = _both(now)
        low = around.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select("u", F.least("u", "w").alias("w"), "n")
        large = _to_least(around.where("v > u"), low, state).select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v")
        # small star: all smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n"))
        small = _to_least(large, low, state).where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        now = rounds.put(small.unionByName(low.select("u", F.col("w").alias("v"))).distinct())
        state = _state(now)
    raise RuntimeError(f"not only stars after {most_rounds} rounds")
