"""Communities, themes and their upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def local_moving(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, sweeps: int = 32) -> dict:
    """Louvain's local moving on one graph: nodes go, in order of id, to the neighbouring community of most gain (ties: the smallest)."""
    near: dict = {}
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if a != b:
            near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0.0) + w
    degree = {v: sum(x.values()) for v, x in near.items()}
    two_m = sum(degree.values()) or 1.0
    of = {v: v for v in near}
    total = dict(degree)
    for _ in range(sweeps):
        moved = False
        for v in sorted(near):
            total[of[v]] -= degree[v]
            gain = {of[v]: 0.0}
            for u, w in near[v].items():
                gain[of[u]] = gain.get(of[u], 0.0) + w
            score = {c: g - total[c] * degree[v] / two_m for c, g in gain.items()}
            best = min(score, key=lambda c: (-round(score[c], 12), c))
            if score[best] <= score[of[v]] + 1e-12:
                best = of[v]
            moved |= best != of[v]
            of[v] = best
            total[best] += degree[v]
        if not moved:
            break
    return of


def communities_by_group(edges: DataFrame, group: str, *, least_nodes: int = 50, least_edges: int = 10) -> DataFrame:
    """(group, node, community) of the graph inside each group, such as a theme; small graphs are left out."""
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pd.unique(pdf[["source_id", "target_id"]].to_numpy().ravel())
        if len(nodes) < least_nodes or len(pdf) < least_edges:
            return pd.DataFrame({group: [], "node": [], "community": []}).astype({group: pdf[group].dtype})
        of = local_moving(pdf["source_id"].to_numpy(), pdf["target_id"].to_numpy(), pdf["weight"].to_numpy())
        return pd.DataFrame({group: pdf[group].iloc[0], "node": list(of), "community": list(of.values())})

    return edges.select(group, "source_id", "target_id", "weight").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, node long, community long")


def communities(edges: DataFrame, *, rounds: int = 8) -> DataFrame:
    """(node, community) of a whole graph (source_id, target_id, weight) without gathering it.

    Synchronous local moving: in each round the nodes of one half (by hash, in turns) go to the
    neighbouring community of most modularity gain; degrees and totals are aggregates.
    """
    both = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), "weight").unionAll(edges.select("target_id", "source_id", "weight")).where("u <> v").groupBy("u", "v").agg(F.sum("weight").alias("w"))
    both = stored(both, "graph")
    degree = stored(both.groupBy("u").agg(F.sum("w").alias("d")), "degrees")
    two_m = degree.agg(F.sum("d")).first()[0] or 1.0
    now = stored(degree.select(F.col("u").alias("node"), F.col("u").alias("community")), "communities")
    for k in range(rounds):
        total = now.join(degree, now["node"] == degree["u"]).groupBy("community").agg(F.sum("d").alias("total"))
        links = both.join(now.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = now.select("node", F.col("community").alias("own"))
        links = links.unionByName(now.withColumn("w", F.lit(0.0))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        x = links.join(own, "node").join(degree.select(F.col("u").alias("node"), "d"), "node").join(total, "community")
        score = F.round(F.col("w") - (F.col("total") - F.when(F.col("community") == F.col("own"), F.col("d")).otherwise(0.0)) * F.col("d") / two_m, 9)
        best = x.groupBy("node", "own").agg(F.min(F.struct((-score).alias("s"), (F.col("community") != F.col("own")).alias("m"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        new = stored(best.select("node", F.when(turn, F.col("b.community")).otherwise(F.col("own")).alias("community")), "communities")
        now = new
    return now


def modularity(edges: DataFrame, of: DataFrame) -> float:
    """Of an assignment (node, community): one pass of joins and sums."""
    c = lambda v, n: of.select(F.col("node").alias(v), F.col("community").alias(n))
    e = edges.where("source_id <> target_id").join(c("source_id", "cs"), "source_id").join(c("target_id", "ct"), "target_id")
    inside = e.agg(F.sum(F.when(F.col("cs") == F.col("ct"), F.col("weight"))), F.sum("weight")).first()
    ends = e.select(F.col("cs").alias("c"), "weight").unionAll(e.select("ct", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    m = inside[1] or 1.0
    return float((inside[0] or 0.0) / m - (ends.agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0] or 0.0))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """1 for equal directions; null where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def centroids(vectors: DataFrame, by: str, digits: int | None = None) -> DataFrame:
    """(by, centre): the mean vector of each group, by partial sums for each component."""
    mean = F.avg("x") if digits is None else F.round(F.avg("x"), digits)
    parts = vectors.select(by, F.posexplode("vec").alias("dim", "x")).groupBy(by, "dim").agg(mean.alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centre"))


#: Bytes up to which centroids may be broadcast.
BROADCAST_BYTES = 32 << 20


def nearest(vectors: DataFrame, centres: DataFrame, by: str) -> DataFrame:
    """(claim_id, by, similarity): the centre of the largest cosine, then the smallest.

    Centres are gathered into one row and looked through in place, so nothing is paired; that
    row is checked to be small.
    """
    n = centres.select(F.count("*"), F.coalesce(F.max(F.size("centre")), F.lit(0))).first()
    if n[0] * n[1] * 8 > BROADCAST_BYTES:
        raise ValueError("too many centres: assign by a tree of themes")
    one = centres.agg(F.collect_list(F.struct(F.col(by).alias("k"), "centre")).alias("all"))
    scored = vectors.join(F.broadcast(one)).withColumn("s", F.transform("all", lambda c: F.struct(F.round(cosine(F.col("vec"), c["centre"]), 9).alias("s"), (-c["k"]).alias("k"))))
    best = F.array_max("s")
    return scored.select("claim_id", (-best["k"]).alias(by), best["s"].alias("similarity"))


def k_means(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """(claim_id, cluster) by the distributed k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select("claim_id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=iterations).fit(points).transform(points).select("claim_id", F.col("prediction").alias("cluster"))
