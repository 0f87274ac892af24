"""Traversal and closure as level-by-level joins over an edge table.

Each round is a join with the frontier and an anti-join with what was seen, so the number of
paths does not matter and depth is the least number of hops. Rounds end early when the
frontier is empty; every round is written to shared storage, which cuts the lineage. The edges
are written once, as the columns that the rounds need, and stay where they are while the
frontier is small enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds, stored
from . import components as stars
from .skew import BROADCAST_BYTES


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, *, by: tuple[str, ...] = (), include_seeds: bool = True) -> DataFrame:
    """(by..., node, depth): what ``seeds`` (by..., node) reach over ``edges`` (src, dst) in at most ``max_depth`` hops.

    ``by`` keeps several starts apart.
    """
    keys = [*by, "node"]
    e = stored(edges.select("src", "dst"), "graph")
    front = stored(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = front
    for depth in range(1, max_depth + 1):
        n = front.count()
        if not n:
            break
        now = F.broadcast(front) if 32 * len(keys) * n <= BROADCAST_BYTES else front
        step = e.join(now, e["src"] == now["node"]).select(*by, F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, keys, "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # a plan of bounded size
            seen = stored(seen, "seen")
    return seen if include_seeds else seen.where("depth > 0")


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) of edges (source_id, target_id): out, in or both."""
    out = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def lowest_common_ancestors(edges: DataFrame, members: DataFrame, keys: list[str], max_depth: int) -> DataFrame:
    """(a, b, ancestor, total) with a < b of ``members`` (node, keys...) that share the keys: the common ancestor with the fewest hops, then the smallest.

    Members meet at their ancestors, so pairs without one are never made.
    """
    m = members.dropna(subset=keys).select("node", *keys).distinct()
    above = reach(oriented(edges, "in"), m.select(F.col("node").alias("start"), "node"), max_depth, by=("start",))
    above = stored(above.join(m.withColumnRenamed("node", "start"), "start"), "ancestors")
    x, y = above.withColumnsRenamed({"start": "a", "depth": "da"}), above.withColumnsRenamed({"start": "b", "depth": "db"})
    both = x.join(y, [*keys, "node"]).where("a < b").withColumn("total", F.col("da") + F.col("db"))
    return both.groupBy("a", "b").agg(F.min(F.struct("total", "node")).alias("m")).select("a", "b", F.col("m.node").alias("ancestor"), F.col("m.total").alias("total"))


def on_cycles(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(claim_id): nodes on a directed cycle of any length.

    Nodes without a way in or out are peeled off. Each other node takes the least node that
    reaches it as its colour; those of a colour that reach its node in turn are a strong
    component. These go, and the rest starts anew. No pairs of nodes are ever listed.
    """
    spark = edges.sparkSession
    e = oriented(edges, "out")
    found = [stored(e.where("src = dst").select(F.col("src").alias("claim_id")), "loops")]
    left, labels = Rounds(spark, "edges"), Rounds(spark, "colours")
    e = left.put(e.where("src <> dst"))
    n = e.count()
    for _ in range(most_rounds):
        while True:
            e = left.put(e.join(e.select(F.col("dst").alias("src")), "src", "left_semi").join(e.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
            n, before = e.count(), n
            if n == before:
                break
        if not n:
            out = found[0]
            for f in found[1:]:
                out = out.union(f)
            return out.distinct()
        colour = labels.put(e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("m")).select("node", F.least("node", "m").alias("colour"), F.lit(True).alias("moved")))
        while not colour.where("moved").isEmpty():
            near = e.join(colour.where("moved").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("m"))
            near = colour.join(near, "node", "left")
            colour = labels.put(near.select("node", F.least("colour", "m").alias("colour"), F.coalesce(F.col("m") < F.col("colour"), F.lit(False)).alias("moved")))
        c = lambda v: colour.select(F.col("node").alias(v), F.col("colour").alias(f"c_{v}"))
        same = e.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst")
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"), most_rounds)
        back = stored(back.join(colour.select("node", "colour"), "node").select("node", "colour"), "strong")
        strong = back.join(back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1"), "colour").select(F.col("node").alias("claim_id"))
        found.append(stored(strong, "on-cycles"))
        gone = back.select(F.col("node").alias("src"))
        e = left.put(e.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
        n = e.count()
    raise RuntimeError(f"no end after {most_rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (src, dst); the root is the smallest node."""
    return stars.components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def topological_levels(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """(node, level): peeling nodes without incoming edges; nodes on or behind a cycle get no row."""
    spark = edges.sparkSession
    held, open_ = Rounds(spark, "edges"), Rounds(spark, "nodes")
    left = held.put(oriented(edges, "out"))
    nodes = open_.put(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    levels = None
    for level in range(most_rounds):
        free = stored(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        levels = free if levels is None else levels.unionByName(free)
        if free.isEmpty():
            return levels
        if level % 16 == 15:  # a plan of bounded size
            levels = stored(levels, "levels")
        nodes = open_.put(nodes.join(free, "node", "left_anti").select("node"))
        left = held.put(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    raise RuntimeError(f"more than {most_rounds} levels")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, coefficient) of an undirected simple graph; edges are taken once.

    Each edge points to its end of higher degree, so a hub lists no pairs of its many neighbours.
    """
    e = oriented(edges, "out").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    e = stored(e, "simple")
    deg = e.select(F.col("a").alias("node")).unionAll(e.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    rank = lambda n: deg.select(F.col("node").alias(n), F.struct("degree", "node").alias(f"r{n}"))
    way = e.join(rank("a"), "a").join(rank("b"), "b").select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("hi"))
    way = stored(way, "directed")
    x, y = way.select("lo", F.col("hi").alias("p")), way.select("lo", F.col("hi").alias("q"))
    wedges = x.join(y, "lo").where("p < q")
    tri = wedges.join(e.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"])
    per = tri.select(F.explode(F.array("lo", "p", "q")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = deg.where("degree >= 2").join(per, "node", "left").fillna(0, ["triangles"])
    return out.withColumn("coefficient", 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))


def strongest_paths(edges: DataFrame, least: float, most_rounds: int = 50) -> DataFrame:
    """(a, b, s): greatest product of strengths over paths from a to b, where above ``least``.

    Strengths are at most 1, so products only fall and the loop ends; a pair keeps its best only.
    """
    e = stored(edges.where("a <> b").groupBy("a", "b").agg(F.max("s").alias("s")), "strengths")
    best = stored(e, "paths")
    front = best
    for _ in range(most_rounds):
        step = e.alias("e").join(front.alias("f"), F.col("e.b") == F.col("f.a")).select(F.col("e.a").alias("a"), F.col("f.b").alias("b"), (F.col("e.s") * F.col("f.s")).alias("s"))
        step = step.where((F.col("s") > least) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.max("s").alias("s"))
        front = stored(step.join(best.withColumnRenamed("s", "old"), ["a", "b"], "left").where("old IS NULL OR s > old").select("a", "b", "s"), "front")
        if front.isEmpty():
            return best
        best = stored(best.unionByName(front).groupBy("a", "b").agg(F.max("s").alias("s")), "paths")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def rolled_up(edges: DataFrame, parent_of: DataFrame) -> DataFrame:
    """Edges between parts as edges between their wholes: (source_id, target_id, weight, n)."""
    p = lambda c: parent_of.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_parent"))
    e = edges.join(p("source_id"), "source_id").join(p("target_id"), "target_id").where("source_id_parent <> target_id_parent")
    return e.groupBy(F.col("source_id_parent").alias("source_id"), F.col("target_id_parent").alias("target_id")).agg(F.sum("strength").alias("weight"), F.count("*").alias("n"))


def roots_of(parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root, hops) of (node, parent) forests by pointer doubling; a cycle is an error."""
    rounds = Rounds(parents.sparkSession, "pointers")
    now = rounds.put(parents.select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("hops")))
    for _ in range(most_rounds):
        nxt = now.select(F.col("node").alias("root"), F.col("root").alias("up"), F.col("hops").alias("more"))
        new = rounds.put(now.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("up").isNotNull().alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now.withColumn("hops", F.col("hops").cast("int"))
    raise RuntimeError("parents form a cycle")


def degree_rank(edges: DataFrame) -> DataFrame:
    """In and out degree of each node."""
    out = edges.groupBy(F.col("source_id").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("target_id").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(into, "node", "full").fillna(0, ["n_in", "n_out"])


def first_by(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
