"""Traversals, closures and pattern queries over the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure, gql
from ..operators import graph as G
from .registry import plan

R6 = lambda c: F.round(c, 6)


def _reach_sql(seed: str, edge: str, depth: int, tail: str = "SELECT node AS claim_id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1") -> str:
    return f"WITH RECURSIVE e AS ({edge}), w(node, depth) AS (SELECT node, 0 FROM ({seed}) s UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < {depth}) {tail}"


DAG_IN, DAG_OUT = "SELECT target_id AS src, source_id AS dst FROM dag", "SELECT source_id AS src, target_id AS dst FROM dag"
#: Hops that a lineage may take.
DEEPEST = 100
SURE = "SELECT claim_id AS node FROM claims WHERE truth_value >= 98e-2"


def _sure(t):
    """The seeds: the claims that are as good as certain."""
    return t.sql(SURE)


def _named(df):
    return df.withColumnRenamed("node", "claim_id")


@plan(_reach_sql(SURE, DAG_IN, DEEPEST))
def ancestor_lineage(t):
    return _named(G.reach(G.oriented(t.dag, "in"), _sure(t), DEEPEST))


@plan(_reach_sql(SURE, DAG_OUT, DEEPEST))
def descendant_lineage(t):
    return _named(G.reach(G.oriented(t.dag, "out"), _sure(t), DEEPEST))


@plan(_reach_sql(SURE, DAG_IN, DEEPEST, "SELECT max(d) AS depth, count(*) AS n FROM (SELECT node, CAST(min(depth) AS INT) AS d FROM w GROUP BY 1) z"))
def lineage_depth(t):
    return G.reach(G.oriented(t.dag, "in"), _sure(t), DEEPEST).agg(F.max("depth").alias("depth"), F.count("*").alias("n"))


@plan(_reach_sql("SELECT 7 AS node", "SELECT source_id AS src, target_id AS dst FROM edges WHERE relationship <> 'elaborates' UNION SELECT target_id, source_id FROM edges WHERE relationship <> 'elaborates'", 2))
def epistemic_neighbourhood(t):
    e = t.edges.where("relationship <> 'elaborates'")
    return _named(G.reach(G.oriented(e, "both"), t.claims.where("claim_id = 7").select(F.col("claim_id").alias("node")), 2))


@plan(_reach_sql("SELECT claim_id AS node FROM claims WHERE claim_id IN (3, 11, 42)", "SELECT source_id AS src, target_id AS dst FROM edges WHERE relationship IN ('supports', 'elaborates')", 2,
      "SELECT node AS claim_id, CAST(min(depth) AS INT) AS hops, round(pow(7e-1, min(depth)), 6) AS decay FROM w WHERE node NOT IN (3, 11, 42) GROUP BY 1 ORDER BY hops, claim_id LIMIT 200"))
def seed_expansion(t):
    """Supporting neighbours of seeds in few hops; the cut at 200 is by hops, then id."""
    e = t.edges.where("relationship IN ('supports', 'elaborates')")
    seeds = t.claims.where("claim_id IN (3, 11, 42)").select(F.col("claim_id").alias("node"))
    got = G.reach(G.oriented(e, "out"), seeds, 2, include_seeds=False)
    return got.orderBy("depth", "node").limit(200).select(F.col("node").alias("claim_id"), F.col("depth").alias("hops"), R6(F.pow(F.lit(0.7), "depth")).alias("decay"))


PAIRS = "SELECT x.claim_id AS a, y.claim_id AS b FROM claims x JOIN claims y ON x.brand = y.brand AND x.kind = y.kind AND x.claim_id < y.claim_id"


@plan(f"""WITH RECURSIVE e AS ({DAG_IN}), p AS ({PAIRS}), w(start, node, depth) AS (SELECT a, a, 0 FROM p UNION SELECT b, b, 0 FROM p UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3),
m AS (SELECT start, node, min(depth) AS d FROM w GROUP BY 1, 2), c AS (SELECT p.a, p.b, x.node, x.d + y.d AS total FROM p JOIN m x ON x.start = p.a JOIN m y ON y.start = p.b AND y.node = x.node)
SELECT a, b, node AS ancestor, CAST(total AS INT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY total, node) AS k FROM c) z WHERE k = 1""")
def lowest_common_ancestor(t):
    return G.lowest_common_ancestors(t.dag, t.claims.select(F.col("claim_id").alias("node"), "brand", "kind"), ["brand", "kind"], 3)


@plan("""WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM edges), w(start, node) AS (SELECT source_id, target_id FROM e UNION SELECT w.start, e.target_id FROM w JOIN e ON e.source_id = w.node) SELECT start AS claim_id FROM w WHERE start = node""")
def cycle_detection(t):
    """Claims on a cycle of any length."""
    return G.on_cycles(t.edges)


ALTERNATIVES = "SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE relationship = 'supports'"


@plan(f"""WITH RECURSIVE s AS ({ALTERNATIVES}), e AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s), w(node, root) USING KEY (node) AS (SELECT src, min(least(src, dst)) FROM e GROUP BY 1 UNION SELECT e.dst, min(w.root) FROM w JOIN e ON e.src = w.node JOIN recurring.w AS old ON old.node = e.dst WHERE w.root < old.root GROUP BY 1),
m AS (SELECT root, count(*) AS members FROM w GROUP BY 1) SELECT node AS claim_id, root, members FROM w JOIN m USING (root)""")
def alternative_sets(t):
    """Symmetric transitive closure of alternatives; a claim is a member of its own set."""
    c = G.components(t.sql(ALTERNATIVES))
    return c.join(c.groupBy("root").agg(F.count("*").alias("members")), "root").select(F.col("node").alias("claim_id"), "root", "members")


PAPER = "SELECT DISTINCT l_suppkey AS paper_id, l_partkey AS claim_id FROM lineitem"


@plan(f"""WITH p AS ({PAPER}), k AS (SELECT paper_id, claim_id FROM p UNION SELECT paper_id, target_id FROM p JOIN edges ON source_id = claim_id WHERE relationship = 'elaborates' UNION SELECT paper_id, source_id FROM p JOIN edges ON target_id = claim_id WHERE relationship = 'elaborates')
SELECT c.claim_id, c.other_id, EXISTS (SELECT 1 FROM k x JOIN k y USING (paper_id) WHERE x.claim_id = c.claim_id AND y.claim_id = c.other_id) AS same_source FROM (SELECT claim_id, claim_id + 1 AS other_id FROM claims) c""")
def same_source_pairs(t):
    """Whether two claims share a paper, directly or by an edge within the source."""
    papers = t.sql(PAPER)
    inside = t.edges.where("relationship = 'elaborates'")
    near = G.oriented(inside, "both").join(papers.withColumnRenamed("claim_id", "src"), "src").select("paper_id", F.col("dst").alias("claim_id"))
    k = papers.select("paper_id", "claim_id").union(near).distinct()
    pairs = t.claims.select("claim_id", (F.col("claim_id") + 1).alias("other_id"))
    hit = pairs.join(k, "claim_id").join(k.select("paper_id", F.col("claim_id").alias("other_id")), ["paper_id", "other_id"]).select("claim_id", "other_id").distinct().withColumn("same_source", F.lit(True))
    return pairs.join(hit, ["claim_id", "other_id"], "left").fillna(False, ["same_source"])


@plan("SELECT source_id AS node, min(target_id) AS parent FROM dag GROUP BY 1", name="derivation_parents")
def derivation_parents(t):
    return t.dag.groupBy(F.col("source_id").alias("node")).agg(F.min("target_id").alias("parent"))


@plan("""WITH RECURSIVE p AS (SELECT source_id AS node, min(target_id) AS parent FROM dag GROUP BY 1), w(node, root, hops) AS (SELECT node, parent, 1 FROM p UNION ALL SELECT w.node, p.parent, w.hops + 1 FROM w JOIN p ON p.node = w.root)
SELECT node AS claim_id, root, CAST(hops AS INT) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops DESC) AS k FROM w) z WHERE k = 1""")
def derivation_roots(t):
    """Root of each claim along first parents, by pointer doubling."""
    return G.roots_of(derivation_parents(t)).withColumnRenamed("node", "claim_id")


@plan("""WITH e AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges), s AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT x, count(*) AS degree FROM s GROUP BY 1),
tr AS (SELECT p.x, count(*) AS n FROM s p JOIN s q ON p.x = q.x AND p.y < q.y JOIN e ON e.a = p.y AND e.b = q.y GROUP BY 1)
SELECT d.x AS claim_id, degree, coalesce(n, 0) AS triangles, round(2 * coalesce(n, 0) / (degree * (degree - 1)), 6) AS coefficient FROM d LEFT JOIN tr ON tr.x = d.x WHERE degree >= 2""")
def clustering_coefficient(t):
    got = G.clustering(t.edges)
    return got.select(F.col("node").alias("claim_id"), "degree", "triangles", R6("coefficient").alias("coefficient"))


@plan("SELECT a.brand AS source_brand, b.brand AS target_brand, round(sum(strength), 6) AS weight, count(*) AS n FROM edges JOIN claims a ON a.claim_id = source_id JOIN claims b ON b.claim_id = target_id WHERE a.brand <> b.brand GROUP BY 1, 2")
def compound_projection(t):
    """Edges of parts summed up to their wholes."""
    got = G.rolled_up(t.edges, t.claims.select(F.col("claim_id").alias("node"), F.col("brand").alias("parent")))
    return got.select(F.col("source_id").alias("source_brand"), F.col("target_id").alias("target_brand"), R6("weight").alias("weight"), "n")


THIN = "SELECT DISTINCT source_id, target_id FROM edges WHERE source_id < target_id AND relationship = 'supports'"


@plan(f"""WITH RECURSIVE e AS ({THIN}), n AS (SELECT source_id AS node FROM e UNION SELECT target_id FROM e), w(node, level) AS (SELECT node, 0 FROM n UNION SELECT e.target_id, w.level + 1 FROM w JOIN e ON e.source_id = w.node) SELECT node AS claim_id, CAST(max(level) AS INT) AS level FROM w GROUP BY 1""")
def topological_order(t):
    return _named(G.topological_levels(t.sql(THIN)))


@plan("SELECT coalesce(o.source_id, i.target_id) AS claim_id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT source_id, count(*) AS n_out FROM edges GROUP BY 1) o FULL JOIN (SELECT target_id, count(*) AS n_in FROM edges GROUP BY 1) i ON o.source_id = i.target_id")
def degrees(t):
    return _named(G.degree_rank(t.edges))


GQL = "MATCH (a:claim)-[r:supports*1..2]->(b) WHERE a.truth_value >= 0.96 RETURN a, b LIMIT 5"
GQL_SEED = "(SELECT claim_id AS node FROM claims WHERE truth_value >= 96e-2 ORDER BY claim_id LIMIT 5)"
SUPPORTS = "SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE relationship = 'supports'"


def _nodes(t):
    return t.claims.select(F.col("claim_id").alias("node"), F.lit("claim").alias("label"), "truth_value", "content")


@plan(_reach_sql(GQL_SEED, SUPPORTS, 2))
def gql_nodes(t):
    return _named(gql.run(GQL, _nodes(t), t.edges)[0])


@plan(_reach_sql(GQL_SEED, SUPPORTS, 2, ", n AS (SELECT DISTINCT node FROM w) SELECT source_id, target_id, relationship, count(*) AS n FROM edges WHERE source_id IN (SELECT node FROM n) AND target_id IN (SELECT node FROM n) GROUP BY 1, 2, 3"))
def gql_edges(t):
    return gql.run(GQL, _nodes(t), t.edges)[1].groupBy("source_id", "target_id", "relationship").agg(F.count("*").alias("n"))


# -- rules to a fixed point ---------------------------------------------------------------------
RULES = {
    "sup": "SELECT source_id AS a, target_id AS b, max(strength) AS s FROM edges WHERE relationship = 'supports' GROUP BY 1, 2",
    "ref": "SELECT source_id AS a, target_id AS b, max(strength) AS s FROM edges WHERE relationship = 'contradicts' GROUP BY 1, 2",
    "ela": "SELECT source_id AS a, target_id AS b, max(strength) AS s FROM edges WHERE relationship = 'elaborates' GROUP BY 1, 2",
}


def _typed(t, name):
    return t.sql(RULES[name])


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({RULES[n]})" for n in names)


@plan(f"{_with('sup', 'ref')} SELECT sup.a, ref.a AS b, sup.b AS target, round(sup.s, 6) AS for_s, round(ref.s, 6) AS against_s FROM sup JOIN ref ON sup.b = ref.b WHERE sup.s > 3e-1 AND ref.s > 3e-1")
def contradictions(t):
    """Supporters and refuters of one claim, both with a strength above 0.3."""
    s = _typed(t, "sup").where("s > 0.3").select("a", F.col("b").alias("target"), R6("s").alias("for_s"))
    r = _typed(t, "ref").where("s > 0.3").select(F.col("a").alias("b"), F.col("b").alias("target"), R6("s").alias("against_s"))
    return s.join(r, "target").select("a", "b", "target", "for_s", "against_s")


@plan(f"{_with('sup', 'ref')}, x AS (SELECT b, count(*) AS n_for, max(s) AS s FROM sup WHERE s > 3e-1 GROUP BY 1), y AS (SELECT b, count(*) AS n_against, max(s) AS s FROM ref WHERE s > 3e-1 GROUP BY 1) SELECT b AS target, n_for, n_against, n_for * n_against AS pairs, round(least(x.s, y.s), 6) AS weaker FROM x JOIN y USING (b)")
def contradiction_classes(t):
    """The same relation without its pairs: a row for each disputed claim, whatever its number of neighbours."""
    side = lambda n, c: _typed(t, n).where("s > 0.3").groupBy(F.col("b").alias("target")).agg(F.count("*").alias(c), F.max("s").alias(f"{n}_s"))
    x = side("sup", "n_for").join(side("ref", "n_against"), "target")
    return x.select("target", "n_for", "n_against", (F.col("n_for") * F.col("n_against")).alias("pairs"), R6(F.least("sup_s", "ref_s")).alias("weaker"))


@plan("SELECT c.claim_id, count(DISTINCT source_id) AS supporters, count(source_id) = 0 AS unsupported FROM claims c LEFT JOIN edges ON target_id = claim_id AND relationship = 'supports' GROUP BY 1")
def support_counts(t):
    n = t.edges.where("relationship = 'supports'").groupBy(F.col("target_id").alias("claim_id")).agg(F.count_distinct("source_id").alias("supporters"))
    got = t.claims.select("claim_id").join(n, "claim_id", "left").fillna(0, ["supporters"])
    return got.withColumn("unsupported", F.col("supporters") == 0)


WEAK = "SELECT source_id AS a, target_id AS b, max(round(strength - 5e-1, 6)) AS s FROM edges WHERE relationship = 'supports' AND source_id < target_id GROUP BY 1, 2"


@plan(f"""WITH RECURSIVE e AS ({WEAK}), w(a, b, s) AS (SELECT a, b, s FROM e WHERE a <> b UNION SELECT e.a, w.b, e.s * w.s FROM e JOIN w ON e.b = w.a WHERE e.s * w.s > 1e-1 AND e.a <> w.b) SELECT a, b, round(max(s), 6) AS s FROM w GROUP BY 1, 2""")
def transitive_support(t):
    return G.strongest_paths(t.sql(WEAK), 0.1).withColumn("s", R6("s"))


@plan(f"{_with('sup')} SELECT x.b AS target, x.a, y.a AS b FROM sup x JOIN sup y ON x.b = y.b AND x.a < y.a")
def co_support(t):
    s = _typed(t, "sup").select("a", F.col("b").alias("target"))
    return s.join(s.withColumnRenamed("a", "b"), "target").where("a < b").select("target", "a", "b")


@plan(f"{_with('sup', 'ela')} SELECT e.a, s.b, round(max(e.s * s.s), 6) AS s FROM ela e JOIN sup s ON e.b = s.a WHERE e.s * s.s > 1e-1 AND e.a <> s.b GROUP BY 1, 2")
def amplified_support(t):
    """Who corroborates a supporter supports its claim too, with both strengths multiplied (elaborations stand for corroborations)."""
    c = _typed(t, "ela").select("a", F.col("b").alias("mid"), F.col("s").alias("c"))
    s = _typed(t, "sup").select(F.col("a").alias("mid"), "b", "s")
    x = c.join(s, "mid").withColumn("p", F.col("c") * F.col("s")).where("p > 0.1 AND a <> b")
    return x.groupBy("a", "b").agg(R6(F.max("p")).alias("s"))


SHARED = "SELECT x.claim_id AS a, y.claim_id AS b, count(*) / 1e1 AS s FROM (SELECT DISTINCT claim_id, agent_id, evidence_key FROM bba) x JOIN (SELECT DISTINCT claim_id, agent_id, evidence_key FROM bba) y ON x.evidence_key = y.evidence_key AND x.agent_id = y.agent_id AND x.claim_id < y.claim_id GROUP BY 1, 2"


@plan(f"{_with('sup')}, c AS ({SHARED}), d AS (SELECT a, b, 9e-1 + s / 1e1 AS s FROM c UNION ALL SELECT b, a, 9e-1 + s / 1e1 FROM c) SELECT sup.a, d.b, round(max(sup.s * d.s), 6) AS s FROM sup JOIN d ON sup.b = d.a WHERE sup.s * d.s > 1e-1 AND sup.a <> d.b GROUP BY 1, 2")
def co_evidence_support(t):
    """Support of a claim reaches those that rest on the same evidence, both ways."""
    c = t.sql(SHARED).withColumn("c", 0.9 + F.col("s") / 10).drop("s")
    d = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).select(F.col("a").alias("mid"), F.col("b").alias("to"), "c")
    x = _typed(t, "sup").select("a", F.col("b").alias("mid"), "s").join(d, "mid").withColumn("p", F.col("s") * F.col("c")).where("p > 0.1 AND a <> to")
    return x.groupBy("a", F.col("to").alias("b")).agg(R6(F.max("p")).alias("s"))


@plan(f"""WITH RECURSIVE e AS ({WEAK}), w(a, b, s) AS (SELECT a, b, s FROM e WHERE a <> b UNION SELECT e.a, w.b, e.s * w.s FROM e JOIN w ON e.b = w.a WHERE e.s * w.s > 1e-1 AND e.a <> w.b), r AS ({RULES['ref']})
SELECT DISTINCT r.a AS challenger, w.b AS target FROM r JOIN w ON r.b = w.a WHERE w.s > 2e-1""")
def indirect_challenges(t):
    """Who challenges a claim challenges what it supports, over chains of a strength above 0.2."""
    far = G.strongest_paths(t.sql(WEAK), 0.1).where("s > 0.2").select(F.col("a").alias("mid"), F.col("b").alias("target"))
    return _typed(t, "ref").select(F.col("a").alias("challenger"), F.col("b").alias("mid")).join(far, "mid").select("challenger", "target").distinct()


@plan("""WITH RECURSIVE e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges), w(a, b) AS (SELECT claim_id, dst FROM claims JOIN e ON e.src = claim_id WHERE truth_value >= 98e-2 UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b) SELECT a, count(*) AS reachable FROM w GROUP BY 1""")
def reachable_counts(t):
    """How many claims each of the seeds reaches over edges of any type; itself too, where a path leads back."""
    return closure.reached_counts(G.oriented(t.edges, "out"), _sure(t))


@plan("""WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE relationship = 'elaborates' AND source_id < target_id), w(a, b) AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.b) SELECT a, b FROM w""")
def elaboration_chains(t):
    return closure.reached(G.oriented(t.edges.where("relationship = 'elaborates' AND source_id < target_id"), "out"))


@plan("""WITH RECURSIVE e AS (SELECT source_id AS src, target_id AS dst, relationship AS rel FROM edges WHERE relationship = 'elaborates' UNION SELECT target_id, source_id, relationship FROM edges WHERE relationship = 'supports'),
w(node, depth) AS (SELECT 7, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3), m AS (SELECT node, min(depth) AS d FROM w GROUP BY 1)
SELECT m.node AS claim_id, CAST(m.d AS INT) AS depth, count(DISTINCT e.dst) AS steps, bool_or(n.node IS NOT NULL AND n.d < m.d) AS loops_back FROM m LEFT JOIN e ON e.src = m.node LEFT JOIN m n ON n.node = e.dst GROUP BY 1, 2""")
def provenance_chain(t):
    """What a claim derives from: out over one type of edge, in over another, with the steps of each node and whether one leads back."""
    out = t.edges.where("relationship = 'elaborates'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    e = out.unionByName(t.edges.where("relationship = 'supports'").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))).distinct()
    m = G.reach(e, t.spark.createDataFrame([(7,)], "node long"), 3)
    near = m.select(F.col("node").alias("dst"), F.col("depth").alias("there"))
    x = m.join(e, m["node"] == e["src"], "left").join(near, "dst", "left")
    return x.groupBy(F.col("node").alias("claim_id"), "depth").agg(F.count_distinct("dst").alias("steps"), F.max(F.coalesce(F.col("there") < F.col("depth"), F.lit(False))).alias("loops_back"))


FRAMES = "SELECT n_nationkey AS frame_id, 100 + n_regionkey AS parent_id, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, 1000, r_name FROM region UNION ALL SELECT 1000, NULL, 'root' FROM region WHERE r_regionkey = 0"


@plan(f"""WITH RECURSIVE f AS ({FRAMES}), w(frame_id, ancestor_id, depth) AS (SELECT frame_id, frame_id, 0 FROM f UNION ALL SELECT w.frame_id, f.parent_id, w.depth + 1 FROM w JOIN f ON f.frame_id = w.ancestor_id WHERE f.parent_id IS NOT NULL)
SELECT w.frame_id, w.ancestor_id, CAST(depth AS INT) AS depth, f.name FROM w JOIN f ON f.frame_id = w.ancestor_id""")
def frame_ancestry(t):
    """Each frame with all frames that it refines, up to the root."""
    f = t.sql(FRAMES)
    up = f.where("parent_id IS NOT NULL").select(F.col("frame_id").alias("src"), F.col("parent_id").alias("dst"))
    got = G.reach(up, f.select("frame_id", F.col("frame_id").alias("node")), 100, by=("frame_id",))
    names = f.select(F.col("frame_id").alias("node"), "name")
    return got.join(names, "node").select("frame_id", F.col("node").alias("ancestor_id"), "depth", "name")


@plan(f"WITH f AS ({FRAMES}) SELECT p.frame_id, p.name, count(c.frame_id) AS children, min(c.name) AS first_child FROM f p JOIN f c ON c.parent_id = p.frame_id GROUP BY 1, 2")
def frame_children(t):
    f = t.sql(FRAMES)
    c = f.select(F.col("parent_id").alias("frame_id"), F.col("name").alias("child"))
    return f.select("frame_id", "name").join(c, "frame_id").groupBy("frame_id", "name").agg(F.count("*").alias("children"), F.min("child").alias("first_child"))
