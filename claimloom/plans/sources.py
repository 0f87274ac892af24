"""Structured documents, staging, validation, provenance, and analytics of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import inference as I
from ..session import scratch
from ..sources import files as S
from .evidence import D_SQL, TIE, masses
from .registry import plan

R6 = lambda c: F.round(c, 6)
N = lambda: F.count("*")


@plan("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS k, text FROM documents), b AS (SELECT doc_id, content, k, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
SELECT doc_id, 'paragraph' AS level, CAST(k - 1 AS INT) AS ordinal, CAST(b AS INT) AS "begin", CAST(b + length(content) AS INT) AS "end", content FROM b WHERE content <> ''""")
def document_structure(t):
    return S.structure(t.documents, "doc_id", "text")


@plan("SELECT claim_id, content, truth_value FROM claims WHERE brand = 'Brand#13'")
def staged_claims(t):
    """Claims through staged JSON: only approved ones come back."""
    path = scratch(t.spark, "staged")
    t.claims.select("claim_id", "content", "truth_value", F.when(F.col("brand") == "Brand#13", "approved").otherwise("pending").alias("review_status")).write.json(path)
    return S.read_staged(t.spark, path).select("claim_id", "content", "truth_value")


@plan("SELECT claim_id, concat_ws(',', CASE WHEN truth_value > 9e-1 THEN 'truth' END, CASE WHEN size < 3 THEN 'size' END) AS failed FROM claims WHERE truth_value > 9e-1 OR size < 3")
def validation_failures(t):
    bad = S.valid(t.claims, {"truth": F.col("truth_value").between(0, 0.9), "size": F.col("size") >= 3})[1]
    return bad.select("claim_id", F.array_join("failed", ",").alias("failed"))


@plan("SELECT 'entity' AS kind, count(*) AS n FROM claims UNION ALL SELECT 'agent', count(DISTINCT agent_id) FROM bba UNION ALL SELECT 'attribution', count(*) FROM (SELECT DISTINCT claim_id, agent_id FROM bba) z")
def provenance_export(t):
    path = scratch(t.spark, "prov")
    S.append(S.prov_records(t.claims, t.dag, t.bba), path, partition_by=("kind",))
    return t.spark.read.parquet(path).groupBy("kind").agg(N().alias("n"))


@plan("SELECT source_id AS claim_id, count(*) AS derived, count(DISTINCT agent_id) AS carriers FROM dag JOIN bba ON bba.claim_id = target_id GROUP BY 1")
def amplification(t):
    """How many masses and agents carry what derives from a claim."""
    return t.dag.join(t.bba.select(F.col("claim_id").alias("target_id"), "agent_id"), "target_id").groupBy(F.col("source_id").alias("claim_id")).agg(N().alias("derived"), F.count_distinct("agent_id").alias("carriers"))


@plan("SELECT agent_id, count(DISTINCT claim_id) AS claims, round(avg(m_sup) + 1e-9, 6) AS support, round(avg(m_unsup) + 1e-9, 6) AS refusal, round(avg(1 - m_sup - m_unsup) + 1e-9, 6) AS ignorance FROM bba GROUP BY 1")
def epistemic_profile(t):
    mean = lambda c: R6(F.avg(c) + TIE)
    return t.bba.groupBy("agent_id").agg(F.count_distinct("claim_id").alias("claims"), mean(F.col("m_sup")).alias("support"), mean(F.col("m_unsup")).alias("refusal"), mean(1 - F.col("m_sup") - F.col("m_unsup")).alias("ignorance"))


@plan("""WITH p AS (SELECT claim_id, agent_id, avg(m_sup - m_unsup) AS s FROM bba WHERE agent_id IN (1, 2) GROUP BY 1, 2) SELECT a.claim_id, round(a.s, 6) AS first, round(b.s, 6) AS second, sign(a.s) = sign(b.s) AS agree FROM p a JOIN p b ON a.claim_id = b.claim_id AND a.agent_id = 1 AND b.agent_id = 2""")
def compare_agents(t):
    p = t.bba.where("agent_id IN (1, 2)").groupBy("claim_id", "agent_id").agg(F.avg(F.col("m_sup") - F.col("m_unsup")).alias("s"))
    one = lambda i, n: p.where(F.col("agent_id") == i).select("claim_id", F.col("s").alias(n))
    return one(1, "a").join(one(2, "b"), "claim_id").select("claim_id", R6("a").alias("first"), R6("b").alias("second"), (F.signum("a") == F.signum("b")).alias("agree"))


@plan("""WITH RECURSIVE x AS (SELECT *, greatest(CASE WHEN f > 0 THEN s * f - t ELSE t - (1 - s * -f) END, 0e0) AS x FROM (SELECT source_id, target_id, CASE relationship WHEN 'supports' THEN 8e-1 WHEN 'elaborates' THEN 6e-1 ELSE -9e-1 END AS f, a.truth_value AS s, b.truth_value AS t FROM edges JOIN claims a ON a.claim_id = source_id JOIN claims b ON b.claim_id = target_id) z),
o AS (SELECT source_id AS a, target_id AS b FROM x WHERE x > 78e-2 UNION SELECT target_id, source_id FROM x WHERE x > 78e-2), w(node, other) AS (SELECT a, b FROM o UNION SELECT w.node, o.b FROM w JOIN o ON o.a = w.other) SELECT root AS cluster, count(*) AS members FROM (SELECT node, min(other) AS root FROM w GROUP BY 1) y GROUP BY 1""")
def obstruction_clusters(t):
    """Components of the edges that are most inconsistent, to be reconciled together."""
    e = I.sheaf_edges(t.edges, t.claims.select(F.col("claim_id").alias("node"), F.col("truth_value").alias("betp"))).where("inconsistency > 0.78")
    return G.components(e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))).groupBy(F.col("root").alias("cluster")).agg(N().alias("members"))


@plan(f"""WITH {D_SQL}, a AS (SELECT claim_id, perspective_id, min(m0 + th) AS q0, min(m1 + th) AS q1, min(th) AS qt FROM d JOIN agents USING (agent_id) GROUP BY 1, 2)
SELECT claim_id, perspective_id, round(greatest(q0 - qt, 0e0), 6) AS m0, round(greatest(q1 - qt, 0e0), 6) AS m1, round(qt, 6) AS th FROM a""")
def dependent_sources(t):
    """Sources of one perspective are not independent: their cautious combination, by least commonalities."""
    rows = masses(t).join(t.agents, "agent_id")
    m = F.col("m")
    q = rows.groupBy("claim_id", "perspective_id").agg(F.min(m["m0"] + m["th"]).alias("q0"), F.min(m["m1"] + m["th"]).alias("q1"), F.min(m["th"]).alias("qt"))
    some = lambda c: R6(F.greatest(c, F.lit(0.0)))
    return q.select("claim_id", "perspective_id", some(F.col("q0") - F.col("qt")).alias("m0"), some(F.col("q1") - F.col("qt")).alias("m1"), R6("qt").alias("th"))


@plan("SELECT claim_id, round(1 - exp(sum(ln(1 - 5e-1 * m_sup))), 6) AS noisy_or, CASE WHEN sum(CASE WHEN m_unsup > 0 THEN 1 ELSE 0 END) = 0 THEN 'none' WHEN sum(CASE WHEN m_sup > 0 THEN 1 ELSE 0 END) >= 2 * sum(CASE WHEN m_unsup > 0 THEN 1 ELSE 0 END) THEN 'keep' WHEN sum(CASE WHEN m_unsup > 0 THEN 1 ELSE 0 END) >= 2 * sum(CASE WHEN m_sup > 0 THEN 1 ELSE 0 END) THEN 'retract' ELSE 'review' END AS triage FROM bba GROUP BY 1")
def conflict_triage(t):
    """A ratio of two decides by itself; what is closer goes to review."""
    up, down = F.count_if(F.col("m_sup") > 0), F.count_if(F.col("m_unsup") > 0)
    triage = F.when(down == 0, "none").when(up >= 2 * down, "keep").when(down >= 2 * up, "retract").otherwise("review")
    return t.bba.groupBy("claim_id").agg(R6(1 - F.exp(F.sum(F.ln(1 - 0.5 * F.col("m_sup"))))).alias("noisy_or"), triage.alias("triage"))

