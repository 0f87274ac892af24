"""Propagation, consistency and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..operators import cluster as C
from ..operators import inference as I
from ..operators.combine import folded
from .evidence import TIE, belief_sql, combined, masses, rounded
from .registry import plan

R6 = lambda c: F.round(c, 6)
TYPED = "SELECT DISTINCT source_id, target_id, relationship FROM edges"
FACTORS = f"SELECT DISTINCT source_id AS a, target_id AS b, CASE relationship WHEN 'supports' THEN 'directional_support' ELSE 'mutual_exclusion' END AS kind, CASE relationship WHEN 'supports' THEN 7e-1 ELSE 0e0 END AS fwd, CASE relationship WHEN 'supports' THEN 15e-2 ELSE 0e0 END AS rev FROM ({TYPED}) x WHERE relationship <> 'elaborates'"


def _factors(t):
    return I.factors(t.sql(TYPED))


@plan(FACTORS.replace("AS fwd", "AS forward").replace("AS rev ", "AS reverse "))
def edge_factors(t):
    return _factors(t)


def _bp_sql(rounds: int) -> str:
    steps = ["b0 AS (SELECT claim_id AS var, truth_value AS prior, truth_value AS belief FROM claims)"]
    for k in range(rounds):
        steps.append(f"""m{k} AS (SELECT a AS var, CASE kind WHEN 'mutual_exclusion' THEN 1 - y.belief ELSE rev * y.belief END AS m FROM f JOIN b{k} y ON y.var = b
            UNION ALL SELECT b, CASE kind WHEN 'mutual_exclusion' THEN 1 - x.belief ELSE fwd * x.belief END FROM f JOIN b{k} x ON x.var = a),
        s{k} AS (SELECT var, least(greatest(exp(avg(ln(greatest(m, 1e-12)))), 1e-2), 99e-2) AS s FROM m{k} GROUP BY 1),
        b{k + 1} AS (SELECT b.var, b.prior, CASE WHEN s IS NULL THEN b.belief ELSE least(greatest(5e-1 * b.belief + 5e-1 * (5e-1 * b.prior + 5e-1 * s), 1e-2), 99e-2) END AS belief FROM b{k} b LEFT JOIN s{k} s ON s.var = b.var)""")
    return f"WITH f AS ({FACTORS}), " + ", ".join(steps) + f" SELECT var AS claim_id, round(belief, 6) AS belief FROM b{rounds}"


@plan(_bp_sql(3))
def scalar_propagation(t):
    """Three rounds of loopy propagation (no early stop)."""
    priors = t.claims.select(F.col("claim_id").alias("var"), F.col("truth_value").alias("prior"))
    got = I.scalar_bp(_factors(t), priors, tolerance=0.0, rounds=3)
    return got.select(F.col("var").alias("claim_id"), R6("belief").alias("belief"))


def _converged_sql(rounds: int = 20) -> str:
    """As ``_bp_sql``, with rounds that change nothing once one has moved no belief by a hundredth."""
    steps = ["b0 AS MATERIALIZED (SELECT claim_id AS var, truth_value AS prior, truth_value AS belief, false AS done FROM claims)"]
    for k in range(rounds):
        steps.append(f"""m{k} AS (SELECT a AS var, CASE kind WHEN 'mutual_exclusion' THEN 1 - y.belief ELSE rev * y.belief END AS m FROM f JOIN b{k} y ON y.var = b
            UNION ALL SELECT b, CASE kind WHEN 'mutual_exclusion' THEN 1 - x.belief ELSE fwd * x.belief END FROM f JOIN b{k} x ON x.var = a),
        s{k} AS (SELECT var, least(greatest(exp(avg(ln(greatest(m, 1e-12)))), 1e-2), 99e-2) AS s FROM m{k} GROUP BY 1),
        n{k} AS (SELECT b.var, b.prior, b.belief AS old, b.done, CASE WHEN s IS NULL OR b.done THEN b.belief ELSE least(greatest(5e-1 * b.belief + 5e-1 * (5e-1 * b.prior + 5e-1 * s), 1e-2), 99e-2) END AS belief FROM b{k} b LEFT JOIN s{k} s ON s.var = b.var),
        b{k + 1} AS MATERIALIZED (SELECT var, prior, belief, done OR max(abs(belief - old)) OVER () < 1e-2 AS done FROM n{k})""")
    return f"WITH f AS MATERIALIZED ({FACTORS}), " + ", ".join(steps) + f" SELECT var AS claim_id, round(belief, 6) AS belief FROM b{rounds}"


@plan(_converged_sql())
def scalar_propagation_converged(t):
    """Until no belief moves by a hundredth, or 20 rounds."""
    priors = t.claims.select(F.col("claim_id").alias("var"), F.col("truth_value").alias("prior"))
    return I.scalar_bp(_factors(t), priors).select(F.col("var").alias("claim_id"), R6("belief").alias("belief"))


def _interval_sql(rounds: int) -> str:
    steps = ["b0 AS (SELECT claim_id AS var, truth_value * 5e-1 AS pb, truth_value * 5e-1 + 4e-1 AS pp, truth_value * 5e-1 AS bel, truth_value * 5e-1 + 4e-1 AS pl FROM claims)"]
    for k in range(rounds):
        def side(v: str, o: str) -> str:
            return f"SELECT {v} AS var, CASE kind WHEN 'mutual_exclusion' THEN 1 - o.pl ELSE w.bel END AS mb, CASE kind WHEN 'mutual_exclusion' THEN 1 - o.bel ELSE w.pl END AS mp FROM f JOIN b{k} o ON o.var = {o} JOIN b{k} w ON w.var = {v}"  # noqa: B023
        mean = lambda c: f"least(greatest(exp(avg(ln(greatest({c}, 1e-12)))), 1e-2), 99e-2)"
        new = lambda c, p, s: f"CASE WHEN {s} IS NULL THEN b.{c} ELSE least(greatest(5e-1 * b.{c} + 5e-1 * (5e-1 * b.{p} + 5e-1 * {s}), 1e-2), 99e-2) END AS {c}"
        steps.append(f"""m{k} AS ({side('a', 'b')} UNION ALL {side('b', 'a')}), s{k} AS (SELECT var, {mean('mb')} AS sb, {mean('mp')} AS sp FROM m{k} GROUP BY 1),
        b{k + 1} AS (SELECT b.var, b.pb, b.pp, {new('bel', 'pb', 'sb')}, {new('pl', 'pp', 'sp')} FROM b{k} b LEFT JOIN s{k} s ON s.var = b.var)""")
    return f"WITH f AS ({FACTORS}), " + ", ".join(steps) + f" SELECT var AS claim_id, round(bel, 6) AS bel, round(pl, 6) AS pl FROM b{rounds}"


@plan(_interval_sql(2))
def interval_propagation(t):
    """Two rounds on belief intervals."""
    low = F.col("truth_value") * 0.5
    priors = t.claims.select(F.col("claim_id").alias("var"), low.alias("bel"), (low + 0.4).alias("pl"), F.lit(0.0).alias("ow"))
    got = I.interval_bp(_factors(t), priors, tolerance=0.0, rounds=2)
    return got.select(F.col("var").alias("claim_id"), R6("bel").alias("bel"), R6("pl").alias("pl"))


@plan("""WITH f AS (SELECT DISTINCT source_id, target_id FROM edges WHERE relationship <> 'elaborates'), p AS (SELECT claim_id, truth_value * 5e-1 AS bel, truth_value * 5e-1 + 1e-1 AS pl, CASE WHEN size % 3 = 0 THEN 4e-1 ELSE 5e-2 END AS ow FROM claims),
e AS (SELECT source_id AS s, target_id AS t FROM f UNION SELECT target_id, source_id FROM f)
SELECT s AS source, t AS target, round(1 - x.ow, 6) AS reduction, round((x.bel + x.pl) / 2 * (1 - x.pl + x.bel), 6) AS confidence FROM e JOIN p x ON x.claim_id = s JOIN p y ON y.claim_id = t WHERE x.ow < 1e-1 AND x.pl - x.bel < 3e-1 AND y.ow > 3e-1""")
def frame_closure(t):
    p = t.claims.select(F.col("claim_id").alias("var"), (F.col("truth_value") * 0.5).alias("bel"), (F.col("truth_value") * 0.5 + 0.1).alias("pl"), F.when(F.col("size") % 3 == 0, 0.4).otherwise(0.05).alias("ow"))
    got = I.closure_proposals(_factors(t), p, p)
    return got.select("source", "target", R6("reduction").alias("reduction"), R6("confidence").alias("confidence"))


@plan()
def mass_propagation(t):
    """Propagation with mass functions as messages."""
    own = folded(masses(t).groupBy("claim_id").agg(F.collect_list("m").alias("m")), "m")
    got = I.mass_bp(_factors(t), own.select(F.col("claim_id").alias("var"), "m"), rounds=3)
    return got.select(F.col("var").alias("claim_id"), *[R6(F.col("m")[k]).alias(k) for k in ("m0", "m1", "th", "cf", "ms")])


WEIGHTED = "SELECT source_id, target_id, max(strength) AS weight, max(CASE WHEN relationship = 'supports' THEN 1 ELSE 0 END) = 1 AS supporting FROM edges WHERE relationship <> 'elaborates' GROUP BY 1, 2"


@plan(f"""WITH e AS ({WEIGHTED}), z AS (SELECT 7 AS claim_id, 9e-1 AS truth_value),
o AS (SELECT target_id AS claim_id, arg_min(struct_pack(w := weight, s := supporting, b := 9e-1), source_id) AS x FROM e WHERE source_id = 7 GROUP BY 1),
o1 AS (SELECT claim_id, least(greatest(CASE WHEN x.s THEN truth_value + greatest(x.w * x.b, 1e-2) * (1 - truth_value) * 1e-1 ELSE truth_value - greatest(x.w * x.b, 1e-2) * truth_value * 1e-1 END, 0e0), 1e0) AS t FROM o JOIN claims USING (claim_id) WHERE claim_id <> 7),
q AS (SELECT target_id AS claim_id, arg_min(struct_pack(w := weight, s := supporting, b := t), source_id) AS x FROM e JOIN o1 ON o1.claim_id = source_id GROUP BY 1),
o2 AS (SELECT claim_id, least(greatest(CASE WHEN x.s THEN truth_value + greatest(x.w * x.b, 1e-2) * (1 - truth_value) * 1e-1 ELSE truth_value - greatest(x.w * x.b, 1e-2) * truth_value * 1e-1 END, 0e0), 1e0) AS t FROM q JOIN claims USING (claim_id) WHERE claim_id <> 7 AND claim_id NOT IN (SELECT claim_id FROM o1))
SELECT 7 AS claim_id, 9e-1 AS truth_value, 0 AS depth UNION ALL SELECT claim_id, round(t, 6), 1 FROM o1 UNION ALL SELECT claim_id, round(t, 6), 2 FROM o2""")
def truth_propagation(t):
    got = I.propagate(t.sql(WEIGHTED), t.claims, 7, 0.9, max_depth=2)
    return got.select("claim_id", R6("truth_value").alias("truth_value"), "depth")


FACTOR_SQL = "CASE relationship WHEN 'supports' THEN 8e-1 WHEN 'elaborates' THEN 6e-1 ELSE -9e-1 END"


@plan(f"""WITH e AS (SELECT target_id AS node, {FACTOR_SQL} AS f, truth_value AS s FROM edges JOIN claims ON claim_id = source_id), w AS (SELECT node, avg(CASE WHEN f > 0 THEN s * f ELSE (1 - s) * -f END) AS want, count(*) AS n FROM e GROUP BY 1)
SELECT claim_id, round(coalesce(want, truth_value) + 1e-9, 6) AS expected, round(abs(truth_value - coalesce(want, truth_value)) + 1e-9, 6) AS radius, coalesce(n, 0) AS neighbours FROM claims LEFT JOIN w ON node = claim_id""")
def sheaf_sections(t):
    got = I.sheaf_sections(t.edges, t.claims.select(F.col("claim_id").alias("node"), F.col("truth_value").alias("betp")))
    return got.select(F.col("node").alias("claim_id"), R6(F.col("expected") + TIE).alias("expected"), R6(F.col("radius") + TIE).alias("radius"), "neighbours")


EXCESS = f"""SELECT *, greatest(CASE WHEN f > 0 THEN s * f - t ELSE t - (1 - s * -f) END, 0e0) AS x FROM (SELECT e.*, {FACTOR_SQL} AS f, a.truth_value AS s, b.truth_value AS t FROM edges e JOIN claims a ON a.claim_id = source_id JOIN claims b ON b.claim_id = target_id) z"""


@plan(f"WITH x AS ({EXCESS}) SELECT round(sum(x), 4) AS h1, count_if(x <= 1e-1) AS h0, round(avg(x), 6) AS h1_normalized, count(*) AS n_edges FROM x")
def sheaf_cohomology(t):
    got = I.sheaf_edges(t.edges, t.claims.select(F.col("claim_id").alias("node"), F.col("truth_value").alias("betp")))
    return got.agg(F.round(F.sum("inconsistency"), 4).alias("h1"), F.count_if(F.col("inconsistency") <= 0.1).alias("h0"), R6(F.avg("inconsistency")).alias("h1_normalized"), F.count("*").alias("n_edges"))


@plan(f"WITH x AS ({EXCESS}) SELECT source_id, target_id, source_key, relationship, round(x, 6) AS inconsistency FROM x WHERE x > 6e-1")
def sheaf_obstructions(t):
    got = I.sheaf_edges(t.edges, t.claims.select(F.col("claim_id").alias("node"), F.col("truth_value").alias("betp")))
    return got.where("inconsistency > 0.6").select("source_id", "target_id", "source_key", "relationship", R6("inconsistency").alias("inconsistency"))


@plan(f"""WITH b AS ({belief_sql()}), e AS (SELECT target_id AS node, {FACTOR_SQL} AS f, belief AS bel, plausibility AS pl, missing AS ow FROM edges JOIN b ON claim_id = source_id),
w AS (SELECT node, least(greatest(avg(CASE WHEN f > 0 THEN bel * f ELSE (1 - pl) * -f END), 0e0), 1e0) AS eb, least(greatest(avg(CASE WHEN f > 0 THEN 1 - (1 - pl) * f ELSE 1 - bel * -f END), 0e0), 1e0) AS ep, avg(ow) AS eo, count(*) AS n FROM e GROUP BY 1)
SELECT claim_id, round(eb + 1e-9, 5) AS expected_bel, round(ep + 1e-9, 5) AS expected_pl, round(eo + 1e-9, 5) AS expected_open, round(greatest(abs(belief - eb), abs(plausibility - ep)) + 1e-9, 5) AS distance, n AS neighbours FROM b JOIN w ON node = claim_id""")
def interval_sections(t):
    iv = rounded(combined(t)).select(F.col("claim_id").alias("node"), F.col("belief").alias("bel"), F.col("plausibility").alias("pl"), F.col("missing").alias("ow"))
    got = I.interval_sections(t.edges, iv)
    return got.select(F.col("node").alias("claim_id"), *[F.round(F.col(c) + TIE, 5).alias(n) for c, n in (("eb", "expected_bel"), ("ep", "expected_pl"), ("eo", "expected_open"), ("distance", "distance"))], "neighbours")


# -- communities and themes ---------------------------------------------------------------------
def _weights(t):
    return t.edges.where("relationship <> 'contradicts'").groupBy("source_id", "target_id").agg(F.sum("strength").alias("weight"))


@plan()
def graph_communities(t):
    """Communities of the whole graph with size and mean truth (labels are not comparable: rows only)."""
    of = C.communities(_weights(t), rounds=6)
    return of.join(t.claims, of["node"] == t.claims["claim_id"]).groupBy("community").agg(F.count("*").alias("size"), R6(F.avg("truth_value")).alias("mean_truth"))


@plan()
def theme_communities(t):
    """Communities inside each kind of claim."""
    kind = lambda v: t.claims.select(F.col("claim_id").alias(v), F.col("kind").alias(f"k_{v}"))
    e = _weights(t).join(kind("source_id"), "source_id").join(kind("target_id"), "target_id").where("k_source_id = k_target_id").withColumn("theme", F.col("k_source_id"))
    return C.communities_by_group(e, "theme", least_nodes=10)


@plan()
def k_means_themes(t):
    return C.k_means(t.vectors, 10)


_COS = "list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))"
CENTRE = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), k AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, round(avg(x), 6) AS m FROM x GROUP BY 1, 2) z GROUP BY 1), v AS (SELECT vec_id, label, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS v FROM embeddings)"


@plan(f"WITH {CENTRE} SELECT vec_id AS claim_id, theme_id, round(s, 6) AS similarity FROM (SELECT vec_id, k.label AS theme_id, round({_COS}, 9) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round({_COS}, 9) DESC, k.label) AS r FROM v, k) z WHERE r = 1")
def theme_assignment(t):
    got = C.nearest(t.vectors, C.centroids(t.vectors, "theme_id", 6), "theme_id")
    return got.select("claim_id", "theme_id", R6("similarity").alias("similarity"))


@plan(f"WITH {CENTRE} SELECT v.label AS theme_id, count(*) AS n, round(avg(1 - {_COS}), 6) AS spread, avg(1 - {_COS}) > 7e-1 AS split FROM v JOIN k ON k.label = v.label GROUP BY 1")
def theme_split_candidates(t):
    d = t.vectors.join(C.centroids(t.vectors, "theme_id", 6), "theme_id").withColumn("d", 1 - C.cosine(F.col("vec"), F.col("centre")))
    return d.groupBy("theme_id").agg(F.count("*").alias("n"), R6(F.avg("d")).alias("spread"), (F.avg("d") > 0.7).alias("split"))


@plan(f"WITH {CENTRE} SELECT vec_id AS claim_id, v.label AS theme_id, round(1 - {_COS}, 6) AS distance FROM v JOIN k ON k.label = v.label WHERE 1 - {_COS} > 8e-1")
def theme_outliers(t):
    d = t.vectors.join(C.centroids(t.vectors, "theme_id", 6), "theme_id").withColumn("distance", 1 - C.cosine(F.col("vec"), F.col("centre")))
    return d.where("distance > 0.8").select("claim_id", "theme_id", R6("distance").alias("distance"))
