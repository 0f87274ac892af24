"""Filters, joins, aggregates, windows, sorting and set operations over the graph's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calibration as K
from ..operators import relational as R
from .registry import plan

R6 = lambda c: F.round(c, 6)
TIE = 1e-9
L = lambda c: F.col(c).cast("long")
N = lambda: F.count("*")


# -- filters ---------------------------------------------------------------------------------
@plan("SELECT claim_id, content, truth_value FROM claims WHERE truth_value BETWEEN 2e-1 AND 9e-1 AND contains(lower(content), 'widget') ORDER BY truth_value DESC NULLS LAST, claim_id LIMIT 50 OFFSET 3")
def claim_listing(t):
    return R.list_claims(t.claims, truth=(0.2, 0.9), contains="WIDGET", offset=3, limit=50).select("claim_id", "content", "truth_value")


@plan("SELECT claim_id, content FROM claims WHERE content ILIKE '%B%WIDG%'")
def content_ilike(t):
    return t.claims.where(F.col("content").ilike("%B%WIDG%")).select("claim_id", "content")


@plan("SELECT claim_id, brand, kind FROM claims WHERE brand = 'Brand#11' AND kind <> 'PROMO' OR list_contains([brand, kind], 'Brand#23') AND list_contains([brand, kind], 'ECONOMY')")
def labels_contain_all(t):
    labels = F.array("brand", "kind")
    return t.claims.where(R.labels_all(labels, ["Brand#11"], ["PROMO"]) | R.labels_all(labels, ["Brand#23", "ECONOMY"])).select("claim_id", "brand", "kind")


@plan("SELECT claim_id FROM claims WHERE brand IN ('Brand#12', 'LARGE') OR kind IN ('Brand#12', 'LARGE')")
def labels_overlap(t):
    return t.claims.where(F.arrays_overlap(F.array("brand", "kind"), F.array(F.lit("Brand#12"), F.lit("LARGE")))).select("claim_id")


@plan("SELECT claim_id, truth_value FROM claims WHERE truth_value >= 8e-1 OR truth_value <= 1e-1")
def truth_extremes(t):
    return t.claims.where((F.col("truth_value") >= 0.8) | (F.col("truth_value") <= 0.1)).select("claim_id", "truth_value")


@plan("SELECT source_id, target_id, source_key, strength, valid_from FROM edges WHERE relationship = 'elaborates' AND valid_to IS NULL")
def valid_edges(t):
    return R.current_edges(t.edges, "elaborates").select("source_id", "target_id", "source_key", "strength", "valid_from")


@plan("SELECT c.claim_id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.relationship = 'supports' AND e.strength > 95e-2 AND e.source_id = c.claim_id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.relationship = 'supports' AND e.strength > 95e-2 AND e.target_id = c.claim_id)")
def undecomposed_claims(t):
    return R.without_edges(t.claims, t.edges.where("strength > 0.95"), "supports").select("claim_id")


@plan("SELECT claim_id, CASE WHEN brand = 'Brand#11' THEN '[REDACTED]' ELSE content END AS label FROM claims")
def redacted_labels(t):
    return t.claims.select("claim_id", R.redacted(F.col("content"), F.col("brand") != "Brand#11").alias("label"))


@plan("SELECT graph_version, event_id, event_type FROM eventlog WHERE graph_version <= 400")
def snapshot_at_version(t):
    return R.snapshot(t.eventlog, 400).select("graph_version", "event_id", "event_type")


@plan("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_property_filter(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(k > 50).select("event_id", k.alias("k"))


@plan("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS label FROM documents")
def short_labels(t):
    return t.documents.select("doc_id", R.short_label(F.col("text")).alias("label"))


# -- joins -----------------------------------------------------------------------------------
@plan("SELECT relationship, evidence_type, count(*) AS n FROM edges e JOIN bba b ON b.claim_id = e.source_id AND b.evidence_key = e.source_key GROUP BY 1, 2")
def evidence_distribution(t):
    b = t.bba.select(F.col("claim_id").alias("source_id"), F.col("evidence_key").alias("source_key"), "evidence_type")
    return t.edges.join(b, ["source_id", "source_key"]).groupBy("relationship", "evidence_type").agg(N().alias("n"))


@plan("SELECT c.claim_id, c.truth_value, n.n_out FROM claims c LEFT JOIN (SELECT source_id, count(*) AS n_out FROM edges WHERE relationship = 'contradicts' AND strength < 93e-2 GROUP BY 1) n ON n.source_id = c.claim_id")
def left_join_supersedes(t):
    n = t.edges.where("relationship = 'contradicts' AND strength < 0.93").groupBy(F.col("source_id").alias("claim_id")).agg(N().alias("n_out"))
    return t.claims.join(n, "claim_id", "left").select("claim_id", "truth_value", "n_out")


@plan("SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, a.n AS n_for, b.n AS n_against FROM (SELECT claim_id, count(*) AS n FROM bba WHERE m_sup > 7e-1 GROUP BY 1) a FULL JOIN (SELECT claim_id, count(*) AS n FROM bba WHERE m_unsup > 7e-1 GROUP BY 1) b ON a.claim_id = b.claim_id")
def full_join_sides(t):
    side = lambda c, n: t.bba.where(F.col(c) > 0.7).groupBy("claim_id").agg(N().alias(n))
    return side("m_sup", "n_for").join(side("m_unsup", "n_against"), "claim_id", "full")


@plan("SELECT claim_id, content FROM claims WHERE claim_id IN (SELECT claim_id FROM bba WHERE evidence_type = 'testimonial' AND m_sup > 75e-2)")
def semi_join_scope(t):
    return t.claims.join(t.bba.where("evidence_type = 'testimonial' AND m_sup > 0.75"), "claim_id", "left_semi").select("claim_id", "content")


@plan("SELECT DISTINCT source_id AS claim_id FROM dag WHERE source_id NOT IN (SELECT target_id FROM dag)")
def lineage_heads(t):
    return t.dag.select(F.col("source_id").alias("claim_id")).distinct().join(t.dag.select(F.col("target_id").alias("claim_id")), "claim_id", "left_anti")


@plan("SELECT n.claim_id, count(*) AS n_edges, round(avg(strength) + 1e-9, 6) AS mean_strength FROM (SELECT claim_id FROM claims WHERE brand = 'Brand#13') n JOIN edges e ON e.source_id = n.claim_id OR e.target_id = n.claim_id GROUP BY 1")
def edges_of_either_end(t):
    mine = t.claims.where("brand = 'Brand#13'").select(F.col("claim_id").alias("node"))
    return R.undirected(t.edges, "strength").join(mine, "node").groupBy(F.col("node").alias("claim_id")).agg(N().alias("n_edges"), R6(F.avg("strength") + TIE).alias("mean_strength"))


@plan("SELECT source_id, target_id, source_key, relationship, CASE relationship WHEN 'supports' THEN 'directional_support' WHEN 'contradicts' THEN 'mutual_exclusion' END AS factor, CASE relationship WHEN 'supports' THEN 7e-1 WHEN 'contradicts' THEN 0e0 END AS forward, CASE relationship WHEN 'supports' THEN 15e-2 WHEN 'contradicts' THEN 0e0 END AS reverse FROM edges")
def lateral_factor_map(t):
    return t.edges.select("source_id", "target_id", "source_key", "relationship", *[K.lookup({k: v[i] for k, v in K.FACTOR.items()}, F.col("relationship")).alias(n) for i, n in enumerate(("factor", "forward", "reverse"))])


@plan("SELECT claim_id, (SELECT count(*) FROM edges e WHERE e.source_id = c.claim_id OR e.target_id = c.claim_id) AS degree FROM claims c")
def correlated_degree(t):
    d = R.undirected(t.edges).groupBy(F.col("node").alias("claim_id")).agg(N().alias("degree"))
    return t.claims.select("claim_id").join(d, "claim_id", "left").fillna(0, ["degree"])


@plan("SELECT a.subject_id AS left_id, b.subject_id AS right_id, count(*) AS shared FROM triples a JOIN triples b ON a.object_id = b.object_id AND a.predicate = b.predicate AND a.subject_id < b.subject_id AND a.claim_id = b.claim_id GROUP BY 1, 2 HAVING count(*) >= 1")
def bridge_self_join(t):
    a, b = t.triples.alias("a"), t.triples.alias("b")
    on = (F.col("a.claim_id") == F.col("b.claim_id")) & (F.col("a.object_id") == F.col("b.object_id")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.subject_id") < F.col("b.subject_id"))
    return a.join(b, on).groupBy(F.col("a.subject_id").alias("left_id"), F.col("b.subject_id").alias("right_id")).agg(N().alias("shared")).where("shared >= 1")


@plan("SELECT claim_id, label, count(*) AS n FROM (SELECT claim_id, unnest([brand, kind]) AS label FROM claims) x JOIN bba USING (claim_id) GROUP BY 1, 2")
def explode_join(t):
    labels = t.claims.select("claim_id", F.explode(F.array("brand", "kind")).alias("label"))
    return labels.join(t.bba.groupBy("claim_id").agg(N().alias("n")), "claim_id").select("claim_id", "label", "n")


@plan("SELECT 'claim' AS kind, claim_id AS id, content AS name FROM claims UNION ALL SELECT 'agent', agent_id, name FROM agents UNION ALL SELECT 'perspective', n_nationkey, n_name FROM nation")
def polymorphic_nodes(t):
    part = lambda d, k, i, n: d.select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("id"), F.col(n).alias("name"))
    return part(t.claims, "claim", "claim_id", "content").unionByName(part(t.agents, "agent", "agent_id", "name")).unionByName(part(t.nation, "perspective", "n_nationkey", "n_name"))


@plan("SELECT r_name AS region, n_name AS nation, count(DISTINCT s_suppkey) AS agents, count(DISTINCT c_custkey) AS readers FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def hierarchy_rollup(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(N().alias("agents"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(N().alias("readers"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("k", F.col("n_nationkey"))
    return n.join(s, "k", "left").join(c, "k", "left").select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("agents", F.lit(0)).cast("long").alias("agents"), F.coalesce("readers", F.lit(0)).cast("long").alias("readers"))


# -- aggregates ------------------------------------------------------------------------------
@plan("SELECT evidence_type, count(DISTINCT claim_id) AS claims, count(DISTINCT agent_id) AS agents, count(*) AS masses FROM bba GROUP BY 1")
def frame_density(t):
    return t.bba.groupBy("evidence_type").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("agent_id").alias("agents"), N().alias("masses"))


@plan("SELECT claim_id, round(max(m_unsup), 6) AS worst, count(*) AS n FROM bba GROUP BY 1 HAVING max(m_unsup) > 75e-2 ORDER BY worst DESC, claim_id LIMIT 25")
def conflict_scan(t):
    return t.bba.groupBy("claim_id").agg(R6(F.max("m_unsup")).alias("worst"), N().alias("n")).where("worst > 0.75").orderBy(F.desc("worst"), "claim_id").limit(25)


@plan("SELECT agent_id, count(DISTINCT claim_id) AS claims, round(avg(m_sup - truth_value), 6) AS inflation FROM bba JOIN claims USING (claim_id) GROUP BY 1 HAVING count(DISTINCT claim_id) >= 2 ORDER BY inflation DESC, agent_id LIMIT 20")
def inflation_leaderboard(t):
    got = t.bba.join(t.claims.select("claim_id", "truth_value"), "claim_id").groupBy("agent_id").agg(F.count_distinct("claim_id").alias("claims"), R6(F.avg(F.col("m_sup") - F.col("truth_value"))).alias("inflation"))
    return got.where("claims >= 2").orderBy(F.desc("inflation"), "agent_id").limit(20)


@plan("SELECT label AS theme_id, count(*) AS n, round(count(*) FILTER (embedding[1] > 0) / count(*), 6) AS populated FROM embeddings GROUP BY 1")
def filtered_ratio(t):
    return t.embeddings.groupBy(F.col("label").alias("theme_id")).agg(N().alias("n"), R6(F.count_if(F.col("embedding")[0] > 0) / N()).alias("populated"))


@plan("SELECT kind, round(quantile_cont(truth_value, 5e-1), 6) AS median_truth FROM claims GROUP BY 1")
def exact_median(t):
    return t.claims.groupBy("kind").agg(R6(F.percentile("truth_value", 0.5)).alias("median_truth"))


@plan("SELECT target_id AS claim_id, list_aggregate(list_slice(list(DISTINCT source_id ORDER BY source_id), 1, 3), 'string_agg', ',') AS first_three FROM edges WHERE relationship = 'contradicts' GROUP BY 1")
def top_contesters(t):
    """Bounded aggregate: distinct first, then the first three by rank."""
    pairs = t.edges.where("relationship = 'contradicts'").select(F.col("target_id").alias("claim_id"), "source_id").distinct()
    first = R.top_in_group(pairs, ["claim_id"], [F.col("source_id")], 3)
    return first.groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_list("source_id")), ",").alias("first_three"))


@plan("SELECT theme_id, CAST(i - 1 AS INT) AS dim, round(avg(x), 6) AS mean FROM (SELECT label AS theme_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) z GROUP BY 1, 2")
def vector_centroids(t):
    x = t.vectors.select("theme_id", F.posexplode("vec").alias("dim", "x"))
    return x.groupBy("theme_id", "dim").agg(R6(F.avg("x")).alias("mean"))


@plan("SELECT claim_id, bool_or(m_unsup > 75e-2) AS disputed, bool_and(m_sup > 0) AS unanimous FROM bba GROUP BY 1")
def bool_aggregates(t):
    return t.bba.groupBy("claim_id").agg(F.bool_or(F.col("m_unsup") > 0.75).alias("disputed"), F.bool_and(F.col("m_sup") > 0).alias("unanimous"))


@plan("SELECT agent_id, arg_max(evidence_type, n * 2 + (evidence_type = 'empirical')::INT) AS dominant FROM (SELECT agent_id, evidence_type, count(*) AS n FROM bba GROUP BY 1, 2) z GROUP BY 1")
def dominant_type(t):
    n = t.bba.groupBy("agent_id", "evidence_type").agg(N().alias("n"))
    return n.groupBy("agent_id").agg(F.max_by("evidence_type", F.struct("n", F.col("evidence_type") == "empirical")).alias("dominant"))


@plan("SELECT relationship, round(avg(strength), 6) AS mean, round(var_pop(strength), 6) AS variance, round(max(strength), 6) AS largest FROM edges GROUP BY 1")
def population_moments(t):
    return t.edges.groupBy("relationship").agg(R6(F.avg("strength")).alias("mean"), R6(F.var_pop("strength")).alias("variance"), R6(F.max("strength")).alias("largest"))


@plan("SELECT agent_id, evidence_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY agent_id), 6) AS share FROM bba GROUP BY 1, 2")
def normalised_distribution(t):
    n = t.bba.groupBy("agent_id", "evidence_type").agg(N().alias("n"))
    return n.withColumn("share", R6(F.col("n") / F.sum("n").over(Window.partitionBy("agent_id"))))


@plan()
def noisy_counts(t):
    """Counts by relationship with Laplace noise of scale 1 / epsilon (random; rows only)."""
    u = F.rand(17) - 0.5
    return t.edges.groupBy("relationship").agg(N().alias("n")).select("relationship", (F.col("n") - F.signum(u) * F.ln(1 - 2 * F.abs(u)) / 0.5).alias("noisy"))


@plan("SELECT workflow_id, round(avg(CASE WHEN success THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ts DESC, event_id DESC) AS k FROM executions) z WHERE k <= 20 GROUP BY 1")
def rolling_success(t):
    last = R.top_in_group(t.executions, ["workflow_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return last.groupBy("workflow_id").agg(R6(F.avg(F.col("success").cast("double"))).alias("rate"), N().alias("n"))


@plan("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on_latest(t):
    return R.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


# -- windows and time ------------------------------------------------------------------------
@plan("SELECT conv_id, turn, role, CAST(k AS INT) AS rank, n FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) z WHERE k <= 2")
def top_turns(t):
    got = R.top_in_group(t.conversations, ["conv_id"], [F.desc(F.length("text")), F.col("turn")], 2, total="n")
    return got.select("conv_id", "turn", "role", "rank", "n")


@plan("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY GROUP BY 1, 2")
def weekly_activity(t):
    recent = t.events.where(F.col("ts") >= F.expr("timestamp_ntz '2024-01-31' - INTERVAL 30 DAY"))
    return recent.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(N().alias("n"))


@plan("""WITH o AS (SELECT user_id, ts, event_id, value, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o)
SELECT user_id, max(n) - 1 AS longest, max(n) - 1 >= 4 AS alarm FROM (SELECT user_id, g, count(*) AS n FROM g GROUP BY 1, 2) z GROUP BY 1""")
def rising_streaks(t):
    got = R.longest_rise(t.events, "user_id", [F.col("ts"), F.col("event_id")], "value")
    return got.select("user_id", "longest", (F.col("longest") >= 4).alias("alarm"))


# -- order, limits, sets -----------------------------------------------------------------------
@plan("SELECT claim_id, n FROM (SELECT c.claim_id, n FROM claims c LEFT JOIN (SELECT claim_id, count(*) AS n FROM bba WHERE m_unsup > 6e-1 GROUP BY 1) b USING (claim_id)) z ORDER BY n DESC NULLS LAST, claim_id LIMIT 30 OFFSET 5")
def nulls_last_page(t):
    n = t.bba.where("m_unsup > 0.6").groupBy("claim_id").agg(N().alias("n"))
    return t.claims.select("claim_id").join(n, "claim_id", "left").orderBy(F.desc_nulls_last("n"), "claim_id").offset(5).limit(30)


@plan("SELECT claim_id, price, truth_value FROM (SELECT * FROM claims ORDER BY price DESC, claim_id LIMIT 40) z WHERE truth_value >= 5e-1")
def filter_after_limit(t):
    """The threshold is applied to the page, so a page may come back short."""
    return t.claims.orderBy(F.desc("price"), "claim_id").limit(40).where("truth_value >= 0.5").select("claim_id", "price", "truth_value")


@plan("SELECT DISTINCT claim_id FROM bba WHERE m_sup > 75e-2 INTERSECT SELECT claim_id FROM bba WHERE m_unsup > 75e-2")
def intersect_sides(t):
    return t.bba.where("m_sup > 0.75").select("claim_id").intersect(t.bba.where("m_unsup > 0.75").select("claim_id"))


@plan("SELECT source_id AS claim_id FROM dag UNION SELECT target_id FROM dag")
def union_nodes(t):
    return t.dag.select(F.col("source_id").alias("claim_id")).union(t.dag.select("target_id")).distinct()


@plan("""WITH p AS (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, list_filter(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(a.p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))), lambda x: true) AS g,
 list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(b.p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS h FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_type = b.p_type AND a.p_brand = b.p_brand)
SELECT left_id, right_id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS similarity FROM p WHERE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) >= 3e-1""")
def trigram_similarity(t):
    """Similar contents within a kind and brand; equal texts are compared once, not once a pair of claims."""
    return R.similar_pairs(t.claims, "content", ["kind", "brand"], 0.3).select("left_id", "right_id", R6("similarity").alias("similarity"))


@plan("SELECT claim_id, truth_value FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY v DESC) AS k FROM (SELECT claim_id, truth_value, 1 AS v FROM claims UNION ALL SELECT claim_id, round(1 - truth_value, 6), 2 FROM claims WHERE brand = 'Brand#11') z) y WHERE k = 1")
def upsert(t):
    """A batch merged into a table: the newest row of each key stays."""
    new = t.claims.where("brand = 'Brand#11'").select("claim_id", R6(1 - F.col("truth_value")).alias("truth_value"), F.lit(2).alias("v"))
    old = t.claims.select("claim_id", "truth_value", F.lit(1).alias("v"))
    return R.latest(old.unionByName(new), ["claim_id"], [F.desc("v")]).select("claim_id", "truth_value")
