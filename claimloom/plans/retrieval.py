"""Nearest neighbours, fusion, expansion and what neighbourhoods tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from .evidence import belief_sql, combined, rounded
from .registry import plan

R6 = lambda c: F.round(c, 6)
V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda q: CAST(q AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS c FROM v WHERE vec_id = 17)"
COS = "round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 9)"


def _query(t, i=17):
    return t.vectors.where(F.col("claim_id") == i).first()["vec"]


@plan(f"WITH {V} SELECT vec_id AS claim_id, round({COS}, 6) AS similarity FROM v, q WHERE vec_id <> 17 ORDER BY {COS} DESC, vec_id LIMIT 20")
def vector_knn(t):
    return R.knn(t.vectors, _query(t), 20, where=F.col("claim_id") != 17).select("claim_id", R6("similarity").alias("similarity"))


@plan(f"WITH {V} SELECT vec_id AS claim_id, round({COS}, 6) AS similarity FROM v, q WHERE vec_id <> 17 AND label IN (2, 5) ORDER BY {COS} DESC, vec_id LIMIT 20")
def scoped_knn(t):
    got = R.knn(t.vectors, _query(t), 20, where=(F.col("claim_id") != 17) & F.col("theme_id").isin(2, 5))
    return got.select("claim_id", R6("similarity").alias("similarity"))


@plan(f"WITH {V.replace(', q AS (SELECT v AS c FROM v WHERE vec_id = 17)', '')} SELECT query_id, CAST(rank AS INT) AS rank, claim_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS claim_id, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) z JOIN v a ON a.vec_id = z.i JOIN v b ON b.vec_id = z.j) y WHERE rank <= 5")
def knn_candidates(t):
    """Bridge candidates: the nearest of each of a stated set of queries."""
    q = t.vectors.where("claim_id % 100 = 0").select(F.col("claim_id").alias("query_id"), F.col("vec").alias("query"))
    return R.knn_join(q, t.vectors, 5).select("query_id", "rank", "claim_id", R6("similarity").alias("similarity"))


TERMS = ("the", "of", "tion")
BM25 = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT doc_id, len(ws) AS l, x.t AS term, len(list_filter(ws, lambda y: y = x.t)) AS tf FROM w, (VALUES ('the'), ('of'), ('tion')) x(t) WHERE list_contains(ws, x.t)), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT doc_id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * l / mean))), 9) AS score FROM tf JOIN df USING (term), st GROUP BY 1)"""


@plan(f"WITH {BM25} SELECT doc_id, round(score, 5) AS score FROM b")
def lexical_scores(t):
    got = R.lexical(t.documents, TERMS, id_col="doc_id", text_col="text")
    return got.select("doc_id", F.round("score", 5).alias("score"))


@plan(f"""WITH {BM25}, {V}, d AS (SELECT vec_id AS doc_id, {COS} AS score FROM v, q), rd AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d), rl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b)
SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, CAST(a.r AS INT) AS rank_dense, CAST(c.r AS INT) AS rank_text, round(coalesce(1e0 / (60 + a.r), 0) + coalesce(1e0 / (60 + c.r), 0), 6) AS score FROM (SELECT * FROM rd WHERE r <= 100) a FULL JOIN (SELECT * FROM rl WHERE r <= 100) c ON a.doc_id = c.doc_id""")
def hybrid_fusion(t):
    """Reciprocal rank fusion of a dense and a lexical list."""
    dense = R.knn(t.vectors, _query(t), 100).select(F.col("claim_id").alias("doc_id"), F.col("similarity").alias("score"))
    got = R.fused(dense, R.lexical(t.documents, TERMS, id_col="doc_id", text_col="text"), id_col="doc_id")
    return got.select("doc_id", "rank_dense", "rank_text", R6("score").alias("score"))


@plan(f"""WITH {V}, s AS (SELECT vec_id AS claim_id, {COS} AS s FROM v, q WHERE vec_id <> 17 ORDER BY {COS} DESC, vec_id LIMIT 50), d AS (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM edges UNION ALL SELECT target_id FROM edges) z GROUP BY 1)
SELECT c.claim_id, round(6e-1 * s + 2e-1 * truth_value + 2e-1 * least(coalesce(n, 0) / 1e1, 1e0), 6) AS score FROM s JOIN claims c ON c.claim_id = s.claim_id LEFT JOIN d ON node = c.claim_id""")
def rag_scores(t):
    near = R.knn(t.vectors, _query(t), 50, where=F.col("claim_id") != 17)
    e = t.edges
    deg = e.select(F.col("source_id").alias("claim_id")).unionAll(e.select("target_id")).groupBy("claim_id").agg(F.count("*").alias("n"))
    got = near.join(t.claims, "claim_id").join(deg, "claim_id", "left").fillna(0, ["n"])
    return got.select("claim_id", R6(R.rag_score(F.col("similarity"), F.col("truth_value"), F.col("n"))).alias("score"))


@plan(f"""WITH RECURSIVE {V}, s AS (SELECT vec_id AS node, {COS} AS s FROM v, q WHERE vec_id <> 17 ORDER BY {COS} DESC, vec_id LIMIT 5), e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE relationship = 'supports'), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1),
w(start, node, depth) AS (SELECT node, node, 0 FROM s UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 2), m AS (SELECT start, node, min(depth) AS d FROM w GROUP BY 1, 2)
SELECT m.node AS claim_id, round(max(s * pow(7e-1, d)) * (1 + 1e-1 * coalesce(max(n), 0)), 6) AS score FROM m JOIN s ON s.node = start LEFT JOIN i ON i.dst = m.node GROUP BY 1""")
def graph_recall(t):
    """Seeds by similarity, spread over supporting edges with decay, raised by in-degree."""
    seeds = R.knn(t.vectors, _query(t), 5, where=F.col("claim_id") != 17).select(F.col("claim_id").alias("start"), "similarity")
    e = G.oriented(t.edges.where("relationship = 'supports'"), "out")
    got = G.reach(e, seeds.select("start", F.col("start").alias("node")), 2, by=("start",)).join(seeds, "start")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    best = got.groupBy("node").agg(F.max(F.col("similarity") * F.pow(F.lit(0.7), "depth")).alias("s")).join(into, "node", "left").fillna(0, ["n"])
    return best.select(F.col("node").alias("claim_id"), R6(F.col("s") * (1 + 0.1 * F.col("n"))).alias("score"))


@plan(f"WITH {V.replace(', q AS (SELECT v AS c FROM v WHERE vec_id = 17)', '')} SELECT left_id, right_id, round(d, 6) AS distance FROM (SELECT a.vec_id AS left_id, b.vec_id AS right_id, 1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id) z WHERE d < 7e-1")
def pairwise_cosine(t):
    """Close pairs inside themes."""
    return R.close_pairs(t.vectors, 0.7, "theme_id").select("left_id", "right_id", R6("distance").alias("distance"))


@plan(f"WITH {V} SELECT count(*) AS n, round(quantile_cont(s, 5e-1), 6) AS median_similarity, round(avg(s), 6) AS mean_similarity FROM (SELECT {COS} AS s FROM v, q WHERE vec_id <> 17) z WHERE s >= 1e-1")
def neighbourhood_density(t):
    s = t.vectors.where("claim_id <> 17").select(F.round(R.cosine(F.col("vec"), F.array(*[F.lit(x) for x in _query(t)])), 9).alias("similarity"))
    return s.where("similarity >= 0.1").agg(F.count("*").alias("n"), R6(F.percentile("similarity", 0.5)).alias("median_similarity"), R6(F.avg("similarity")).alias("mean_similarity"))


@plan(f"WITH {V} SELECT label AS theme_id, round(max(s), 6) AS nearest, CASE WHEN max(s) < 5e-1 THEN 'void' WHEN max(s) < 7e-1 THEN 'sparse' ELSE 'covered' END AS coverage FROM (SELECT label, {COS} AS s FROM v, q WHERE vec_id <> 17) z GROUP BY 1")
def coverage_voids(t):
    q = F.array(*[F.lit(x) for x in _query(t)])
    near = F.max(F.round(R.cosine(F.col("vec"), q), 9))
    kind = F.when(near < 0.5, "void").when(near < 0.7, "sparse").otherwise("covered")
    return t.vectors.where("claim_id <> 17").groupBy("theme_id").agg(R6(near).alias("nearest"), kind.alias("coverage"))


@plan("SELECT target_id AS claim_id, count(DISTINCT source_id) AS contesters, round(max(truth_value), 6) AS strongest FROM edges JOIN claims ON claim_id = source_id WHERE relationship = 'contradicts' AND valid_to IS NULL GROUP BY 1")
def dispute_annotation(t):
    e = t.edges.where("relationship = 'contradicts' AND valid_to IS NULL").join(t.claims, F.col("claim_id") == F.col("source_id"))
    return e.groupBy(F.col("target_id").alias("claim_id")).agg(F.count_distinct("source_id").alias("contesters"), R6(F.max("truth_value")).alias("strongest"))


@plan(f"""WITH {V}, s AS (SELECT vec_id AS claim_id, {COS} AS s FROM v, q WHERE vec_id <> 17 ORDER BY {COS} DESC, vec_id LIMIT 30), j AS (SELECT s, truth_value AS x FROM s JOIN claims USING (claim_id)), a AS (SELECT sum(s * x) / sum(s) AS p, stddev_pop(x) AS sd, count(*) AS n FROM j)
SELECT round(p, 6) AS prior, CASE WHEN n < 3 THEN 'understudied' WHEN p > 7e-1 AND sd < 3e-1 THEN 'established' WHEN sd >= 3e-1 THEN 'contested' ELSE 'moderate' END AS kind FROM a""")
def hypothesis_prior(t):
    near = R.knn(t.vectors, _query(t), 30, where=F.col("claim_id") != 17).join(t.claims, "claim_id")
    x = R.prior_from_neighbours(F.col("similarity"), F.col("truth_value"))
    return near.agg(R6(x["prior"]).alias("prior"), x["kind"].alias("kind"))


@plan(f"""WITH b AS ({belief_sql()}), {V}, s AS (SELECT vec_id AS claim_id, {COS} AS s FROM v, q ORDER BY {COS} DESC, vec_id LIMIT 50), x AS (SELECT plausibility - belief AS gap, s FROM s JOIN b USING (claim_id))
SELECT round(sum(greatest(gap, 0) * s) / count(*), 6) AS score, round(avg(greatest(gap, 0)), 6) AS mean_gap, count_if(gap > 5e-1) AS wide, count_if(gap > 15e-2 AND gap <= 5e-1) AS middling FROM x""")
def information_value(t):
    """What more evidence near a vector would be worth."""
    b = rounded(combined(t)).select("claim_id", "belief", "plausibility")
    near = R.knn(t.vectors, _query(t), 50).join(b, "claim_id")
    return near.agg(*[R6(v).alias(k) for k, v in R.information_value(F.col("belief"), F.col("plausibility"), F.col("similarity")).items()])


@plan()
def diverse_selection(t):
    """A page of candidates, then the greedy pick among them (the page is what bounds the driver)."""
    page = R.knn(t.vectors, _query(t), 100, where=F.col("claim_id") != 17).join(t.vectors.select("claim_id", "vec"), "claim_id").collect()
    picked = R.diverse([(r["claim_id"], r["similarity"], r["vec"]) for r in page], 10)
    return t.spark.createDataFrame([(k + 1, int(i)) for k, i in enumerate(picked)], "rank int, claim_id long")


@plan("""WITH s AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT a.conv_id, a.turn, a.role, a.n AS siblings, b.role AS before_role, c.role AS after_role FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.k = a.k - 1 LEFT JOIN s c ON c.conv_id = a.conv_id AND c.k = a.k + 1 WHERE a.role = 'assistant'""")
def batched_context(t):
    """Each hit with its section's siblings before and after."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    x = t.conversations.select("conv_id", "turn", "role", F.count("*").over(w).alias("siblings"), F.lag("role").over(w.orderBy("turn")).alias("before_role"), F.lead("role").over(w.orderBy("turn")).alias("after_role"))
    return x.where("role = 'assistant'")


FOUND = f"""{V}, s AS (SELECT vec_id AS claim_id, {COS} AS similarity FROM v, q), h AS (SELECT s.claim_id, similarity, truth_value, row_number() OVER (ORDER BY similarity DESC, s.claim_id) AS rank FROM s JOIN claims c ON c.claim_id = s.claim_id
  WHERE s.claim_id <> 17 AND similarity >= 5e-2 AND truth_value >= 2e-1 AND price < 98e1 ORDER BY similarity DESC, s.claim_id LIMIT 20)"""


def _similarities(t):
    q = F.array(*[F.lit(x) for x in _query(t)])
    return t.vectors.select("claim_id", F.round(R.cosine(F.col("vec"), q), 9).alias("similarity"))


def _found(t):
    """The first page of a search with a floor under the similarity and filters on the claim."""
    c = t.claims.where("truth_value >= 0.2 AND price < 980").select("claim_id", "truth_value")
    page = _similarities(t).where("claim_id <> 17 AND similarity >= 0.05").join(c, "claim_id").orderBy(F.desc("similarity"), "claim_id").limit(20)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "claim_id")))  # of the page's rows


@plan(f"WITH {FOUND} SELECT claim_id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity, truth_value FROM h")
def semantic_search(t):
    return _found(t).select("claim_id", "rank", R6("similarity").alias("similarity"), "truth_value")


@plan(f"""WITH {FOUND}, e AS (SELECT DISTINCT source_id, target_id, relationship FROM edges WHERE relationship IN ('supports', 'contradicts')),
n AS (SELECT *, CASE WHEN source_id IN (SELECT claim_id FROM h) THEN 'outbound' ELSE 'inbound' END AS direction, CASE WHEN source_id IN (SELECT claim_id FROM h) THEN target_id ELSE source_id END AS claim_id FROM e WHERE source_id IN (SELECT claim_id FROM h) OR target_id IN (SELECT claim_id FROM h))
SELECT source_id, target_id, relationship, direction, n.claim_id, round(similarity, 6) AS similarity FROM n JOIN s USING (claim_id) ORDER BY s.similarity DESC, n.claim_id, source_id, target_id, relationship LIMIT 50""")
def semantic_neighbours(t):
    """One hop around the hits, the closest to the query first."""
    e = t.edges.where("relationship IN ('supports', 'contradicts')").select("source_id", "target_id", "relationship").distinct()
    return R.hits_with_neighbours(_found(t), e, _similarities(t), 50).select("source_id", "target_id", "relationship", "direction", "claim_id", R6("similarity").alias("similarity"))


RELEVANT = "SELECT claim_id, size / 5e1 AS score FROM claims WHERE price > 93e1"


@plan(f"WITH {FOUND}, r AS ({RELEVANT}) SELECT h.claim_id, CAST(rank AS INT) AS rank, truth_value, score, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, rank) AS INT) AS position FROM h LEFT JOIN r ON r.claim_id = h.claim_id")
def rerank_merge(t):
    """A page in the order of a second opinion, with its beliefs untouched."""
    return R.merge_rerank(_found(t), t.sql(RELEVANT)).select("claim_id", "rank", "truth_value", "score", "position")


VERDICTS = "SELECT claim_id, CASE WHEN truth_value < 5e-1 THEN 'ungrounded' ELSE 'grounded' END AS verdict FROM claims WHERE price > 95e1"


@plan(f"WITH {FOUND}, r AS ({VERDICTS}) SELECT h.claim_id, CAST(rank AS INT) AS rank, verdict FROM h LEFT JOIN r ON r.claim_id = h.claim_id WHERE verdict IS NULL OR verdict = 'grounded'")
def groundedness(t):
    return R.grounded(_found(t), t.sql(VERDICTS), drop=True).select("claim_id", "rank", "verdict")


@plan(f"WITH b AS ({belief_sql()}) SELECT claim_id, round(greatest(plausibility - belief, 0), 6) AS ignorance, greatest(plausibility - belief, 0) > 1e-1 AS include FROM b")
def belief_gate(t):
    """Whether a claim's interval is still so wide that more evidence is worth reading."""
    b = rounded(combined(t))
    return b.select("claim_id", R6(F.greatest(F.col("plausibility") - F.col("belief"), F.lit(0.0))).alias("ignorance"), R.more_evidence_needed(F.col("belief"), F.col("plausibility")).alias("include"))
