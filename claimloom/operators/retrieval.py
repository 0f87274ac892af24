"""Vector and text retrieval, fusion and diversity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .cluster import cosine, dot


def knn(vectors: DataFrame, query: Sequence[float], k: int, *, where: Column | None = None) -> DataFrame:
    """(claim_id, similarity): the k nearest to a vector by cosine; ties to the smaller id. A scan and a bounded sort."""
    v = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return v.select("claim_id", F.round(cosine(F.col("vec"), q), 9).alias("similarity")).orderBy(F.desc("similarity"), "claim_id").limit(k)


def _unit_rows(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, unit vectors) of the vectors of each length; null, zero and non-finite ones are left out."""
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(length)
    for dim in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == dim)
        v = values[(ends[mine] - dim)[:, None] + np.arange(dim)]
        size = np.sqrt((v * v).sum(axis=1))
        ok = np.isfinite(size) & (size > 0)
        yield dim, np.asarray(ids)[mine[ok]], v[ok] / size[ok, None]


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, query_bytes: int = 4 << 20) -> DataFrame:
    """(query_id, rank, claim_id, similarity) of each query (query_id, query).

    Queries are asked in blocks of about ``query_bytes``, each broadcast; the vectors stay where
    they are, are scored as matrices, and a task gives the k best of a query only. Vectors
    that are null, zero or not finite take no part; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")).where("query_id IS NOT NULL"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("query").cast("long")), F.lit(0))).first()[0]
    blocks = int(-(-8 * size // query_bytes)) or 1
    rows = vectors.select(F.col("claim_id").cast("long").alias("claim_id"), F.col("vec").cast("array<double>").alias("vec")).where("claim_id IS NOT NULL")
    found = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow().combine_chunks()  # query_bytes, about
        by_dim = {dim: (ids, v) for dim, ids, v in _unit_rows(held["query_id"].combine_chunks(), held["query"].combine_chunks())} if held.num_rows else {}
        part = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(by_dim), k), "query_id long, claim_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "claim_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "claim_id", "similarity")


def _nearest(sent, k: int, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0), np.zeros(0, np.int64))
        held = {dim: [none] * len(ids) for dim, (ids, _) in sent.value.items()}
        for batch in batches:
            for dim, ids, v in _unit_rows(batch.column(0), batch.column(1)):
                if dim not in held:
                    continue
                q_ids, q = sent.value[dim]
                for at in range(0, len(q), step):
                    scores = np.round(q[at : at + step] @ v.T, 9)
                    for i, row in enumerate(scores, at):
                        old, old_ids = held[dim][i]
                        some = np.flatnonzero((row >= old[-1] if len(old) == k else row > -2) & (ids != q_ids[i]))
                        if len(some):
                            both, names = np.concatenate((old, row[some])), np.concatenate((old_ids, ids[some]))
                            order = np.lexsort((names, -both))[:k]
                            held[dim][i] = both[order], names[order]
        for dim, best in held.items():
            times = [len(s) for s, _ in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(sent.value[dim][0], times)), pa.array(np.concatenate([i for _, i in best] or [none[1]])), pa.array(np.concatenate([s for s, _ in best] or [none[0]]) + 0.0)],
                ["query_id", "claim_id", "similarity"],
            )

    return run


def lexical(docs: DataFrame, terms: Sequence[str], *, id_col: str = "claim_id", text_col: str = "content") -> DataFrame:
    """(id, score): BM25 of the query's terms. Only matching words leave the scan, with partial counts."""
    words = F.filter(F.split(F.lower(text_col), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    # bound once: a higher-order function evaluates its argument anew wherever it stands
    both = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("len"), F.filter(w, lambda x: x.isin(*terms)).alias("hits")))[0]
    d = stored(docs.select(id_col, both.alias("x")).select(id_col, "x.len", "x.hits"), "hits")  # no texts: read for the statistics and the scores
    stat = d.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    tf = d.select(id_col, "len", F.explode("hits").alias("term")).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (stat["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / (stat["mean"] or 1.0)))
    return tf.join(F.broadcast(df), "term").groupBy(id_col).agg(F.round(F.sum(one), 9).alias("score"))  # as long as the query


def fused(dense: DataFrame, text: DataFrame, k: int = 60, *, id_col: str = "claim_id", depth: int = 100) -> DataFrame:
    """(id, score, rank_dense, rank_text): reciprocal ranks of two bounded lists (id, score), added up."""

    def ranked(d: DataFrame, name: str) -> DataFrame:
        top = d.orderBy(F.desc("score"), id_col).limit(depth)
        return top.select(id_col, F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias(name))

    both = ranked(dense, "rank_dense").join(ranked(text, "rank_text"), id_col, "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("rank_dense") + part("rank_text")).orderBy(F.desc("score"), id_col)


def hits_with_neighbours(hits: DataFrame, edges: DataFrame, similarity: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours over ``edges`` (source_id, target_id, relationship) of ``hits`` (claim_id).

    An edge is outbound where its source is a hit, else inbound. ``similarity`` (claim_id, similarity).
    """
    h = F.broadcast(hits.select(F.col("claim_id").alias("hit")).distinct())  # a page of hits
    out = edges.join(h, edges["source_id"] == h["hit"], "left_semi").select("source_id", "target_id", "relationship", F.lit("outbound").alias("direction"), F.col("target_id").alias("claim_id"))
    back = edges.join(h, edges["source_id"] == h["hit"], "left_anti").join(h, edges["target_id"] == h["hit"], "left_semi")
    back = back.select("source_id", "target_id", "relationship", F.lit("inbound").alias("direction"), F.col("source_id").alias("claim_id"))
    near = out.unionByName(back).join(similarity, "claim_id")
    return near.orderBy(F.desc("similarity"), "claim_id", "source_id", "target_id", "relationship").limit(k)


def merge_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """``hits`` (claim_id, rank, ...) with ``score`` and a new ``position``: scored hits by falling score, the rest behind them as they came.

    All other columns, beliefs above all, stay as they are. Hits are a page of results.
    """
    x = hits.join(scores.select("claim_id", "score"), "claim_id", "left")
    w = Window.orderBy(F.desc_nulls_last("score"), "rank")
    return x.withColumn("position", F.row_number().over(w))


def grounded(hits: DataFrame, verdicts: DataFrame, drop: bool) -> DataFrame:
    """Hits with their ``verdict``; with ``drop`` those judged ungrounded go, those not judged stay."""
    x = hits.join(verdicts.select("claim_id", "verdict"), "claim_id", "left")
    return x.where("verdict IS NULL OR verdict <> 'ungrounded'") if drop else x


def more_evidence_needed(bel: Column, pl: Column, most: float = 0.1) -> Column:
    """Whether a belief interval is wider than ``most``."""
    return F.greatest(pl - bel, F.lit(0.0)) > most


def rag_score(similarity: Column, truth: Column, degree: Column) -> Column:
    return 0.6 * similarity + 0.2 * truth + 0.2 * F.least(degree / 10, F.lit(1.0))


def close_pairs(vectors: DataFrame, most: float, group: str, block: int = 2048) -> DataFrame:
    """(left_id, right_id, distance) within groups: cosine distance below ``most``.

    A group is cut into blocks of about ``block`` vectors, and each pair of blocks is a product of matrices.
    What comes within SLACK of the bound is computed again term by term, so the sums are those of ``cosine``.
    """
    v = vectors.where(F.col(group).isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).select("claim_id", "vec", F.col(group).alias("k"), F.size("vec").alias("n_dims"))
    blocks = v.groupBy("k", "n_dims").agg(F.ceil(F.count("*") / block).cast("long").alias("n_blocks"))
    v = v.join(blocks, ["k", "n_dims"]).withColumn("of", F.pmod(F.xxhash64("claim_id"), F.col("n_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    v = v.select("*", other.alias("with")).select("claim_id", "vec", "k", "n_dims", F.least("of", "with").alias("i"), F.greatest("of", "with").alias("j"), (F.col("of") > F.col("with")).alias("second"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        dims, second = rows.column("n_dims")[0].as_py(), np.asarray(rows.column("second"))
        ids, x = np.asarray(rows.column("claim_id")), np.asarray(pc.list_flatten(rows.column("vec")), np.float64).reshape(len(second), dims)
        a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if rows.column("i")[0] != rows.column("j")[0] else (np.arange(len(ids)),) * 2
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            length = np.sqrt(_in_order(x, x))
            unit, found = x / length[:, None], []
            for k in range(0, len(a), 256):
                p, q = np.nonzero(1 - unit[a[k : k + 256]] @ unit[b].T < most + SLACK)
                p, q = a[k + p], b[q]
                if a is b:
                    p, q = p[p != q], q[p != q]
                    p, q = p[ids[p] < ids[q]], q[ids[p] < ids[q]]
                p, q = np.where(ids[p] <= ids[q], p, q), np.where(ids[p] <= ids[q], q, p)
                d = 1 - _in_order(x[p], x[q]) / (length[p] * length[q])
                on = (d < most) & (ids[p] < ids[q])
                found.append((ids[p[on]], ids[q[on]], d[on]))
        left, right, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"left_id": pa.array(left, pa.int64()), "right_id": pa.array(right, pa.int64()), "distance": pa.array(d, pa.float64())})

    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    return v.repartition(tasks, "k", "n_dims", "i", "j").groupBy("k", "n_dims", "i", "j").applyInArrow(run, "left_id long, right_id long, distance double")


#: More than a matrix product can differ from a sum in order.
SLACK = 1e-9


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def diverse(candidates: list[tuple[int, float, list[float]]], k: int, trade: float = 0.5) -> list[int]:
    """Greedy pick of k of a page of candidates (id, score, vector): score less the closeness to what is picked."""
    if not candidates:
        return []
    ids = [c[0] for c in candidates]
    score = np.array([c[1] for c in candidates])
    v = np.array([c[2] for c in candidates], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    near, picked = np.zeros(len(ids)), []
    for _ in range(min(k, len(ids))):
        gain = np.round(score - trade * near, 12)
        gain[picked] = -np.inf
        best = max(range(len(ids)), key=lambda i: (gain[i], -ids[i]))
        picked.append(best)
        near = np.maximum(near, v @ v[best])
    return [ids[i] for i in picked]


def prior_from_neighbours(similarity: Column, truth: Column) -> dict[str, Column]:
    """Aggregates: the similarity-weighted truth and what kind of prior it is."""
    prior = F.sum(similarity * truth) / F.sum(similarity)
    n, spread = F.count("*"), F.stddev_pop(truth)
    kind = F.when(n < 3, "understudied").when((prior > 0.7) & (spread < 0.3), "established").when(spread >= 0.3, "contested").otherwise("moderate")
    return {"prior": prior, "kind": kind}


def information_value(bel: Column, pl: Column, similarity: Column) -> dict[str, Column]:
    """Aggregates: mean of gap times similarity, mean gap, and how many gaps are wide or middling."""
    gap = F.greatest(pl - bel, F.lit(0.0))
    return {"score": F.sum(gap * similarity) / F.count("*"), "mean_gap": F.avg(gap), "wide": F.count_if(pl - bel > 0.5), "middling": F.count_if((pl - bel > 0.15) & (pl - bel <= 0.5))}


__all__ = ["close_pairs", "cosine", "diverse", "dot", "fused", "grounded", "hits_with_neighbours", "information_value", "knn", "knn_join", "lexical", "merge_rerank", "more_evidence_needed", "prior_from_neighbours", "rag_score"]
