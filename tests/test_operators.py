"""Operators against plain Python."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.functions import evidence as E
from claimloom.operators import cluster, combine, components, gql, graph, inference, retrieval


def masses(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = round(rng.uniform(0.1, 0.8), 3)
        out.append((x, 0.0, 1 - x) if rng.random() < 0.5 else (0.0, x, 1 - x))
    return out


def as_mass(m):
    return {k: v for k, v in zip(((1, False), (2, False), (3, False)), m, strict=True) if v}


@pytest.mark.parametrize("seed", range(5))
def test_native_fold_equals_general_fold(spark, seed):
    ms = masses(6 + seed, seed)
    want = combine.combine_all([as_mass(m) for m in ms], 3)
    shuffled = random.Random(1).sample(ms, len(ms))
    rows = spark.createDataFrame(shuffled, "a double, b double, c double").agg(F.collect_list(E.binary(F.col("a"), F.col("b"), F.col("c"))).alias("ms"))
    got = rows.select(E.fold("ms").alias("m")).first()["m"]
    again = combine.folded(rows.select("ms"), "ms").first()["ms"]
    assert all(abs(again[k] - got[k]) < 1e-12 for k in combine.PARTS)
    for key, name in (((1, False), "m0"), ((2, False), "m1"), ((3, False), "th"), ((0, False), "cf"), ((3, True), "ms")):
        assert got[name] == pytest.approx(want.get(key, 0.0), abs=1e-9)


def test_order_of_sources_does_not_matter():
    ms = [{(1, False): 0.7, (7, False): 0.3}, {(3, False): 0.6, (7, False): 0.4}, {(2, False): 0.5, (7, False): 0.5}]
    want = combine.combine_all(ms, 7)
    for p in itertools.permutations(ms):
        got = combine.combine_all(p, 7)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rules_keep_mass_and_meet_elements():
    a, b = {(1, False): 0.6, (7, False): 0.4}, {(2, False): 0.5, (6, True): 0.2, (7, False): 0.3}
    for m in (combine.conjunctive(a, b), combine.dempster(a, b), combine.moved(a, b, (7, False)), combine.moved(a, b, (0, True)), combine.dubois_prade(a, b), combine.inagaki(a, b, 0.4, 7), combine.discount(a, 0.3, 7), combine.cautious(a, {(3, False): 1.0}, 7)):
        assert sum(m.values()) == pytest.approx(1)
    assert combine.meet((1, False), (3, True)) == (0, False) and combine.meet((6, True), (1, False)) == (1, False) and combine.meet((1, True), (2, True)) == (3, True)
    assert combine.dempster({(1, False): 1.0}, {(2, False): 1.0}) is None
    assert combine.combine_all([], 3) is None


@pytest.mark.parametrize("text", ["", "~", "0", "~0,1", "0,1,3"])
def test_wire_keys(text):
    assert combine.text_key(*combine.parse_key(text)) == text


def test_total_conflict_is_a_row_with_an_error(spark):
    rows = spark.createDataFrame([(1, {"0": 1.0}, 1.0), (1, {"1": 1.0}, 1.0), (2, {"0,1": 1.0}, 0.5)], "claim_id long, masses map<string,double>, alpha double")
    got = {r["claim_id"]: r for r in combine.combine_groups(rows, ["claim_id"], 2).collect()}
    assert got[2]["masses"] == {"0,1": 1.0} and got[2]["error"] is None
    assert got[1]["masses"] == {"~0,1": pytest.approx(1.0)} or got[1]["error"]


def test_unit_and_uncertainty(spark):
    x = spark.createDataFrame([(float("nan"),), (-0.0,), (2.0,), (0.3,)], "x double").select(E.unit(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in x] == [0.0, 0.0, 1.0, 0.3] and math.copysign(1, x[1]["x"]) == 1
    texts = ["±5%", "(10 ± 2)", "10 ± 1", "95% CI [1, 3]", "p < 0.01", "p = 0.2", "none", "0 ± 1", "(4 ± 1) and ± 30 %"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.uncertainty(F.col("t"))).collect()]
    assert got[:4] == [0.05, 0.2, 0.1, 0.99] and got[4] == 0.1 and got[5] == pytest.approx(0.6) and got[6:8] == [None, None] and got[8] == 0.3


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source_id long, target_id long")


def test_graphs_against_python(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(50)})
    e = edges(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    depth, front = {0: 0}, {0}
    for d in range(1, 6):
        front = {y for x in front for y in near.get(x, ())} - depth.keys()
        depth |= {x: d for x in front}
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in graph.reach(graph.oriented(e, "out"), seeds, 5).collect()} == depth
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(graph.oriented(e, "out")).collect()}
    assert got == root
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "node long, parent long")
    assert {r["root"] for r in graph.roots_of(chain).collect()} == {50}
    assert graph.topological_levels(edges(spark, [(1, 2), (2, 1)])).count() == 0


@pytest.mark.parametrize(
    ("text", "hops", "limit"),
    [("MATCH (a) RETURN *", None, 200), ("MATCH (a:claim)-[r]->(b) RETURN a, b", (1, 1), 200), ("match (a)-[:supports*]->(b) return a limit 5000", (1, 10), 1000), ("MATCH (a)-[r:x*..3]->(b) RETURN b", (0, 3), 200), ("MATCH (a)-[r*2..4]->(b) WHERE a.p = 'x' RETURN a", (2, 4), 200)],
)
def test_patterns_are_read(text, hops, limit):
    q = gql.parse(text)
    assert q.hops == hops and q.limit == limit


@pytest.mark.parametrize("text", ["", "MATCH a RETURN a", "MATCH (a) WHERE a.x > 1 AND a.y < 2 RETURN a", "MATCH (a)-[r*4..2]->(b) RETURN a", "MATCH (a) WHERE z.x = 1 RETURN a"])
def test_other_texts_are_refused(text):
    with pytest.raises(gql.GqlError):
        gql.parse(text)


def test_strict_patterns_filter_the_target(spark):
    nodes = spark.createDataFrame([(1, "claim", 0.9), (2, "claim", 0.2), (3, "agent", 0.9)], "node long, label string, truth double")
    e = spark.createDataFrame([(1, 2, "supports"), (1, 3, "supports"), (2, 3, "refutes")], "source_id long, target_id long, relationship string")
    text = "MATCH (a:claim)-[r:supports]->(b:agent) WHERE a.truth > 0.5 RETURN a, b"
    plain, strict = (sorted(r["node"] for r in gql.run(text, nodes, e, strict=s)[0].collect()) for s in (False, True))
    assert plain == [1, 2, 3] and strict == [1, 3]


def test_scalar_propagation_against_python(spark):
    fac = [(1, 2, "directional_support", 0.7, 0.15), (2, 3, "mutual_exclusion", 0.0, 0.0), (1, 3, "evidential_support", 0.8, 0.8), (3, 4, "temporal_ordering", 0.4, 0.4), (4, 1, "conditional_dependence", 0.6, 0.6), (2, 4, "directional_support", 0.0, 0.6)]
    prior = {1: 0.9, 2: 0.3, 3: 0.5, 4: 0.7, 5: 0.2}

    def told(kind, s, other, own, to_b):
        if kind == "mutual_exclusion":
            return 1 - other
        if kind == "evidential_support":
            return s * other
        if kind == "directional_support":
            return 0.5 if s < 1e-9 else s * other
        if kind == "conditional_dependence":
            return other * s + own * (1 - s) if to_b else own
        return (other if other > s else 0.5) if to_b else 0.5

    now = dict(prior)
    for _ in range(4):
        heard = {}
        for a, b, kind, fwd, rev in fac:
            heard.setdefault(a, []).append(told(kind, rev, now[b], now[a], False))
            heard.setdefault(b, []).append(told(kind, fwd, now[a], now[b], True))
        new = dict(now)
        for v, ms in heard.items():
            signal = min(max(math.exp(sum(math.log(max(m, 1e-12)) for m in ms) / len(ms)), 0.01), 0.99)
            new[v] = min(max(0.5 * now[v] + 0.5 * (0.5 * prior[v] + 0.5 * signal), 0.01), 0.99)
        now = new
    got = inference.scalar_bp(spark.createDataFrame(fac, "a long, b long, kind string, forward double, reverse double"), spark.createDataFrame(list(prior.items()), "var long, prior double"), tolerance=0.0, rounds=4)
    assert {r["var"]: pytest.approx(r["belief"], abs=1e-9) for r in got.collect()} == now


def test_mass_propagation_keeps_mass(spark):
    fac = spark.createDataFrame([(1, 2, "directional_support", 0.7, 0.15), (2, 3, "mutual_exclusion", 0.0, 0.0)], "a long, b long, kind string, forward double, reverse double")
    ev = spark.createDataFrame([(1, 0.8, 0.0, 0.2), (2, 0.0, 0.5, 0.5), (3, 0.4, 0.1, 0.5)], "var long, a double, b double, c double").select("var", E.binary(F.col("a"), F.col("b"), F.col("c")).alias("m"))
    for r in inference.mass_bp(fac, ev, rounds=4).collect():
        assert sum(r["m"]) == pytest.approx(1)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in (range(1, 6), range(11, 16)) for a, b in itertools.combinations(g, 2)] + [(5, 11)]
    of = cluster.local_moving(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), np.ones(len(pairs)))
    assert len(set(of.values())) == 2 and len({of[i] for i in range(1, 6)}) == 1
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source_id long, target_id long, weight double")
    got = cluster.communities(e)
    assert cluster.modularity(e, got) >= 0.3
    seq = spark.createDataFrame(list(of.items()), "node long, community long")
    assert cluster.modularity(e, seq) == pytest.approx(2 * (10 / 21 - (21 / 42) ** 2), abs=1e-9)


def test_diverse_pick():
    got = retrieval.diverse([(1, 0.9, [1, 0]), (2, 0.89, [1, 0.01]), (3, 0.5, [0, 1])], 2, trade=0.6)
    assert got == [1, 3] and retrieval.diverse([], 3) == []


def test_strength_of_unknown_types(spark):
    rows = [("empirical", "cross", 0.2, 1.0), ("empirical", "intra_x", 0.2, 1.0), ("odd", "intra", 0.2, None), ("odd", "cross", None, None), (None, "cross", 0.7, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, l string, s double, w double")
    got = [r[0] for r in df.select(combine.effective_strength(F.col("t"), F.col("l"), F.col("s"), F.col("w"), F.lit(0.3))).collect()]
    assert got == [1.0, pytest.approx(0.3), 0.2, 0.5, 0.7, 0.5]


def test_stream_of_files_in_no_order_refreshes_every_user(spark, tmp_path):
    """40 files, the newest first: more than one micro-batch, and no row is late."""
    import os
    import shutil

    import __spark_entry__ as entry

    (tmp_path / "events.parquet").mkdir()
    for k in range(40):
        day = f"{tmp_path}/day{k}"
        spark.sql(f"SELECT CAST({k} AS BIGINT) AS event_id, timestamp_ntz'2024-02-20' - make_dt_interval({k}) AS ts, CAST({k} AS BIGINT) AS user_id, 'x' AS event_type, CAST({k} AS DOUBLE) AS value").coalesce(1).write.parquet(day)
        (part,) = [f for f in os.listdir(day) if f.endswith(".parquet")]
        to = tmp_path / "events.parquet" / f"part-{k:02}.parquet"
        shutil.copy(f"{day}/{part}", to)
        os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
    got = {r["user_id"]: (r["n"], r["mean_value"]) for r in entry.queries()["stream_refresh"](spark, str(tmp_path)).collect()}
    assert got == {k: (1, float(k)) for k in range(40)}


@pytest.mark.parametrize("seed", range(20))
def test_edges_of_a_task_become_stars(seed, monkeypatch):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(40))) if a > b]
    least = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    u, v = components.least_of(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    assert list(zip(u.tolist(), v.tolist())) == sorted((x, y) for x, y in least.items() if x != y)
    # in small steps, and let go early
    monkeypatch.setattr(components, "STEP_EDGES", 3)
    monkeypatch.setattr(components, "HELD_EDGES", 5)
    batches = [pa.RecordBatch.from_pylist([{"u": a, "v": b}]) for a, b in edges]
    again = [(r["u"], r["v"]) for out in components._contract(iter(batches)) for r in out.to_pylist()]
    u, v = components.least_of(np.array([a for a, _ in again], np.int64), np.array([b for _, b in again], np.int64))
    assert list(zip(u.tolist(), v.tolist())) == sorted((x, y) for x, y in least.items() if x != y)


def test_components_of_text_nodes(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")], "u string, v string")
    assert {(r["node"], r["root"]) for r in components.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
