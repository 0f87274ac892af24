"""Queries against their SQL on tables that the given ones have no example of."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from claimloom.llm import packing
from claimloom.operators import closure, features, graph, matching, overlap, relational, retrieval
from claimloom.sources.tables import BASE, with_tables


def changed(sf_dir, to, **tables):
    """A copy of ``sf_dir`` with some tables as a query over the others."""
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        if t in tables:
            continue
        os.symlink(f"{sf_dir}/{t}.parquet", f"{to}/{t}.parquet")
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{to}/{t}.parquet'")
    return str(to)


def same_rows(spark, folder, name):
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    want = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == rows
    return rows


LACKING = "SELECT * FROM lineitem WHERE l_partkey % 5 <> 0 OR l_returnflag = 'A'"


@pytest.fixture(scope="module")
def lacking(sf_dir, tmp_path_factory):
    """Every fifth claim has no refuting triples and cites nothing."""
    return changed(sf_dir, tmp_path_factory.mktemp("lacking"), lineitem=LACKING)


def test_f9_features_of_claims_that_lack_members(spark, lacking):
    assert same_rows(spark, lacking, "match_features")


def test_f10_scores_of_claims_that_lack_members(spark, lacking):
    assert same_rows(spark, lacking, "match_scores")


#: All claims are candidates of each other; those of even and of odd ids have one vector each.
ONE_KIND = "SELECT * REPLACE ('b' AS p_brand, 'k' AS p_type) FROM part"
TWO_VECTORS = "SELECT p_partkey AS vec_id, CAST(CASE WHEN p_partkey % 2 = 0 THEN [1e0, 0e0] ELSE [{}, {}] END AS FLOAT[]) AS embedding, 0 AS label FROM part"


def test_f10_scores_on_the_bound_of_a_band(spark, sf_dir, tmp_path):
    """Equal vectors of claims without refuting triples: 0.4 / 0.5, where the sum of the single weights is below 0.5."""
    none = "SELECT * REPLACE ('N' AS l_returnflag) FROM lineitem"
    assert any("'middle'" in r for r in same_rows(spark, changed(sf_dir, tmp_path, part=ONE_KIND, lineitem=none, embeddings=TWO_VECTORS.format("1e0", "0e0")), "match_scores"))


def test_f10_scores_just_below_zero(spark, sf_dir, tmp_path):
    """They are -0.0, as in the SQL."""
    assert any("-0.0," in r for r in same_rows(spark, changed(sf_dir, tmp_path, part=ONE_KIND, embeddings=TWO_VECTORS.format("-200005e-6", "979795e-6")), "match_scores"))


#: Claim, quantity, flag, status and line of masses for and against in balance (1, 2, 3), and of a half at the seventh digit (4).
BALANCED = """SELECT CAST(row_number() OVER () AS BIGINT) AS l_orderkey, CAST(k AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(n AS INTEGER) AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity, 1e0 AS l_extendedprice,
 1e-1 AS l_discount, 0e0 AS l_tax, f AS l_returnflag, s AS l_linestatus, TIMESTAMP '1997-01-01' AS l_shipdate FROM (VALUES (1, 33, 'A', 'O', 3), (1, 11, 'R', 'F', 1), (1, 33, 'R', 'O', 3), (1, 11, 'N', 'F', 1),
 (2, 47, 'R', 'O', 3), (2, 47, 'A', 'F', 3), (2, 47, 'A', 'O', 3), (2, 47, 'R', 'F', 3), (3, 7, 'R', 'F', 3), (3, 7, 'N', 'O', 3), (3, 7, 'A', 'F', 3), (3, 7, 'R', 'O', 3), (4, 25, 'A', 'O', 3), (4, 25, 'A', 'O', 3), (4, 21, 'N', 'O', 3)) v(k, q, f, s, n)"""


@pytest.mark.parametrize("name", ["scoped_belief", "claim_belief"])
def test_f8_belief_to_the_last_bit(spark, sf_dir, tmp_path, name):
    assert len(same_rows(spark, changed(sf_dir, tmp_path, lineitem=BALANCED), name)) == 4


def upward(n, m, seed):
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a < b}
    reach = {v: set() for v in range(n)}
    for a, b in sorted(e, reverse=True):
        reach[a] |= {b} | reach[b]
    return e, {a: r for a, r in reach.items() if r}


@pytest.mark.parametrize("n, m", [(300, 700), (150, 3000)])
def test_f1_f4_closure_against_python(spark, n, m):
    e, want = upward(n, m, n)
    edges = spark.createDataFrame([(10 * a - 5, 10 * b - 5) for a, b in e], "src long, dst long")
    starts = spark.createDataFrame([(10 * a - 5,) for a in [*range(n), 3, 3]], "node long")
    pairs = {(10 * a - 5, 10 * b - 5) for a, r in want.items() for b in r}
    got = [tuple(r) for r in closure.reached(edges, starts).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    assert {tuple(r) for r in closure.reached_counts(edges, starts).collect()} == {(10 * a - 5, len(r)) for a, r in want.items()}


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_f1_f4_passes_in_small_chunks(tmp_path, monkeypatch, held):
    """Heads split over chunks, several blocks, and edges read anew."""
    e, want = upward(200, 1500, 4)
    ids = sorted({v for x in e for v in x})
    for name, columns in (("nodes", {"node": ids}), ("graph", dict(zip(("src", "dst"), zip(*[(ids.index(a), ids.index(b)) for a, b in sorted(e, key=lambda x: x[::-1])], strict=True), strict=True)))):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({k: pa.array(v, pa.int64() if k == "node" else pa.int32()) for k, v in columns.items()}), tmp_path / name / "part-0.parquet")
    monkeypatch.setattr(closure, "HELD_EDGES", held)
    monkeypatch.setattr(closure, "CHUNK_EDGES", 37)
    monkeypatch.setattr(closure, "MOST_WORDS", 1)
    walk = closure._Walk(f"file://{tmp_path}/nodes", f"file://{tmp_path}/graph")
    starts = np.array(sorted(want), np.int64)
    got = set()
    for k in range(0, len(starts), walk.block):
        for b in closure._pairs(walk, starts[k : k + walk.block]):
            got |= set(zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == {(a, b) for a, r in want.items() for b in r}


def test_f1_chains_longer_than_a_thousand(spark, sf_dir, tmp_path):
    """One chain over 1200 claims; the rounds ended at 1000 hops."""
    line = "SELECT CAST(k // 2 AS BIGINT) AS l_orderkey, CAST((k + 1) // 2 AS BIGINT) AS l_partkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(k % 2 AS INTEGER) AS l_linenumber, 1e0 AS l_quantity, 1e0 AS l_extendedprice, 0e0 AS l_discount, 0e0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '1997-01-01' AS l_shipdate FROM range(2400) r(k)"
    folder = changed(sf_dir, tmp_path, lineitem=line)
    assert entry.queries()["elaboration_chains"](spark, folder).count() == 1200 * 1201 // 2


def test_f1_edges_are_made_once(spark, sf_dir):
    """The starts come from the edges as written, not from the tables again."""
    got = entry.queries()["elaboration_chains"](spark, sf_dir)
    assert got.count() and not any("lineitem" in f for f in got.inputFiles())


def test_f5_texts_are_compared_once(spark):
    """Against every pair of claims; equal texts, several groups and nulls."""
    texts = ["red ring", "ring red", "blue ring", "bolt", "Bolt", None, "red ring"]
    rows = [(i, texts[i % 7], f"k{i % 2}", None if i % 11 == 5 else "b") for i in range(60)]
    got = relational.similar_pairs(spark.createDataFrame(rows, "claim_id long, content string, kind string, brand string"), "content", ["kind", "brand"], 0.3)
    pieces = lambda t: {("  " + w + " ")[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}
    want = set()
    for i, s, *g in rows:
        for j, t, *h in rows:
            if i < j and s and t and None not in g and g == h:
                x = len(pieces(s) & pieces(t)) / len(pieces(s) | pieces(t))
                want |= {(i, j, round(x, 9))} if x >= 0.3 else set()
    found = [(r[0], r[1], round(r[2], 9)) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("part_rows", [1 << 20, 90])
@pytest.mark.parametrize("least", [1, 3])
def test_f6_shared_keys_against_python(spark, part_rows, least):
    """Rare keys, one of all members, copies, repeated rows and nulls; no row for each shared key of a pair."""
    rng = np.random.default_rng(6)
    rows = [(int(c) * 7 - 40, k, int(o)) for c, k, o in zip(rng.integers(0, 60, 500), rng.choice(["x", "y"], 500), rng.integers(0, 40, 500), strict=True)]
    rows += [(c * 7 - 40, "all", o) for c in range(60) for o in (1, 2)] + [(c, "copy", o) for c in (1000, 1001, 1002) for o in range(5)]
    rows += rows[:50] + [(3, None, 1), (4, None, 1), (None, "x", 1), (5, "x", None)]
    held = {}
    for c, k, o in rows:
        if None not in (c, k, o):
            held.setdefault(c, set()).add((k, o))
    got = overlap.sharing(spark.createDataFrame(rows, "claim_id long, k string, o long"), ["k", "o"], least, part_rows=part_rows)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = [tuple(r) for r in got.collect()]
    want = {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= least}
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("seed", range(5))
def test_f6_long_lists_are_searched(seed):
    rng = np.random.default_rng(seed)
    lists = [np.unique(rng.integers(0, 400, n)) for n in (3, 5, 8, 9, 2000, 5000, 9000)]
    for least in range(1, 8):
        v, n = np.unique(np.concatenate(lists), return_counts=True)
        assert overlap._common(lists, least).tolist() == v[n >= least].tolist()


def test_f7_pairs_of_a_cluster_once_each(spark):
    members = spark.createDataFrame([(i, None if i % 13 == 0 else i % 3) for i in range(100)], "claim_id long, theme_id int")
    got = matching.block_equal(members, "theme_id")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    want = {(i, j) for j in range(100) for i in range(j) if i % 13 and j % 13 and i % 3 == j % 3}
    assert len(rows) == len(want) and set(rows) == want


def test_f2_members_meet_at_ancestors(spark):
    e, _ = upward(40, 60, 2)
    near = {v: {v: 0} for v in range(40)}
    for _ in range(3):
        for a, b in e:
            for x, d in list(near[a].items()):
                if d < 3:
                    near[b][x] = min(near[b].get(x, 9), d + 1)
    want = {(a, b, *min((near[a][x] + near[b][x], x) for x in near[a] if x in near[b])[::-1]) for b in range(40) for a in range(b) if a % 2 == b % 2 and near[a].keys() & near[b].keys()}
    edges = spark.createDataFrame(sorted(e), "source_id long, target_id long")
    got = graph.lowest_common_ancestors(edges, spark.createDataFrame([(v, v % 2) for v in range(40)], "node long, k int"), ["k"], 3)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("block", [5, 2048])
def test_f3_blocks_give_all_close_pairs(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 2) for i in range(60)] + [(60, None, 0), (61, [0.0] * 4, 0), (62, [1.0, None, 0.0, 0.0], 1), (63, [float("nan")] * 4, 1), (64, [1.0] * 4, None)]
    vectors = spark.createDataFrame(rows, "claim_id long, vec array<double>, theme_id int")
    want = {}
    for j in range(60):
        for i in range(j % 2, j, 2):
            x, y = rows[i][1], rows[j][1]
            d = 1 - sum(p * q for p, q in zip(x, y, strict=True)) / (sum(p * p for p in x) ** 0.5 * sum(q * q for q in y) ** 0.5)
            if d < 0.7:
                want[i, j] = d
    got = {(r[0], r[1]): r[2] for r in retrieval.close_pairs(vectors, 0.7, "theme_id", block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_f11_packing_is_the_same_for_all_batches():
    """Lengths of more items than batches: what each sequence holds does not depend on the batches."""
    counts = np.bincount(np.clip(np.random.default_rng(11).lognormal(3.0, 0.9, 4000).astype(int), 1, 99), minlength=101)
    fills = []
    for parts in (10**9, 512, 3, 1):
        runs, used = packing.sum_of_squares(counts, 100, parts)
        held = [[] for _ in range(used)]
        for length, count, sequence in zip(runs.length, runs.count, runs.sequence, strict=True):
            for k in range(count):
                held[sequence + k].append(length)
        fills.append(held)
    assert fills[1:] == fills[:1] * 3


def reaches(e):
    """What each node reaches over edges in any direction, cycles included."""
    out, want = {}, {}
    for a, b in e:
        out.setdefault(a, []).append(b)
    for a in out:
        want[a], todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in want[a]:
                    want[a].add(b)
                    todo.append(b)
    return want


def both_ways(seed):
    """Cycles, a loop, a chain downwards and one that turns at each node."""
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 90, (110, 2))} | {(89, 89)}
    turns = [x for k in range(20) for x in (200 + k, 239 - k)]
    return sorted(e | {(k, k - 1) for k in range(101, 140)} | set(zip(turns[:-1], turns[1:], strict=True)))


def test_r03_f2_closure_over_edges_of_both_directions(spark):
    e = both_ways(1)
    want = reaches(e)
    edges = spark.createDataFrame([(10 * a - 5, 10 * b - 5) for a, b in e] + [(None, 5), (5, None)], "src long, dst long")
    starts = spark.createDataFrame([(10 * a - 5,) for a in [*range(250), 3, 3]], "node long")
    assert {tuple(r) for r in closure.reached_counts(edges, starts).collect()} == {(10 * a - 5, len(r)) for a, r in want.items()}
    got = [tuple(r) for r in closure.reached(edges).collect()]
    pairs = {(10 * a - 5, 10 * b - 5) for a, r in want.items() for b in r}
    assert len(got) == len(pairs) and set(got) == pairs


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_r03_f2_both_directions_in_small_chunks(tmp_path, monkeypatch, held):
    """Heads split over chunks and files, several blocks, and edges read anew."""
    e = both_ways(2)
    want = reaches(e)
    ids = sorted({v for x in e for v in x})
    at = [(ids.index(a), ids.index(b)) for a, b in e]
    last = len(ids) - 1
    tables = {"nodes": [pa.table({"node": pa.array(ids, pa.int64())})]}
    for name, rows in (("up", [x for x in at if x[0] <= x[1]]), ("down", [(last - a, last - b) for a, b in at if a > b])):
        rows = np.array(sorted(rows, key=lambda x: x[::-1]), np.int32)
        tables[name] = [pa.table({"src": part[:, 0], "dst": part[:, 1]}) for part in np.array_split(rows, 4)]
    for name, parts in tables.items():
        (tmp_path / name).mkdir()
        for k, part in enumerate(parts):
            pq.write_table(part, tmp_path / name / f"part-{k}.parquet")
    monkeypatch.setattr(closure, "HELD_EDGES", held)
    monkeypatch.setattr(closure, "CHUNK_EDGES", 13)
    monkeypatch.setattr(closure, "MOST_WORDS", 1)
    walk = closure._Walk(*(f"file://{tmp_path}/{name}" for name in ("nodes", "up", "down")))
    starts, got = np.array(sorted(want), np.int64), set()
    for k in range(0, len(starts), walk.block):
        for b in closure._pairs(walk, starts[k : k + walk.block]):
            got |= set(zip(*(c.to_pylist() for c in b.columns), strict=True))
    assert got == {(a, b) for a, r in want.items() for b in r}


def test_r03_f2_counts_over_all_edges(spark, sf_dir):
    """Half of the edges lead to a smaller claim, and count too."""
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = reaches(c.execute(with_tables("SELECT DISTINCT source_id, target_id FROM edges")).fetchall())
    seeds = {x for x, in c.execute("SELECT p_partkey FROM part WHERE p_size >= 49").fetchall()}
    got = {tuple(r) for r in entry.queries()["reachable_counts"](spark, sf_dir).select("a", "reachable").collect()}
    assert got == {(a, len(r)) for a, r in want.items() if a in seeds}
    assert same_rows(spark, sf_dir, "reachable_counts")


def test_r03_f1_features_without_rows_of_pairs_in_joins(spark, lacking):
    got = entry.queries()["match_features"](spark, lacking)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and not any("lineitem" in f for f in got.inputFiles())


def test_r03_f1_features_just_below_zero(spark, sf_dir, tmp_path):
    """They are -0.0, as in the SQL; one block of all claims."""
    folder = changed(sf_dir, tmp_path, part=ONE_KIND, embeddings=TWO_VECTORS.format("-3e-7", "1e0"))
    assert any("-0.0," in r for r in same_rows(spark, folder, "match_features"))


@pytest.mark.parametrize("chunk, batch", [(40, 7), (64, 2000), (5000, 50)])
def test_r03_f1_features_over_small_chunks_and_batches(spark, sf_dir, tmp_path, monkeypatch, chunk, batch):
    """Few large blocks, cut into chunks and batches; pairs of both blockers come once."""
    monkeypatch.setattr(features, "CHUNK_ROWS", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        part = "SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE 'c' END AS p_brand, 'k' AS p_type, CAST(p_size % 3 + 2 AS INTEGER) AS p_size) FROM part"
        assert same_rows(spark, changed(sf_dir, tmp_path, part=part, lineitem=LACKING), "match_features")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_r03_f1_vectors_with_gaps_or_of_other_lengths_have_no_cosine():
    vectors = pa.array([[1.0, 0.0], None, [1.0, None], [1.0], [], [0.0, 0.0], [3.0, 4.0], [float("nan"), 1.0], [2.0]], pa.list_(pa.float64()))
    i, j = (x.ravel() for x in np.triu_indices(len(vectors), 1))
    value, gone = features._cosine(vectors, i, j)
    got = {(int(a), int(b)): float(v) for a, b, v, g in zip(i, j, value, gone, strict=True) if not g}
    assert got[0, 6] == 0.6 and got[3, 8] == 1.0 and np.isnan(got[0, 7]) and np.isnan(got[6, 7]) and np.isnan(got[5, 7]) and len(got) == 5
