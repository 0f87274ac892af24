"""Registered queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from claimloom.plans import catalogue
from claimloom.sources.tables import BASE

QUICK = (
    "claim_belief", "belief_as_of", "scoped_belief", "bba_discount", "pair_dempster", "pair_inagaki", "pair_cautious", "dempster_monoid", "alternative_set_mass", "frame_measures", "directed_masses",
    "error_budgets", "text_uncertainty", "bayesian_fold", "evidence_weights", "edge_masses", "conformal_sets", "claim_listing", "labels_contain_all", "undecomposed_claims", "edges_of_either_end",
    "full_join_sides", "exact_median", "top_contesters", "vector_centroids", "distinct_on_latest", "rising_streaks", "weekly_activity", "trigram_similarity", "upsert", "ancestor_lineage",
    "lowest_common_ancestor", "alternative_sets", "derivation_roots", "clustering_coefficient", "topological_order", "gql_nodes", "transitive_support", "scalar_propagation", "interval_propagation",
    "truth_propagation", "sheaf_cohomology", "interval_sections", "theme_assignment", "knn_candidates", "hybrid_fusion", "graph_recall", "match_scores", "agent_reputation", "wilson_intervals",
    "stream_refresh", "event_versions", "lateral_factor_map", "semi_join_scope", "seed_expansion",
)


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str([norm(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_rows_equal_those_of_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall()) and got


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[0] == "claim_id"
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0
