"""Logical tables of an evidence graph over the parquet tables, in SQL that two engines run."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Each may use base tables and those before it.
DERIVED = {
    "claims": """SELECT p_partkey AS claim_id, p_name AS content, round(p_size / 5e1, 6) AS truth_value,
        p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS price FROM part""",
    "agents": "SELECT s_suppkey AS agent_id, s_name AS name, s_nationkey AS perspective_id, s_acctbal AS balance FROM supplier",
    "links": """SELECT l_orderkey AS source_key, l_partkey AS source_id, lead(l_partkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS target_id,
        CASE l_returnflag WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'supports' ELSE 'elaborates' END AS relationship,
        round(1 - l_discount, 6) AS strength, l_shipdate AS valid_from,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 30 DAY END AS valid_to FROM lineitem""",
    "edges": "SELECT * FROM links WHERE target_id IS NOT NULL AND target_id <> source_id",
    "dag": "SELECT DISTINCT source_id, target_id FROM edges WHERE relationship = 'supports' AND source_id < target_id",
    "bba": """SELECT l_partkey AS claim_id, l_suppkey AS agent_id,
        CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE round(2e-1 + 6e-1 * l_quantity / 5e1, 6) END AS m_sup,
        CASE WHEN l_returnflag = 'R' THEN round(2e-1 + 6e-1 * l_quantity / 5e1, 6) ELSE 0e0 END AS m_unsup,
        CASE WHEN l_linestatus = 'O' THEN 'empirical' ELSE 'testimonial' END AS evidence_type,
        CASE WHEN l_linenumber % 3 = 0 THEN 'intra_self_cite' ELSE 'cross' END AS locality_tag,
        round(1 - l_discount, 6) AS source_strength, l_shipdate AS created_at, l_orderkey AS evidence_key, l_linenumber AS evidence_line FROM lineitem""",
    "eventlog": """SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS graph_version, event_id, ts, user_id, event_type, value, props FROM events""",
    "triples": "SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS subject_id, l_returnflag AS predicate, l_suppkey AS object_id FROM lineitem",
    "executions": "SELECT event_id, user_id AS workflow_id, ts, event_type <> 'error' AS success, value FROM events",
}


def _named(text: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def with_tables(sql: str) -> str:
    """``sql`` with the derived tables that it names in front, for a plain SQL engine."""
    need, text = [], sql
    for name in reversed(list(DERIVED)):
        if _named(text, [name]):
            need.append(name)
            text += " " + DERIVED[name]
    if not need:
        return sql
    head = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in DERIVED if n in need)
    m = re.match(r"\s*WITH(\s+RECURSIVE)?\s+", sql, re.IGNORECASE)
    if m:
        return f"WITH{m[1] or ''} {head},\n{sql[m.end():]}"
    return f"WITH {head}\n{sql}"


class Tables:
    """Base and derived tables as DataFrames: ``Tables(spark, sf_dir).edges``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE, *DERIVED):
            raise AttributeError(name)
        if name not in self._held:
            self._held[name] = table(self.spark, self.sf_dir, name) if name in BASE else self.sql(DERIVED[name])
        return self._held[name]

    def sql(self, text: str) -> DataFrame:
        """A query over base and derived tables."""
        used = _named(text, (*BASE, *DERIVED))
        for n in used:
            getattr(self, n)
        for n in used:
            self._held[n].createOrReplaceTempView(n)
        return self.spark.sql(text)

    @cached_property
    def vectors(self) -> DataFrame:
        """claim_id, vec (array of double), theme_id."""
        return self.embeddings.selectExpr("vec_id AS claim_id", "CAST(embedding AS ARRAY<DOUBLE>) AS vec", "label AS theme_id")
