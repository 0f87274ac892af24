"""A small pattern language over the graph, and its plan.

    MATCH (a:Label)-[r:REL*min..max]->(b:Label) WHERE a.prop > 0.5 RETURN a, b LIMIT n

One node, or one hop pattern; hop ranges default to 1..1, ``*`` is 1..10, ``*..n`` is
0..n, and plans stop at MAX_HOPS. One WHERE condition on the first variable. LIMIT is of
seeds. The result is the subgraph that the reached nodes induce. ``strict`` also applies
the target's label and a condition on the target.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import oriented, reach

MAX_HOPS, DEFAULT_LIMIT, MOST_SEEDS = 4, 200, 1000
OPERATORS = ("<=", ">=", "<>", "!=", "=", "<", ">", "CONTAINS")

_NODE = r"\(\s*(?P<{0}>\w+)?\s*(?::\s*(?P<{0}_label>\w+)\s*)?\)"
_PATTERN = re.compile(
    r"^\s*MATCH\s+" + _NODE.format("a") + r"(?:\s*-\[\s*(?P<r>\w+)?\s*(?::\s*(?P<rel>\w+)\s*)?(?P<hops>\*\s*(?:(?P<low>\d+)?\s*(?P<dots>\.\.)?\s*(?P<high>\d+)?)?\s*)?\]->\s*" + _NODE.format("b") + r")?"
    r"(?:\s+WHERE\s+(?P<var>\w+)\.(?P<prop>\w+)\s*(?P<op><=|>=|<>|!=|=|<|>|CONTAINS)\s*(?P<value>'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false))?"
    r"\s+RETURN\s+(?P<ret>\*|\w+(?:\s*,\s*\w+)*)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.IGNORECASE,
)


class GqlError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    var: str | None
    label: str | None
    rel: str | None
    target: str | None
    target_label: str | None
    hops: tuple[int, int] | None
    condition: tuple[str, str, str, object] | None
    returned: tuple[str, ...]
    limit: int


def parse(text: str) -> Query:
    m = _PATTERN.match(text)
    if not m:
        raise GqlError(f"cannot read: {text!r}")
    hops = None
    if "-[" in text:
        low, high = m["low"], m["high"]
        if m["hops"] is None:
            hops = (1, 1)
        elif m["dots"]:
            hops = (int(low or 0), int(high) if high else 10)
        else:
            hops = (int(low), int(low)) if low else (1, 10)
        if hops[0] > hops[1]:
            raise GqlError("the least number of hops is above the most")
    condition = None
    if m["var"]:
        raw = m["value"]
        value: object = raw[1:-1] if raw[0] in "'\"" else raw.lower() == "true" if raw.lower() in ("true", "false") else float(raw)
        condition = (m["var"], m["prop"], m["op"].upper(), value)
        if m["var"] not in (m["a"], m["b"]):
            raise GqlError(f"{m['var']} is not matched")
    return Query(m["a"], m["a_label"], m["rel"], m["b"], m["b_label"], hops, condition, tuple(x.strip() for x in m["ret"].split(",")), min(int(m["limit"] or DEFAULT_LIMIT), MOST_SEEDS))


def _test(column: Column, op: str, value: object) -> Column:
    if op == "CONTAINS":
        return column.contains(value)
    return {"=": column == value, "<>": column != value, "!=": column != value, "<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value}[op]


def run(text: str, nodes: DataFrame, edges: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, depth) and the edges between them. ``nodes`` has node, label and properties."""
    q = parse(text)
    seeds = nodes if q.label is None else nodes.where(F.lower("label") == q.label.lower())
    if q.condition and (q.condition[0] == q.var):
        seeds = seeds.where(_test(F.col(q.condition[1]), *q.condition[2:]))
    seeds = seeds.orderBy("node").limit(q.limit).select("node")
    if q.hops is None:
        found = seeds.withColumn("depth", F.lit(0))
    else:
        use = edges if q.rel is None else edges.where(F.lower("relationship") == q.rel.lower())
        low, high = q.hops[0], min(q.hops[1], MAX_HOPS)
        found = reach(oriented(use, "out"), seeds, high)
        if strict:
            target = nodes if q.target_label is None else nodes.where(F.lower("label") == q.target_label.lower())
            if q.condition and q.condition[0] == q.target and q.target != q.var:
                target = target.where(_test(F.col(q.condition[1]), *q.condition[2:]))
            found = found.where("depth = 0").unionByName(found.where(F.col("depth") >= max(low, 1)).join(target.select("node"), "node", "left_semi"))
    inside = lambda c: found.select(F.col("node").alias(c))
    between = edges.join(inside("source_id"), "source_id", "left_semi").join(inside("target_id"), "target_id", "left_semi")
    return found, between
