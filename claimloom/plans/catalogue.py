"""All registered queries."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ("evidence", "relational", "graph", "inference", "retrieval", "matching", "streaming", "sources")

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
