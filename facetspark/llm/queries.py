"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import clusters, history, leakage, neighbours, packing, pii, quantiles, subset, survivor

MODULES = (survivor, history, subset, neighbours, clusters, quantiles, packing, leakage, pii)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
