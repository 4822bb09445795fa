"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

from importlib import import_module

from cyclograin.plans.registry import QUERIES, Query

MODULES = ("catalog_rows", "catalog_stats", "catalog_audit", "catalog_models")


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"cyclograin.plans.{m}")
    return QUERIES
