"""Registered queries over the benchmark tables and the SQL they are checked against."""

from importlib import import_module

FAMILIES = ("scans", "scalars", "joins", "aggregates", "windows", "instruments", "robustness", "survival", "prediction", "updates", "streams")


def all_queries():
    from sitefold.plans.registry import REGISTRY

    for family in FAMILIES:
        import_module(f"sitefold.plans.{family}_queries")
    return REGISTRY
