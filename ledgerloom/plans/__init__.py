"""Query registry: every operator bound to the driver's tables, with its SQL oracle."""

from importlib import import_module

MODULES = ["provenance", "estimators", "nulls", "detection", "detectors", "hygiene", "guards", "sources", "sinks", "labels", "probes", "cards", "ordered", "pairs", "evidence", "streams"]


def load():
    """Import every query module and return (queries, oracles)."""
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")
    from ledgerloom.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
