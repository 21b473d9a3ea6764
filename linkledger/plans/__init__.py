"""Runnable queries: every operator on the driver tables, with SQL twins."""

from importlib import import_module

MODULES = ("source_queries", "scalar_queries", "spectra_queries", "graph_queries", "rule_queries", "integrity_queries",
           "matching_queries", "lifecycle_queries", "coverage_queries", "streaming_queries")


def load_catalog():
    """(queries, oracles) of all query modules."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    catalog = import_module(f"{__name__}.catalog")
    return catalog.QUERIES, catalog.ORACLES
