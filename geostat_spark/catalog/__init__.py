"""Every operator as a named query over the given tables."""

from __future__ import annotations


def load():
    """(queries, oracles), with all query modules imported."""
    import importlib

    from geostat_spark.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"geostat_spark.catalog.{module}")
    return QUERIES, ORACLES


MODULES = ["tabular", "statistics", "modelling", "clusters"]
