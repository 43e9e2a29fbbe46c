"""Lineage, usage and pruning of business-intelligence models with Spark DataFrames."""

from modelsieve.operators import (
    extract_model,
    extract_report,
    graph,
    lineage,
    links,
    refs,
    search_index,
    subset,
    unused,
    usage,
)
from modelsieve.sources import catalog, definitions, manifests, reimport

__all__ = [
    "catalog",
    "definitions",
    "extract_model",
    "extract_report",
    "graph",
    "lineage",
    "links",
    "manifests",
    "refs",
    "reimport",
    "search_index",
    "subset",
    "unused",
    "usage",
]
