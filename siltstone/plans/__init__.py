"""Queries over the driver's tables that compose the operators, each beside the SQL that it is held against."""

from siltstone.plans import (  # noqa: F401
    agents,
    console,
    curation,
    governance,
    graph,
    ingest,
    records,
    search,
    vectors,
)
from siltstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
