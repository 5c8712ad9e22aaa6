"""Registered queries with their SQL twins, by family."""

from ledgerlens.catalogue import (  # noqa: F401  (imports register the queries)
    bundles,
    classes,
    correlations,
    files,
    logs,
    profiles,
    samples,
    segments,
    times,
)
from ledgerlens.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
