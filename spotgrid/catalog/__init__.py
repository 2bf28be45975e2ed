"""Registered queries over the test tables, each with an equivalent SQL text where one exists."""

from spotgrid.catalog import flows, grids, ingest, losses, matrices, scalars, streams, tokens  # noqa: F401
from spotgrid.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
