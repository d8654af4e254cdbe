"""Queries over the test tables, with their SQL."""

from .bindings import ORACLE_SQL, QUERIES
from . import maintain_queries, match_queries, stats_queries, variant_queries  # noqa: F401  they register themselves
