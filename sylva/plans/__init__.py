"""Queries of all operators; each module adds its own to queries.QUERIES and queries.SQL."""

from sylva.plans import queries  # noqa: F401  first, as the others add to it
from sylva.plans import evaluation_queries, graph_queries, label_queries, source_queries  # noqa: F401
