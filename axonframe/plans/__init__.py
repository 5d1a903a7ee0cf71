"""Registered queries."""

from axonframe.plans import (  # noqa: F401
    corpus_queries,
    prompt_queries,
    record_queries,
    score_queries,
    source_queries,
)
from axonframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
