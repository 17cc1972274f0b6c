"""Registered queries over the bridge from ordinary tables to sequences."""

from strandloom.plans import design_queries, file_queries, link_queries, sequence_queries
from strandloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "design_queries", "file_queries", "link_queries", "sequence_queries"]
