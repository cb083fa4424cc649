"""Correctness gate: every operator as a query over the given tables, with its oracle."""

from gate import q_elements, q_given, q_more, q_overview, q_tree  # noqa: F401
from gate.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
