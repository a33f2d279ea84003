"""All queries of the core by name, and their SQL for comparison."""

from __future__ import annotations

from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
