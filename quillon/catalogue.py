"""The registered analytics and their SQL."""

from __future__ import annotations

from quillon.analytics import audits, compliance, composites, lake, matching, measures, monitoring, networks, risk, rulebook, scalars, search, strings, tables, values  # noqa: F401  registers
from quillon.analytics.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
