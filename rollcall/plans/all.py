"""Every analytic query by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from rollcall.plans import measures, networks, relational, texts
from rollcall.plans.registry import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (relational, measures, texts, networks):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
