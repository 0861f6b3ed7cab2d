"""All queries of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from spanloom.plans import assembly, catalog, planning, render, scalars, timeline
from spanloom.plans.common import Plan

MODULES = (timeline, catalog, planning, scalars, render, assembly)
QUERIES: dict[str, Plan] = {name: plan for m in MODULES for name, plan in m.Q.plans.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.Q.sql.items()}
