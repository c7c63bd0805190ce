"""Queries of the library and the SQL that restates them, by name."""

from __future__ import annotations

from spanloom.jobs import documents, evidence, governance, impact, planning, protocols, rules, states, streams, structures, tracing, traffic, workspace

MODULES = (traffic, tracing, governance, documents, rules, evidence, impact, workspace, planning, protocols, structures, states, streams)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
