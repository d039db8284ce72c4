"""All queries that are no training-data operators, with their oracle SQL."""

from __future__ import annotations

from sitesignal.plans import queries_core, queries_panels, queries_sources

QUERIES = queries_core.QUERIES | queries_panels.QUERIES | queries_sources.QUERIES
ORACLES = queries_core.ORACLES | queries_panels.ORACLES | queries_sources.ORACLES
