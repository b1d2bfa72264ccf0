"""Registry of the library's own queries and their SQL counterparts."""

from __future__ import annotations

from textloom import queries_facts, queries_scan

FLAGSHIP = "static_entities"
QUERIES = queries_scan.QUERIES | queries_facts.QUERIES
ORACLES = queries_scan.ORACLES | queries_facts.ORACLES
