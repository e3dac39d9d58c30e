"""The registered queries over the given tables, and the SQL that each must equal."""

from __future__ import annotations

from tessera.plans import catalog_code, catalog_evolution, catalog_findings, catalog_graph, catalog_linkage, catalog_retrieval, catalog_rules, catalog_store, catalog_text

PARTS = (catalog_graph, catalog_code, catalog_findings, catalog_evolution, catalog_linkage, catalog_text, catalog_retrieval, catalog_store, catalog_rules)
QUERIES = {name: f for p in PARTS for name, f in p.QUERIES.items()}
ORACLES = {name: sql for p in PARTS for name, sql in p.ORACLES.items()}
