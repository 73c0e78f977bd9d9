"""All queries of the core, by name, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from litspark.plans import base, catalog, context, pages, retrieval, scalars, stored  # noqa: F401  (each registers its queries)

QUERIES = base.QUERIES
ORACLE = base.ORACLE
