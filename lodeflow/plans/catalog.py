"""All registered queries of the core."""

from __future__ import annotations

from lodeflow.plans import corpus, evaluation, files, registry, streams  # noqa: F401  importing a module registers its queries

queries = registry.queries
oracle_sql = registry.oracle_sql
