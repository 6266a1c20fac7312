"""Registered queries and their SQL twins."""

from __future__ import annotations

from graphloom.queries import code, graph, problems, services, storing, texts

MODULES = (problems, graph, texts, services, code, storing)


def queries() -> dict:
    """Name to callable(spark, directory) of every core query."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    """Name to SQL of the core queries that SQL can express."""
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
