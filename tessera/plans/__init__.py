"""Registered queries."""

from tessera.plans import entity_queries, queries, upkeep_queries, whole_queries, worklist_queries  # noqa: F401
