"""All named queries by topic."""

from __future__ import annotations

from importlib import import_module

from matchloom.plans import registry

TOPICS = ["text", "tenure", "matching", "explain", "extract", "intake"]


def load():
    for topic in TOPICS:
        import_module(f"matchloom.plans.catalog.{topic}")
    return registry.QUERIES, registry.ORACLES
