"""Queries over the sales tables that exercise every operator."""

from importlib import import_module

MODULES = ("edges", "scenarios", "signed", "evidence", "resilience", "statistics", "lookups", "ingest", "reports")


def load_all() -> None:
    for name in MODULES:
        import_module(f"workloads.{name}")
