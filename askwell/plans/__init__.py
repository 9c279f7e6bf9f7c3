"""Whole jobs, and the queries registered for checking."""

from importlib import import_module

MODULES = ("relational", "corpus_queries", "search_queries", "context_queries", "run_queries")


def all_queries() -> None:
    """Registers every query."""
    for name in MODULES:
        import_module(f"askwell.plans.{name}")
