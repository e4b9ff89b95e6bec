"""Loads every module that registers queries."""

from importlib import import_module

MODULES = ("passage_queries", "document_queries", "graph_queries", "log_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"beleg.checks.{name}")
