"""Registered queries, by theme."""

from importlib import import_module

THEMES = ("text_queries", "table_queries", "profile_queries", "model_queries")


def load():
    """Registry with every query in it."""
    for theme in THEMES:
        import_module(f"featureforge.catalog.{theme}")
    return import_module("featureforge.catalog.registry")
