"""Imports every query module once."""

import importlib

MODULES = ["page_queries", "markup_queries", "json_queries", "table_queries", "file_queries"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
