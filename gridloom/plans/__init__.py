"""Registered queries, grouped by theme. Importing a theme module fills the registry."""

from __future__ import annotations

import importlib

from gridloom.plans.registry import REGISTRY

THEMES = (
    "scalar",
    "load",
    "lookup",
    "spreadsheet",
    "profile",
    "discovery",
    "sources",
    "insight",
    "graph",
    "narrative",
    "jobs",
    "streams",
)


def load_all() -> dict:
    for theme in THEMES:
        importlib.import_module(f"gridloom.plans.{theme}")
    return REGISTRY
