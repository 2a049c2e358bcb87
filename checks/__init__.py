"""Queries over the given tables, one or more per operator, with SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["transactions", "evaluation", "documents", "rules", "similarity", "registry", "flows"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
