"""Registered queries, grouped by theme."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every theme so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
