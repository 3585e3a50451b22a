"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.registry")
