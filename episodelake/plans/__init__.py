"""The registered queries: thin plans over the operators, each with its DuckDB twin."""

from __future__ import annotations

import importlib
import pkgutil

from episodelake.registry import REGISTRY, Entry


def registered() -> dict[str, Entry]:
    """Every query of every plan module."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
