"""Registered queries: every operator on the given tables, with its SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil

from tidymeter.catalog.base import REGISTRY, Entry


def load() -> dict[str, Entry]:
    """All registered queries in name order."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(sorted(REGISTRY.items()))
