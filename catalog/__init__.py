"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``q_*`` module so that its queries are registered."""
    for info in pkgutil.iter_modules(__path__):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
