"""All registered queries of the library."""

from __future__ import annotations

from . import entities, extraction, files, scalars, selection, views_time  # noqa: F401
from .views import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
