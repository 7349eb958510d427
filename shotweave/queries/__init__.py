"""Registered queries: name → (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable, str | None]]:
    import importlib

    for m in ("scalars", "layout", "joins", "aggregates", "edits", "detection", "keys", "crops", "audits", "documents", "projects", "stores", "readers"):
        importlib.import_module(f"shotweave.queries.{m}")
    return REGISTRY
