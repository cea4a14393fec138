"""All queries of the library's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ("scans", "predicates", "joins", "aggregates", "windows", "arrays", "texts", "statistics", "samples")
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same result."""

    def add(f: Callable) -> Callable:
        if f.__name__ in _FOUND:
            raise ValueError(f"two queries named {f.__name__}")
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _all() -> dict[str, tuple[Callable, str | None]]:
    for m in _MODULES:
        import_module(f"lipika.plans.{m}")
    return _FOUND


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
