"""Named queries over the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def load_all() -> None:
    from cytoframe.catalog import intervals, models, ordered, reads, sites, sources  # noqa: F401
