"""Registered queries: name -> Spark plan over the driver tables, with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .inputs import Inputs, SQL_VIEWS

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("metrics", "tickets", "text", "knowledge", "evaluation", "corpus", "models", "streams")


def query(name: str, oracle: str | None = None):
    """Register a plan under `name`; `oracle` is DuckDB SQL that may use the input views."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = with_views(oracle)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix a statement with the input views it reads, in dependency order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in needed and re.search(rf"\b{view}\b", text):
                need(SQL_VIEWS[view])
                if view not in needed:
                    needed.append(view)

    need(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _load() -> None:
    for module in _MODULES:
        import_module(f"{__package__}.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def _bind(fn):
    return lambda spark, sf_dir: fn(Inputs(configure(spark), sf_dir))


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
