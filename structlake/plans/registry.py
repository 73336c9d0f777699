"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder
from .fixtures import FIXTURES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, str] = dict(FIXTURES)


def scratch_path(t: Tables) -> str:
    """A fresh folder beside the shared checkpoint folder of the session."""
    return f"{checkpoint_folder(t.spark)}/scratch-{uuid.uuid4().hex}"


def view(name: str, sql: str) -> None:
    """Name a SQL text that oracles may refer to as a table."""
    _VIEWS[name] = sql.strip()


def _referenced(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return words & set(_VIEWS)


def with_views(sql: str) -> str:
    """Prefix a text with the views it needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in sorted(_referenced(_VIEWS[name]) - {name}):
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in sorted(_referenced(sql)):
        visit(name)
    if not ordered:
        return sql.strip()
    bodies = ",\n".join(f"{n} AS (\n{_VIEWS[n].strip()}\n)" for n in ordered)
    text = sql.strip()
    if re.match(r"WITH\b", text, re.IGNORECASE):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", text, flags=re.IGNORECASE)
        return f"WITH RECURSIVE {bodies},\n{rest}"
    return f"WITH RECURSIVE {bodies}\n{text}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the text another engine can check it with."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
