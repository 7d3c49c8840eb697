"""Catalogue plumbing: registering queries and putting SQL views in front of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Check] = {}
SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    """A named SQL view that queries can refer to; later views may use earlier ones."""
    SQL_VIEWS[name] = body


def _with_views(sql: str) -> str:
    """Put a WITH clause in front that defines the views ``sql`` mentions, and theirs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    parts = [f"{name} AS ({body.strip()})" for name, body in SQL_VIEWS.items() if name in needed]
    sql = sql.strip()
    if not parts:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[15:]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def check(name: str, sql: str | None = None):
    """Register a query under ``name``; without SQL only its rows are looked at."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        CATALOG[name] = Check(run, _with_views(sql) if sql else None)
        return run

    return add
