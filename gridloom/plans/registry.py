"""Named queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.fixtures import FIXTURE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(body: str) -> str:
    """Prepend the fixture views a statement uses (and what those use) as CTEs, in their order of definition."""
    used: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in FIXTURE_SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(sql)
    ctes = [f"{name} AS ({FIXTURE_SQL[name]})" for name in FIXTURE_SQL if name in used]
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return "WITH " + ", ".join(ctes) + ", " + re.sub(r"(?i)^with\s+", "", body)
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with its SQL where SQL can express it."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return add
