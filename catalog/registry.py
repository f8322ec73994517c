"""Query registry and the shared oracle CTEs."""

from __future__ import annotations

import functools
import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricegrid.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

FAMILIES = [
    "reshape", "cleaning", "windows", "joins", "aggregates", "sets",
    "inference", "causal", "forecasting", "quality", "pixels",
]


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any CTE by name, its definitions are prepended."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def expand_rounding(sql: str) -> str:
    """``rnd(x, d)`` -> ``round((x) + 1e-9, d)``: exact halves must not fall on either engine's side."""
    while (at := sql.find("rnd(")) >= 0:
        depth, comma, i = 0, -1, at + 4
        while not (sql[i] == ")" and depth == 0):
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 0:
                comma = i
            i += 1
        sql = f"{sql[:at]}round(({sql[at + 4:comma]}) + 1e-9,{sql[comma + 1:i]}){sql[i + 1:]}"
    return sql


def _mentions(body: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", body))
    return [n for n in CTES if n in words]


def with_ctes(sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _mentions(CTES[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in _mentions(sql):
        visit(name)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def oracle(name: str) -> str:
    return expand_rounding(with_ctes(ORACLES[name]))


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"catalog.{family}")
