"""Registered queries and the SQL that states their answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Common tables of the SQL answers, each with the ones it builds on.
TABLES: dict[str, tuple[str, str]] = {}


def table(name: str, text: str, needs: str = "") -> None:
    TABLES[name] = (needs, text)


def with_tables(needs: str, body: str) -> str:
    """SQL text with the named common tables in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for before in TABLES[name][0].split():
            visit(before)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    heads = [f"{name} AS ({TABLES[name][1]})" for name in ordered]
    body = body.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(heads) + ",\n" + body[5:]
    return "WITH " + ",\n".join(heads) + "\n" + body


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(needs, sql)
        return fn

    return keep
