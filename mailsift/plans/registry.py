"""Where queries and their SQL statements are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailsift.plans.roles import ROLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def statement(body: str, *roles: str) -> str:
    """SQL text with the roles it reads as leading CTEs (a role pulls in the roles it is made of)."""
    ordered: list[str] = []

    def need(role: str) -> None:
        parents, _ = ROLE_SQL[role]
        for parent in parents:
            need(parent)
        if role not in ordered:
            ordered.append(role)

    for role in roles:
        need(role)
    ctes = ", ".join(f"{role} AS ({ROLE_SQL[role][1]})" for role in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None, roles: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = statement(sql, *roles)
        return build

    return register
