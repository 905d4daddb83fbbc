"""Registry of runnable queries and their independent SQL texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.plans.sql_views import VIEWS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the shared views it uses, in dependency order."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                wanted.append(name)

    visit(body)
    if not wanted:
        return body
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    body = body.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {head},\n{re.sub(r'^with\s+recursive', '', body, flags=re.I)}"
    if re.match(r"with\b", body, re.I):
        return f"WITH {head},\n{re.sub(r'^with', '', body, flags=re.I)}"
    return f"WITH {head}\n{body}"


def _plain_zero(sql: str) -> str:
    """Add zero to every ``round(x, n)`` so that a negative zero compares equal."""
    out, at = [], 0
    for match in re.finditer(r"\bround\(", sql):
        depth, end, comma = 1, match.end(), False
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma |= sql[end] == "," and depth == 1
            end += 1
        if comma and match.start() >= at:
            out.append(sql[at:match.start()] + "(" + _plain_zero_inner(sql[match.start():end]) + " + 0.0::DOUBLE)")
            at = end
    return "".join(out) + sql[at:]


def _plain_zero_inner(call: str) -> str:
    return "round(" + _plain_zero(call[len("round("):-1]) + ")"


def rounded(value: Column, places: int = 6) -> Column:
    """Round for output, with no negative zero."""
    return F.round(value, places) + F.lit(0.0)


def query(name: str, ids: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)``; ``ids`` names the inventory rows it covers."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            ORACLE[name] = with_views(_plain_zero(sql))
        return fn

    return register
