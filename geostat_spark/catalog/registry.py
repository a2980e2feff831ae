"""Named queries and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def settled(sql: str) -> str:
    """``round_even(x, n)`` with x first rounded to n + 5 digits: the rule of ``half_even``."""
    out, at = [], 0
    while True:
        start = sql.find("round_even(", at)
        if start < 0:
            return "".join(out) + sql[at:]
        begin = start + len("round_even(")
        depth, i, comma = 1, begin, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out.append(f"{sql[at:start]}round_even(round({settled(sql[begin:comma])}, {digits + 5}), {digits})")
        at = i


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the equivalent statement, if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = settled(sql)
        return fn

    return register
