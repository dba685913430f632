"""One output contract for a query and its oracle: names, kinds and rounding."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidebook.plans.oracle_views import CTES, even


def parse(spec: str) -> list[tuple[str, str]]:
    """``name``, ``name:i`` (integer) or ``name:<digits>`` (rounded number)."""
    return [tuple((item + ":").split(":")[:2]) for item in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Selects the contract's columns. Adding zero turns a negative zero into zero."""

    def column(name: str, kind: str) -> str:
        if kind == "i":
            return f"bigint(`{name}`) AS `{name}`"
        if kind:
            return f"rint(double(`{name}`) * 1e{kind}D) / 1e{kind}D + 0D AS `{name}`"
        return f"`{name}`"

    return df.selectExpr(*[column(n, k) for n, k in parse(spec)])


def oracle_query(body: str, spec: str) -> str:
    """The oracle text: the needed common table expressions, then ``body`` under the contract."""

    def column(name: str, kind: str) -> str:
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind:
            return f"CAST({even(name, int(kind))} + 0.0 AS DOUBLE) AS {name}"
        return name

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    select = f"SELECT {', '.join(column(n, k) for n, k in parse(spec))} FROM ({body})"
    return f"WITH {head}\n{select}" if head else select
