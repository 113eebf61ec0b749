"""Texts and codes derived from the tables' keys, written the same way for Spark and for the SQL beside a query."""

from __future__ import annotations

import re


def _literal(x, spark: bool) -> str:
    if not isinstance(x, str):
        return "NULL" if x is None else str(x)
    return "'" + (x.replace("\\", "\\\\").replace("'", "\\'") if spark else x.replace("'", "''")) + "'"


def choice(key: str, options: list) -> tuple[str, str]:
    """One of ``options`` by turns of an integer column, as Spark SQL and as the twin's SQL."""
    spark, other = (", ".join(_literal(x, s) for x in options) for s in (True, False))
    return f"element_at(array({spark}), cast(({key}) % {len(options)} as int) + 1)", f"([{other}])[({key}) % {len(options)} + 1]"


def doubles(expression: str) -> str:
    """The expression for Spark, its decimal numbers as doubles and its whole divisions by their name."""
    return re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w.])", r"\1D", expression).replace(" // ", " div ")
