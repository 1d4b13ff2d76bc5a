"""Small builders that write one condition as a Spark column and as DuckDB text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(value: Column, words) -> Column:
    """True if the value holds one of the words as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words])


def starts_any(value: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(value, F.lit(w)) for w in words])


def ends_any(value: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(value, F.lit(w)) for w in words])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(value: str, words) -> str:
    return "(" + " or ".join(f"contains({value}, {quoted(w)})" for w in words) + ")"


def sql_starts(value: str, words) -> str:
    return "(" + " or ".join(f"starts_with({value}, {quoted(w)})" for w in words) + ")"


def sql_ends(value: str, words) -> str:
    return "(" + " or ".join(f"ends_with({value}, {quoted(w)})" for w in words) + ")"


def sql_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def quantised(value: Column) -> Column:
    """Six decimals, halves up: the same in both engines."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def sql_quantised(value: str) -> str:
    return f"(floor(({value}) * 1e6 + 0.5) / 1e6)"
