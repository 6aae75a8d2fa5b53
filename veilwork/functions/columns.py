"""Small helpers for writing row-local expressions.

The heavy expressions of this package are nested array expressions.  They are
written as Spark SQL text and parsed once by ``F.expr``: building the same tree
out of single Column calls costs thousands of round trips to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, Mapping):
        return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, Iterable):
        return "array(" + ", ".join(literal(v) for v in value) + ")"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def name(column: str) -> str:
    """A column name, safe inside SQL text."""
    return "`" + column.replace("`", "``") + "`"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, computed once per row.

    A lambda body is evaluated for every element, so anything heavy it captures
    has to be bound outside of it.  A one-element ``transform`` is that binding.
    """
    return f"transform(array({value}), {variable} -> {body})[0]"


def compute_once(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Add columns that later filters cannot pull apart.

    Catalyst pushes a filter on a projected column below the projection, which
    evaluates the column once for the filter and again for the output.  A filter
    on a generated column stays above the generator, so a one-element explode
    makes the scan of a text happen exactly once, without caching anything.
    """
    for alias, value in columns.items():
        value = F.expr(value) if isinstance(value, str) else value
        df = df.select(
            *[F.col(name(c)) for c in df.columns if c != alias],
            F.explode(F.array(value)).alias(alias),
        )
    return df
