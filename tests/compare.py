"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, sf: str, query, sql: str) -> str | None:
    """None when both agree, else what differs."""
    frame = query(spark, sf)
    result = connect(sf).execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(columns)}"
    ours = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    theirs = _rows(columns, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"{sum(ours.values())} and {sum(theirs.values())} rows; only Spark"
        f" {len(only_ours)}: {str(only_ours[:2])[:700]}; only SQL"
        f" {len(only_theirs)}: {str(only_theirs[:2])[:700]}"
    )
