"""Joins and numbering that stay balanced whatever the keys look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilwork.functions.columns import name
from veilwork.session import materialized

# A key is hot when it has more than this share of all rows, so there are fewer
# than 1/share hot keys: that is the proof that they can be broadcast.
HOT_SHARE = 1 / 2000
_ROW_BITS = 33


def with_positions(
    df: DataFrame, order_by: Sequence[str | Column], position: str = "position"
) -> DataFrame:
    """Number all rows from 0 in the given (total) order.

    One range-partitioned sort.  Each row is stamped with its place in its own
    sorted partition and the result is written to shared storage, so that the
    stamps cannot change; the rows before each partition follow from a count per
    partition.  No task sees more than its own range.
    """
    row_mask = (1 << _ROW_BITS) - 1
    stamped = materialized(
        df.orderBy(*order_by).withColumn("_stamp", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_stamp", _ROW_BITS))
    # one row per sorted partition, so a single-partition window is small here
    before = (
        stamped.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("_part", "_before")
    )
    return (
        stamped.join(F.broadcast(before), "_part")
        .withColumn(
            position, F.col("_before") + F.col("_stamp").bitwiseAND(F.lit(row_mask))
        )
        .select(*[name(c) for c in df.columns], position)
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    counts: str | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Left join of many rows with a table that has one row per key.

    Rows with a hot key do not take part in the shuffled join at all: they meet a
    broadcast table of hot keys, fewer than ``1 / share``, whether or not ``right`` knows
    the key.  So a value that fills a third of all rows never meets in one task.
    ``counts`` names a column of ``right`` with the number of rows of ``left`` per key,
    if it covers them all; when it is missing they are counted here.  Both tables are
    read more than once.
    """
    keys = list(on)
    side = right.select(*[c for c in right.columns if c != counts])
    least = max(left.count() * share, 1)
    if counts is None:
        counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot_keys = counted.where(F.col("_n") > least).select(*keys)
    else:
        hot_keys = right.where(F.col(counts) > least).select(*keys)
    hot_keys = materialized(hot_keys)
    if hot_keys.isEmpty():
        return left.join(side, keys, "left").select(*map(name, [*left.columns, *side.drop(*keys).columns]))
    hot_side = side.join(F.broadcast(hot_keys), keys, "left_semi")
    hot = left.join(F.broadcast(hot_keys), keys, "left_semi").join(
        F.broadcast(hot_side), keys, "left"
    )
    cold = left.join(F.broadcast(hot_keys), keys, "left_anti").join(side, keys, "left")
    columns = [*left.columns, *side.drop(*keys).columns]
    return hot.select(*map(name, columns)).unionByName(cold.select(*map(name, columns)))
