"""Counters and latencies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from veilwork.constants import LATENCY_WINDOW, PERCENTILES
from veilwork.functions.columns import name
from veilwork.operators.lookup import with_positions


# Values per block when a place in a sorted table is looked for.
BLOCK_ROWS = 65_536


def metric_counters(summaries: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row of totals.

    ``messages`` is a masked message table; without it nothing passed through.
    """
    counted = summaries.agg(
        F.coalesce(F.sum("total_entities"), F.lit(0)).alias("entities_detected_total"),
        F.coalesce(F.sum("total_entities"), F.lit(0)).alias("entities_redacted_total"),
        F.count(F.lit(1)).alias("messages_scanned_total"),
        F.lit(0).cast("bigint").alias("errors_total"),
    )
    if messages is None:
        return counted.withColumn("messages_passthrough_total", F.lit(0).cast("bigint"))
    passed = messages.agg(F.count_if(~F.col("modified")).alias("messages_passthrough_total"))
    one = F.lit(1).alias("one")
    return counted.select("*", one).join(passed.select("*", one), "one").drop("one")


def latest(df: DataFrame, order_by: Sequence[Column], n: int = LATENCY_WINDOW) -> DataFrame:
    """The ``n`` newest rows: a top-k that never sorts the whole table.

    ``order_by`` says newest first.
    """
    return df.orderBy(*order_by).limit(n)


def _ranks(total: int, percentiles: Sequence[int]) -> dict[int, int]:
    return {p: min(int(total * p / 100), total - 1) for p in percentiles}


def window_percentiles(
    latencies: DataFrame, column: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """Percentiles of a window of at most ``LATENCY_WINDOW`` rows, as one row.

    The value at place floor(n * p / 100) of the sorted window, 0 when empty.
    """
    ordered = latencies.select(
        F.row_number().over(Window.orderBy(column)).alias("rank"),
        F.col(column).alias("value"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("total"),
    )
    at = "least(cast(floor(total * {p} / 100) as bigint), total - 1) + 1"
    return ordered.agg(
        *[
            F.expr(
                f"round(coalesce(max(if(rank = {at.format(p=p)}, value, null)), 0D), 3)"
            ).alias(f"p{p}")
            for p in percentiles
        ]
    )


def latency_percentiles(
    latencies: DataFrame, column: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """The same percentiles over a table of any size, exact, as one row.

    Values are counted first (map-side), so the sort sees each distinct value
    once; running counts per sorted range then locate the places.
    """
    counted = latencies.where(F.col(column).isNotNull()).groupBy(
        F.col(column).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    placed = with_positions(counted, ["value"])
    sizes = placed.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).first()
    total = int(sizes["rows"] or 0)
    ranks = _ranks(max(total, 1), percentiles)
    # Neighbouring values share a block; only the blocks that hold a wanted place (one per
    # percentile) are looked into.  With as many blocks as a block has values, neither the
    # list of blocks nor a block grows faster than the root of their number.
    block_rows = max(BLOCK_ROWS, math.isqrt(sizes["values"]))
    blocked = placed.withColumn("block", F.floor(F.col("position") / block_rows))
    sums = blocked.groupBy("block").agg(F.sum("n").alias("rows"))
    wanted = " or ".join(
        f"(before <= {at} and {at} < before + rows)" for at in ranks.values()
    )
    target = with_running_total(sums, "block", "rows").where(wanted)
    inside = Window.partitionBy("block").orderBy("value")
    ends = (
        blocked.join(F.broadcast(target), "block")
        .withColumn("end", F.col("before") + F.sum("n").over(inside))
        .withColumn("begin", F.col("end") - F.col("n"))
    )
    return ends.agg(
        *[
            F.expr(
                f"round(coalesce(max(if(begin <= {at} and {at} < end, value, null)), 0D), 3)"
            ).alias(f"p{p}")
            for p, at in ranks.items()
        ]
    )


def with_running_total(blocks: DataFrame, order: str, rows: str) -> DataFrame:
    """Add ``before``, the rows in all earlier blocks, to one row per block."""
    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("before", F.coalesce(F.sum(rows).over(window), F.lit(0)))


def approximate_percentiles(
    latencies: DataFrame, column: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """A sketch of the same, in one aggregation."""
    return latencies.agg(
        *[
            F.expr(f"round(coalesce(approx_percentile({column}, {p / 100}), 0D), 3)").alias(
                f"p{p}"
            )
            for p in percentiles
        ]
    )


# Size of a sketch.  The rank of what it gives for a percentile is off by RANK_ERROR of all rows at
# most, in 99 of 100 cases: 2.296 / SKETCH_SIZE ** 0.9723, the published bound, rounded up.
SKETCH_SIZE = 1000
RANK_ERROR = 0.003


def latency_sketches(latencies: DataFrame, column: str, *by: str) -> DataFrame:
    """One mergeable quantile sketch of the latencies per group, and how many it holds.

    Sketches of different rows, of a day or of a source, are put together by ``sketch_percentiles``.
    """
    return (
        latencies.where(F.col(column).isNotNull())
        .groupBy(*by)
        .agg(
            F.expr(f"kll_sketch_agg_double(cast({name(column)} as double), {SKETCH_SIZE})").alias("sketch"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def sketch_percentiles(
    sketches: DataFrame, *by: str, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """Percentiles of all rows that went into the sketches, 0 where there are none.

    Sketches are merged map-side; a row is read again for none of it.
    """
    merged = sketches.groupBy(*by).agg(
        F.expr(f"kll_merge_agg_double(sketch, {SKETCH_SIZE})").alias("_merged"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    return merged.select(
        *by,
        "n",
        *[
            F.expr(f"if(n > 0, round(kll_sketch_get_quantile_double(_merged, {p / 100}D), 3), 0D)").alias(f"p{p}")
            for p in percentiles
        ],
    )
