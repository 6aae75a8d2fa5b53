"""Severity and alert rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.constants import ALERT_EVENT, ALERT_HIGH
from veilwork.functions.columns import literal
from veilwork.policy import AlertRoute


def with_severity(detections: DataFrame) -> DataFrame:
    """Add ``severity`` as alerts see it."""
    return detections.withColumn(
        "severity",
        F.when(F.col("entity_type").isin(*ALERT_HIGH), F.lit("high")).otherwise(F.lit("medium")),
    )


def alert_events(
    detections: DataFrame,
    routes: Sequence[AlertRoute],
    timestamp: Column | str,
    source: str = "source",
) -> DataFrame:
    """One row per severe detection and route that asks for it.

    Routes are part of the configuration, so they are a literal array that each
    severe detection is exploded with; nothing is joined.
    """
    urls = [route.url for route in routes if ALERT_EVENT in route.events]
    stamp = F.lit(timestamp) if isinstance(timestamp, str) else timestamp
    message = f"""concat('High-severity PII (', entity_type, ') detected in tool \\'', {source},
        '\\' with confidence ', format_string('%.2f', confidence))"""
    targets = f"cast({literal(urls)} as array<string>)"
    return (
        with_severity(detections)
        .where("severity = 'high'")
        .select("*", F.explode(F.expr(targets)).alias("url"))
        .withColumn("timestamp", stamp)
        .withColumn("event", F.lit("pii_detected"))
        .withColumn("message", F.expr(message))
        .withColumnRenamed(source, "tool_name")
    )
