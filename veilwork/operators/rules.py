"""Entity and source rules that arrive as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.constants import (
    ALL_TYPES,
    DEFAULT_SOURCE,
    DEFAULT_STRATEGY,
    DEFAULT_THRESHOLD,
    SKIP_ACTION,
)

# A rule table up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table after counting it (at most ``limit`` + 1 rows are read)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def resolve_rules(
    rules: DataFrame,
    default_strategy: str = DEFAULT_STRATEGY,
    default_threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Effective rules: upper-cased names, inherited defaults.

    The result has one row per known type at most, so it can always be broadcast.
    Where two names differ only in case the last in name order holds.
    """
    kind = F.upper("entity_type")
    named = rules.select(
        kind.alias("entity_type"),
        F.struct(
            F.col("entity_type").alias("name"),
            F.coalesce("enabled", F.lit(True)).alias("enabled"),
            F.coalesce("masking_strategy", F.lit(default_strategy)).alias("masking_strategy"),
            F.coalesce("confidence_threshold", F.lit(float(default_threshold))).alias(
                "confidence_threshold"
            ),
        ).alias("rule"),
    ).where(kind.isin(*ALL_TYPES))
    return (
        named.groupBy("entity_type")
        .agg(F.max("rule").alias("rule"))
        .select(
            "entity_type", "rule.enabled", "rule.masking_strategy", "rule.confidence_threshold"
        )
    )


def filter_disabled(detections: DataFrame, resolved: DataFrame) -> DataFrame:
    """Drop detections of the types a resolved rule switches off."""
    switches = resolved.select("entity_type", F.col("enabled").alias("_on"))
    return (
        detections.join(F.broadcast(switches), "entity_type", "left")
        .where(F.coalesce("_on", F.lit(True)))
        .select(*detections.columns)
    )


def filter_by_threshold(
    detections: DataFrame, resolved: DataFrame, default_threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Keep detections at or above their type's threshold."""
    limits = resolved.select("entity_type", F.col("confidence_threshold").alias("_limit"))
    return (
        detections.join(F.broadcast(limits), "entity_type", "left")
        .where(F.col("confidence") >= F.coalesce("_limit", F.lit(float(default_threshold))))
        .select(*detections.columns)
    )


def apply_entity_rules(
    detections: DataFrame, resolved: DataFrame, default_threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Switches and thresholds in one pass over the detections."""
    rules = resolved.select(
        "entity_type", F.col("enabled").alias("_on"), F.col("confidence_threshold").alias("_limit")
    )
    return (
        detections.join(F.broadcast(rules), "entity_type", "left")
        .where(
            F.coalesce("_on", F.lit(True))
            & (F.col("confidence") >= F.coalesce("_limit", F.lit(float(default_threshold))))
        )
        .select(*detections.columns)
    )


def apply_source_rules(df: DataFrame, rules: DataFrame, source: str = "source") -> DataFrame:
    """Add ``scanned``: false for the sources whose action is ``skip``.

    Unknown sources and all other actions are scanned.  Only the skipped names
    take part in the join; they are broadcast when they are few.
    """
    skipped = (
        rules.where(F.col("action") == SKIP_ACTION)
        .select(F.col("source").alias(source))
        .distinct()
        .withColumn("_skip", F.lit(True))
    )
    named = df.withColumn(source, F.coalesce(source, F.lit(DEFAULT_SOURCE)))
    return (
        named.join(broadcast_if_small(skipped), source, "left")
        .withColumn("scanned", F.col("_skip").isNull())
        .select(*df.columns, "scanned")
    )
