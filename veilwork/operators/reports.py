"""Compliance figures and the event feed, from audit events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.constants import FEED_HIGH, RECENT_EVENTS
from veilwork.operators.audit import SUMMARY_EVENT

IS_SUMMARY = f"coalesce(event_type = '{SUMMARY_EVENT}', false)"
IS_REDACTION = "(entity_type is not null and masking_strategy is not null)"


def _totals() -> list[Column]:
    return [
        F.expr(f"count_if({IS_SUMMARY})").alias("total_scans"),
        F.expr(f"count_if({IS_REDACTION})").alias("total_entities_redacted"),
        F.expr(
            f"round(coalesce(avg(if({IS_REDACTION}, coalesce(confidence, 0D), null)), 0D), 3)"
        ).alias("average_confidence"),
        F.expr(f"count_if({IS_REDACTION} and coalesce(dry_run, false))").alias("dry_run_events"),
    ]


def _period() -> list[Column]:
    stamp = "nullif(timestamp, '')"
    return [
        F.expr(f"coalesce(min({stamp}), 'N/A')").alias("period_start"),
        F.expr(f"coalesce(max({stamp}), 'N/A')").alias("period_end"),
    ]


def _status() -> Column:
    return F.expr(f"if(count_if({IS_REDACTION}) > 0, 'COMPLIANT', 'NO_DATA')").alias(
        "compliance_status"
    )


def compliance_totals(audit: DataFrame) -> DataFrame:
    """Scans, redactions, mean confidence, dry-run events: one row."""
    return audit.agg(*_totals())


def compliance_period(audit: DataFrame) -> DataFrame:
    return audit.agg(*_period())


def compliance_status(audit: DataFrame) -> DataFrame:
    return audit.agg(_status())


_MISSING = {
    "entity_type": "UNKNOWN",
    "masking_strategy": "unknown",
    "tool_name": "unknown",
}


def distribution(audit: DataFrame, column: str) -> DataFrame:
    """Redactions per value of ``column``, most frequent first, ties by name."""
    value = F.coalesce(F.col(column), F.lit(_MISSING.get(column, "unknown")))
    return (
        audit.where(IS_REDACTION)
        .groupBy(value.alias(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
    )


_DISTRIBUTIONS = {
    "entity_type_distribution": "entity_type",
    "masking_strategy_distribution": "masking_strategy",
    "tool_distribution": "tool_name",
}


def report_part(audit: DataFrame) -> DataFrame:
    """What a report needs of some audit events: a row per type, strategy and source.

    Parts of different events can be put together by a union: ``report_of_parts`` adds them up.
    """
    return audit.groupBy(
        *[F.coalesce(c, F.lit(_MISSING[c])).alias(c) for c in _DISTRIBUTIONS.values()]
    ).agg(
        F.expr(f"count_if({IS_SUMMARY})").alias("scans"),
        F.expr(f"count_if({IS_REDACTION})").alias("redactions"),
        F.expr(f"sum(if({IS_REDACTION}, coalesce(confidence, 0D), 0D))").alias("confidence"),
        F.expr(f"count_if({IS_REDACTION} and coalesce(dry_run, false))").alias("dry_runs"),
        F.expr("min(nullif(timestamp, ''))").alias("first"),
        F.expr("max(nullif(timestamp, ''))").alias("last"),
    )


def compliance_report(audit: DataFrame, generated: Column | str | None = None) -> DataFrame:
    """All figures as one row with ``report`` as JSON.

    One pass over the audit table counts every combination of type, strategy and
    source map-side; grouping sets over that small table give the distributions
    and the totals, which one last aggregation puts side by side.
    """
    return report_of_parts(report_part(audit), generated)


def report_of_parts(small: DataFrame, generated: Column | str | None = None) -> DataFrame:
    """The report of all events that the parts were made of."""
    parts = _DISTRIBUTIONS
    grouped = small.groupingSets(
        [[F.col(c)] for c in parts.values()] + [[]], *[F.col(c) for c in parts.values()]
    ).agg(
        F.grouping_id().alias("set"),
        *[F.sum(c).alias(c) for c in ("scans", "redactions", "confidence", "dry_runs")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    # bits of the grouping id, first column highest: set when summed over it
    everything, sets = 0b111, dict(zip(parts, (0b011, 0b101, 0b110), strict=True))

    def total(column: str) -> str:
        return f"coalesce(max(if(set = {everything}, {column}, null)), 0)"

    def nested(alias: str) -> Column:
        pairs = f"""collect_list(if(set = {sets[alias]} and redactions > 0,
            struct(redactions as n, {parts[alias]} as k), null))"""
        ordered = f"""array_sort({pairs}, (a, b) -> case
            when a.n > b.n then -1 when a.n < b.n then 1
            when a.k < b.k then -1 when a.k > b.k then 1 else 0 end)"""
        return F.expr(f"map_from_entries(transform({ordered}, x -> struct(x.k, x.n)))").alias(alias)

    mean = f"if({total('redactions')} > 0, {total('confidence')} / {total('redactions')}, 0D)"
    totals = grouped.agg(
        F.expr(f"coalesce(max(if(set = {everything}, first, null)), 'N/A')").alias("period_start"),
        F.expr(f"coalesce(max(if(set = {everything}, last, null)), 'N/A')").alias("period_end"),
        F.expr(total("scans")).alias("total_scans"),
        F.expr(total("redactions")).alias("total_entities_redacted"),
        F.expr(f"round({mean}, 3)").alias("average_confidence"),
        F.expr(total("dry_runs")).alias("dry_run_events"),
        *[nested(alias) for alias in parts],
    )
    fields = [
        "period_start",
        "period_end",
        "total_scans",
        "total_entities_redacted",
        "average_confidence",
        *parts,
        "dry_run_events",
        "compliance_status",
    ]
    status = F.expr("if(total_entities_redacted > 0, 'COMPLIANT', 'NO_DATA')")
    if generated is not None:
        stamp = F.lit(generated) if isinstance(generated, str) else generated
        totals = totals.withColumn("report_generated", stamp)
        fields = ["report_generated", *fields]
    return totals.withColumn("compliance_status", status).select(
        F.to_json(F.struct(*fields)).alias("report")
    )


def dashboard_totals(audit: DataFrame) -> DataFrame:
    """Scans, entities summed over the summaries, mean of the non-zero times."""
    return audit.where(IS_SUMMARY).agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.expr("coalesce(sum(coalesce(total_entities, 0)), 0)").alias("total_entities"),
        F.expr("coalesce(avg(nullif(processing_time_ms, 0D)), 0D)").alias("avg_latency_ms"),
    )


def feed_severity(events: DataFrame) -> DataFrame:
    """Add ``severity`` as the event feed sees it."""
    return events.withColumn(
        "severity",
        F.when(F.col("entity_type").isin(*FEED_HIGH), F.lit("high")).otherwise(F.lit("medium")),
    )


def recent_events(
    audit: DataFrame, order_by: Sequence[Column], n: int = RECENT_EVENTS
) -> DataFrame:
    """The last ``n`` events about an entity, newest first: a top-k, not a sort.

    ``order_by`` is the log order, newest first, with ties resolved.
    """
    events = audit.where("entity_type is not null")
    return feed_severity(events.orderBy(*order_by).limit(n))


def scan_report(
    masked: DataFrame,
    text: str = "text",
    processing_time_ms: Column | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Add ``report``: original, masked text and entities of each text as JSON."""
    milliseconds = F.lit(0.0) if processing_time_ms is None else processing_time_ms
    entities = """transform(detections, d -> named_struct('type', d.entity_type,
        'text', d.text, 'start', d.start, 'end', d.end,
        'confidence', d.confidence, 'engine', d.engine))"""
    return masked.withColumn(
        "report",
        F.to_json(
            F.struct(
                F.col(text).alias("original"),
                F.col("masked_text").alias("masked"),
                F.lit(dry_run).alias("dry_run"),
                F.expr(entities).alias("entities"),
                F.round(milliseconds, 3).alias("processing_time_ms"),
            )
        ),
    )
