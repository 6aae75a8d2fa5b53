"""Audit events of a masked table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.columns import name

SUMMARY_EVENT = "scan_summary"
AUDIT_SCHEMA = (
    "timestamp string, event_type string, tool_name string, entity_type string,"
    " original_length int, masked_text string, confidence double, engine string,"
    " masking_strategy string, dry_run boolean, metadata map<string,string>,"
    " total_entities int, entity_counts map<string,int>, processing_time_ms double"
)

_PRESENT = """map_from_entries(transform(
    array_distinct(transform(detections, d -> d.entity_type)), t -> struct(t, 1)))"""


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def audit_redactions(
    masked: DataFrame,
    timestamp: Column | str,
    dry_run: bool = False,
    source: str = "source",
    key: tuple[str, ...] = (),
) -> DataFrame:
    """One event per replaced detection; the original text is not in it.

    ``timestamp`` is a run parameter (or a column), so a run can be repeated.
    Columns in ``key`` are put in front; events of a text run right to left.
    """
    events = masked.select(
        *map(name, key),
        _column(timestamp).alias("timestamp"),
        F.col(name(source)).alias("tool_name"),
        F.expr("inline(reverse(redactions))"),
    )
    return events.select(
        *map(name, key),
        "timestamp",
        "tool_name",
        "entity_type",
        F.length("text").alias("original_length"),
        F.col("masked").alias("masked_text"),
        "confidence",
        "engine",
        F.col("strategy").alias("masking_strategy"),
        F.lit(dry_run).alias("dry_run"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )


def scan_summaries(
    scanned: DataFrame,
    timestamp: Column | str,
    processing_time_ms: Column | None = None,
    dry_run: bool = False,
    source: str = "source",
    key: tuple[str, ...] = (),
) -> DataFrame:
    """One event per scanned text.  ``entity_counts`` holds 1 for each type present."""
    milliseconds = F.lit(0.0) if processing_time_ms is None else processing_time_ms
    return scanned.where("scanned").select(
        *map(name, key),
        _column(timestamp).alias("timestamp"),
        F.lit(SUMMARY_EVENT).alias("event_type"),
        F.col(name(source)).alias("tool_name"),
        F.size("detections").alias("total_entities"),
        F.expr(_PRESENT).alias("entity_counts"),
        F.round(milliseconds, 3).alias("processing_time_ms"),
        F.lit(dry_run).alias("dry_run"),
    )


def audit_events(
    masked: DataFrame,
    timestamp: Column | str,
    processing_time_ms: Column | None = None,
    dry_run: bool = False,
    source: str = "source",
    key: tuple[str, ...] = (),
) -> DataFrame:
    """The whole log of a masked table, both kinds of events, from one pass.

    Each text gives its redactions, right to left, and then its summary.
    """
    milliseconds = F.lit(0.0) if processing_time_ms is None else processing_time_ms
    flag, origin = str(dry_run).lower(), name(source)
    event_type = f"array<struct<{AUDIT_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    redactions = f"""transform(reverse(redactions), r -> named_struct(
        'timestamp', _stamp, 'event_type', null, 'tool_name', {origin},
        'entity_type', r.entity_type, 'original_length', length(r.text),
        'masked_text', r.masked, 'confidence', r.confidence, 'engine', r.engine,
        'masking_strategy', r.strategy, 'dry_run', {flag},
        'metadata', cast(map() as map<string,string>),
        'total_entities', null, 'entity_counts', null, 'processing_time_ms', null))"""
    summary = f"""array(named_struct('timestamp', _stamp, 'event_type', '{SUMMARY_EVENT}',
        'tool_name', {origin}, 'entity_type', null, 'original_length', null,
        'masked_text', null, 'confidence', null, 'engine', null, 'masking_strategy', null,
        'dry_run', {flag}, 'metadata', null, 'total_entities', size(detections),
        'entity_counts', {_PRESENT}, 'processing_time_ms', round(_ms, 3)))"""
    events = f"""inline(if(scanned, concat(cast({redactions} as {event_type}),
        cast({summary} as {event_type})), cast(array() as {event_type})))"""
    # what a name in the text table could hide is only read from here on
    stamped = masked.select(
        *map(name, key),
        origin,
        "scanned",
        "detections",
        "redactions",
        _column(timestamp).alias("_stamp"),
        milliseconds.alias("_ms"),
    )
    return stamped.select(*map(name, key), F.expr(events))


def audit_log(redactions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Both kinds of events as one table; fields a kind lacks are null."""
    return redactions.unionByName(summaries, allowMissingColumns=True)


def audit_event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("event_count"))
