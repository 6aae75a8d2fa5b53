"""Audit events, reports, metrics, alerts, messages and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    BLOCKS_SQL,
    MESSAGES_SQL,
    TEXTS_SQL,
    order_texts,
    documents,
    messages,
    spread_orders,
    table,
    text_parts,
    texts,
)
from catalog.masking import _KEEP, _MIXED, _NUMBERED, _RULES, _TOKEN, PSEUDO_SQL, keyring
from catalog.oracle_parts import REDACT, masked_texts, q, with_parts
from catalog.registry import ORACLES, query
from veilwork.constants import ALERT_HIGH, FEED_HIGH
from veilwork.operators.alerts import alert_events, with_severity
from veilwork.operators.audit import (
    audit_event_count,
    audit_events,
    audit_redactions,
    scan_summaries,
)
from veilwork.operators.detect import explode_detections
from veilwork.operators.dictionary import restore_text
from veilwork.operators.messages import (
    classify_messages,
    explode_blocks,
    mask_messages,
    message_stats,
    request_methods,
)
from veilwork.operators.metrics import (
    RANK_ERROR,
    latency_percentiles,
    latency_sketches,
    latest,
    metric_counters,
    sketch_percentiles,
    window_percentiles,
)
from veilwork.operators.reports import (
    compliance_period,
    compliance_report,
    compliance_status,
    compliance_totals,
    dashboard_totals,
    distribution,
    feed_severity,
    recent_events,
    report_of_parts,
    scan_report,
)
from veilwork.plans.scan import scan, scan_and_mask
from veilwork.policy import AlertRoute, Policy
from veilwork.session import materialized, new_folder, spread
from veilwork.sources.audit_log import parse_audit, read_audit, write_audit
from veilwork.sources.lines import read_messages, stream_messages
from veilwork.sources.texts import as_texts
from veilwork.streaming.stored import latest_table, read_stream_tokens
from veilwork.streaming.streams import (
    stream_audit,
    stream_entity_counts,
    stream_latency_window,
    stream_mask_messages,
    stream_mask_text,
    stream_masked_with_tables,
    stream_pseudonyms,
    stream_report_parts,
)

POLICY = Policy(entity_rules=_RULES, source_actions={"src3": "skip", "src4": "strict"})
SCANNED = "source <> 'src3'"
_STAMP = "concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS S), 2, '0'), 'T00:00:00+00:00')"
_MS = "CAST(doc_id % 1000 AS DOUBLE) / 8"
_STAMP_SPARK, _STAMP_SQL = (_STAMP.replace("AS S)", f"AS {t})") for t in ("STRING", "VARCHAR"))

# --- audit -----------------------------------------------------------------------

REDACTIONS_SQL = f"""SELECT d.doc_id, {_STAMP_SQL.replace("doc_id", "d.doc_id")} AS timestamp,
        t.source AS tool_name, d.entity_type, CAST(length(d.text) AS INTEGER) AS original_length,
        {_MIXED} AS masked_text, d.confidence, d.engine,
        CASE d.entity_type WHEN 'EMAIL' THEN 'partial' WHEN 'SSN' THEN 'hash'
            WHEN 'CREDIT_CARD' THEN 'partial' ELSE 'redact' END AS masking_strategy,
        false AS dry_run
    FROM final_pass d JOIN texts t USING (doc_id)"""
SUMMARIES_SQL = f"""SELECT t.doc_id, {_STAMP_SQL.replace("doc_id", "t.doc_id")} AS timestamp,
        'scan_summary' AS event_type, t.source AS tool_name,
        CAST(count(d.doc_id) AS INTEGER) AS total_entities,
        coalesce(string_agg(DISTINCT d.entity_type, ',' ORDER BY d.entity_type), '') AS types,
        {_MS.replace("doc_id", "t.doc_id")} AS processing_time_ms, false AS dry_run
    FROM scanned_texts t LEFT JOIN final_pass d USING (doc_id) GROUP BY t.doc_id, t.source"""


def _audit_sql(final: str) -> str:
    return with_parts(
        f", redactions AS MATERIALIZED ({REDACTIONS_SQL}),"
        f" summaries AS MATERIALIZED ({SUMMARIES_SQL}) {final}",
        keep=_KEEP,
        scanned=SCANNED,
    )


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    return scan_and_mask(texts(spark, sf), POLICY)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return audit_events(_masked(spark, sf), F.expr(_STAMP_SPARK), F.expr(_MS))


def _types() -> Column:
    return F.array_join(F.array_sort(F.map_keys("entity_counts")), ",").alias("types")


@query("audit_redactions", _audit_sql("SELECT * FROM redactions"))
def redactions(spark: SparkSession, sf: str) -> DataFrame:
    return audit_redactions(
        _masked(spark, sf), F.expr(_STAMP_SPARK), key=("doc_id",)
    ).drop("metadata")


@query("audit_scan_summaries", _audit_sql("SELECT * FROM summaries"))
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return scan_summaries(
        _masked(spark, sf), F.expr(_STAMP_SPARK), F.expr(_MS), key=("doc_id",)
    ).select(
        "doc_id", "timestamp", "event_type", "tool_name", "total_entities", _types(),
        "processing_time_ms", "dry_run",
    )


@query(
    "audit_event_count",
    _audit_sql(
        "SELECT (SELECT count(*) FROM redactions) + (SELECT count(*) FROM summaries)"
        " AS event_count"
    ),
)
def event_count(spark: SparkSession, sf: str) -> DataFrame:
    return audit_event_count(_log(spark, sf))


@query(
    "sink_audit_jsonl",
    _audit_sql(
        """SELECT timestamp, NULL AS event_type, tool_name, entity_type, original_length, masked_text,
            confidence, masking_strategy, NULL AS total_entities, NULL AS types FROM redactions
        UNION ALL SELECT timestamp, event_type, tool_name, NULL, NULL, NULL, NULL, NULL,
            total_entities, types FROM summaries"""
    ),
)
def audit_written(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "audit")
    write_audit(_log(spark, sf), path)
    return read_audit(spark, path).select(
        "timestamp", "event_type", "tool_name", "entity_type", "original_length", "masked_text",
        "confidence", "masking_strategy", "total_entities", _types(),
    )


# A log with blank and broken lines, from every row of events.
_EVENT_LINE = """CASE event_id % 5 WHEN 0 THEN '   '
    WHEN 1 THEN concat('{"timestamp": "t', CAST(event_id AS S))
    WHEN 2 THEN concat('  {"timestamp": "t', CAST(event_id AS S), '", "event_type": "scan_summary", "tool_name": "',
        event_type, '", "total_entities": ', CAST(user_id AS S), ', "entity_counts": {"EMAIL": 1}} ')
    WHEN 3 THEN concat('[', CAST(event_id AS S), ']')
    ELSE concat('{"timestamp": "t', CAST(event_id AS S), '", "tool_name": "', event_type,
        '", "entity_type": "EMAIL", "masking_strategy": "redact", "original_length": ',
        CAST(user_id AS S), ', "confidence": 0.', CAST(event_id % 9 + 1 AS S), ', "dry_run": true}') END"""


@query(
    "scan_audit_jsonl",
    """SELECT concat('t', CAST(event_id AS VARCHAR)) AS timestamp,
        CASE WHEN event_id % 5 = 2 THEN 'scan_summary' END AS event_type, event_type AS tool_name,
        CASE WHEN event_id % 5 = 4 THEN 'EMAIL' END AS entity_type,
        CASE WHEN event_id % 5 = 4 THEN CAST(user_id AS INTEGER) END AS original_length,
        CASE WHEN event_id % 5 = 4 THEN CAST(CAST('0.' || (event_id % 9 + 1) AS VARCHAR) AS DOUBLE) END AS confidence,
        CASE WHEN event_id % 5 = 2 THEN CAST(user_id AS INTEGER) END AS total_entities,
        CASE WHEN event_id % 5 = 4 THEN true END AS dry_run
    FROM events WHERE event_id % 5 IN (2, 4)""",
)
def audit_read(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "audit-lines")
    lines = table(spark, sf, "events").select(
        F.expr(_EVENT_LINE.replace("AS S)", "AS STRING)")).alias("value")
    )
    lines.write.text(path)
    return read_audit(spark, path).select(
        "timestamp", "event_type", "tool_name", "entity_type", "original_length", "confidence",
        "total_entities", "dry_run",
    )


# --- compliance ------------------------------------------------------------------

_AVERAGE = "round(coalesce((SELECT avg(confidence) FROM redactions), 0), 3)"
_BOUNDS = """SELECT coalesce(min(timestamp), 'N/A') AS period_start,
        coalesce(max(timestamp), 'N/A') AS period_end
    FROM (SELECT timestamp FROM redactions UNION ALL SELECT timestamp FROM summaries)"""


@query(
    "compliance_totals",
    _audit_sql(
        f"""SELECT (SELECT count(*) FROM summaries) AS total_scans,
            (SELECT count(*) FROM redactions) AS total_entities_redacted,
            {_AVERAGE} AS average_confidence, CAST(0 AS BIGINT) AS dry_run_events"""
    ),
)
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return compliance_totals(_log(spark, sf))


def _register_distribution(key: str, column: str) -> None:
    @query(key, _audit_sql(f"SELECT {column}, count(*) AS n FROM redactions GROUP BY 1"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return distribution(_log(spark, sf), column)


for _key, _column in (
    ("compliance_by_entity_type", "entity_type"),
    ("compliance_by_strategy", "masking_strategy"),
    ("compliance_by_source", "tool_name"),
):
    _register_distribution(_key, _column)


@query("compliance_period", _audit_sql(_BOUNDS))
def period(spark: SparkSession, sf: str) -> DataFrame:
    return compliance_period(_log(spark, sf))


@query(
    "compliance_status",
    _audit_sql(
        "SELECT CASE WHEN count(*) > 0 THEN 'COMPLIANT' ELSE 'NO_DATA' END"
        " AS compliance_status FROM redactions"
    ),
)
def status(spark: SparkSession, sf: str) -> DataFrame:
    return compliance_status(_log(spark, sf))


def _map_json(column: str) -> str:
    return f"""(SELECT '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY n DESC, k) || '}}'
        FROM (SELECT {column} AS k, count(*) AS n FROM redactions GROUP BY 1))"""


@query(
    "compliance_report_json",
    _audit_sql(
        f"""SELECT '{{"report_generated":"2024-02-01T00:00:00+00:00","period_start":"' || period_start
            || '","period_end":"' || period_end
            || '","total_scans":' || (SELECT count(*) FROM summaries)
            || ',"total_entities_redacted":' || (SELECT count(*) FROM redactions)
            || ',"average_confidence":' || {_AVERAGE}
            || ',"entity_type_distribution":' || {_map_json("entity_type")}
            || ',"masking_strategy_distribution":' || {_map_json("masking_strategy")}
            || ',"tool_distribution":' || {_map_json("tool_name")}
            || ',"dry_run_events":0,"compliance_status":"COMPLIANT"}}' AS report
        FROM ({_BOUNDS})"""
    ),
)
def report(spark: SparkSession, sf: str) -> DataFrame:
    return compliance_report(_log(spark, sf), "2024-02-01T00:00:00+00:00")


# --- dashboard, metrics, alerts --------------------------------------------------


@query(
    "dashboard_totals",
    _audit_sql(
        """SELECT count(*) AS total_scans, CAST(sum(total_entities) AS BIGINT) AS total_entities,
            avg(nullif(processing_time_ms, 0)) AS avg_latency_ms FROM summaries"""
    ),
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard_totals(_log(spark, sf))


def _in(column: str, kinds: tuple[str, ...]) -> str:
    listed = ", ".join(q(k) for k in kinds)
    return f"CASE WHEN {column} IN ({listed}) THEN 'high' ELSE 'medium' END AS severity"


@query(
    "dashboard_severity",
    _audit_sql(f"SELECT doc_id, entity_type, {_in('entity_type', FEED_HIGH)} FROM redactions"),
)
def dashboard_severity(spark: SparkSession, sf: str) -> DataFrame:
    events = audit_redactions(_masked(spark, sf), F.expr(_STAMP_SPARK), key=("doc_id",))
    return feed_severity(events).select("doc_id", "entity_type", "severity")


_RECENT = ["timestamp", "doc_id", "original_length", "entity_type", "masked_text"]


@query(
    "dashboard_recent",
    _audit_sql(
        f"""SELECT doc_id, timestamp, entity_type, original_length, masked_text,
            {_in("entity_type", FEED_HIGH)} FROM redactions
        ORDER BY {", ".join(f"{c} DESC" for c in _RECENT)} LIMIT 100"""
    ),
)
def dashboard_recent(spark: SparkSession, sf: str) -> DataFrame:
    events = audit_redactions(_masked(spark, sf), F.expr(_STAMP_SPARK), key=("doc_id",))
    return recent_events(events, [F.desc(c) for c in _RECENT]).select(
        "doc_id", "timestamp", "entity_type", "original_length", "masked_text", "severity"
    )


@query(
    "scan_result",
    with_parts(
        f"""SELECT doc_id, '{{"original":' || to_json(text)
            || ',"masked":' || to_json(masked_text) || ',"dry_run":false,"entities":['
            || coalesce(entities, '') || '],"processing_time_ms":'
            || CAST({_MS} AS VARCHAR) || '}}' AS report
        FROM (SELECT t.doc_id, t.text, m.masked_text, e.entities
            FROM texts t JOIN ({masked_texts(REDACT)}) m USING (doc_id)
            LEFT JOIN (SELECT doc_id, string_agg('{{"type":"' || entity_type || '","text":'
                    || to_json(text) || ',"start":' || start || ',"end":' || "end"
                    || ',"confidence":' || confidence || ',"engine":"' || engine || '"}}', ','
                    ORDER BY start) AS entities
                FROM final_pass GROUP BY doc_id) e USING (doc_id))"""
    ),
)
def scan_result(spark: SparkSession, sf: str) -> DataFrame:
    return scan_report(
        scan_and_mask(texts(spark, sf)), processing_time_ms=F.expr(_MS)
    ).select("doc_id", "report")


@query(
    "severity",
    with_parts(
        f"SELECT doc_id, entity_type, start, {_in('entity_type', ALERT_HIGH)} FROM final_pass"
    ),
)
def severity(spark: SparkSession, sf: str) -> DataFrame:
    found = explode_detections(scan(texts(spark, sf)))
    return with_severity(found).select("doc_id", "entity_type", "start", "severity")


_ALERT_LIST = ", ".join(q(k) for k in ALERT_HIGH)


@query(
    "alert_events",
    with_parts(
        f"""SELECT d.doc_id, d.entity_type, d.start, t.source AS tool_name, d.confidence, u.url,
            'high' AS severity, 'pii_detected' AS event,
            'High-severity PII (' || d.entity_type || ') detected in tool ''' || t.source
                || ''' with confidence ' || printf('%.2f', d.confidence) AS message
        FROM final_pass d JOIN texts t USING (doc_id),
            (VALUES ('https://a.example/hook'), ('https://b.example/hook')) AS u(url)
        WHERE d.entity_type IN ({_ALERT_LIST})"""
    ),
)
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    routes = [
        AlertRoute("https://a.example/hook"),
        AlertRoute("https://b.example/hook", ("daily", "high_severity")),
        AlertRoute("https://c.example/hook", ("daily",)),
    ]
    found = explode_detections(scan(texts(spark, sf)), ("doc_id", "source"))
    return alert_events(found, routes, "2024-01-01T00:00:00+00:00").select(
        "doc_id", "entity_type", "start", "tool_name", "confidence", "url", "severity", "event",
        "message",
    )


def _percentiles(rows: str) -> str:
    picks = ", ".join(
        f"round(max(CASE WHEN rn = least(CAST(floor(n * {p} / 100) AS BIGINT), n - 1) + 1"
        f" THEN value END), 3) AS p{p}"
        for p in (50, 95, 99)
    )
    return f"""SELECT {picks} FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn,
        count(*) OVER () AS n FROM {rows})"""


@query("metric_latency_percentiles", _percentiles("events"))
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return latency_percentiles(table(spark, sf, "events").select("value"), "value")


@query(
    "metric_latency_window",
    _percentiles("(SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)"),
)
def latency_window(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", "event_id", "value")
    return window_percentiles(latest(events, [F.desc("ts"), F.desc("event_id")]), "value")


# --- messages --------------------------------------------------------------------

MESSAGE_POLICY = Policy(source_actions={"assistant": "skip"})


@query("scan_message_lines", f"SELECT line FROM ({MESSAGES_SQL})")
def message_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "lines")
    # an empty line after each message
    messages(spark, sf).select(
        F.explode(F.array("line", F.lit(""))).alias("value")
    ).write.text(path)
    return read_messages(spark, path)


@query(
    "classify_messages",
    f"""SELECT msg_id, CASE WHEN kind < 5 THEN role END AS tool_name,
        CASE WHEN kind < 5 AND role <> 'assistant' THEN 'candidate' ELSE 'passthrough' END
            AS message_class
    FROM ({MESSAGES_SQL})""",
)
def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify_messages(messages(spark, sf), MESSAGE_POLICY).select(
        "msg_id", "message_class", "tool_name"
    )


@query("message_tool_name", f"SELECT msg_id, role AS tool_name FROM ({MESSAGES_SQL}) WHERE kind < 5")
def tool_names(spark: SparkSession, sf: str) -> DataFrame:
    return (
        classify_messages(messages(spark, sf))
        .where("tool_name is not null")
        .select("msg_id", "tool_name")
    )


_BLOCK = "doc_id // 10 AS msg_id, CAST(doc_id % 10 AS INTEGER) AS block"


@query(
    "explode_content_blocks",
    f"""SELECT {_BLOCK}, source, text,
        CASE doc_id % 10 WHEN 0 THEN 'text' ELSE 'resource' END AS block_type
    FROM ({BLOCKS_SQL})""",
)
def content_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return explode_blocks(messages(spark, sf))


_MASKED_BLOCKS = masked_texts(REDACT)


@query(
    "mask_message_blocks",
    with_parts(
        f"SELECT {_BLOCK}, masked_text AS text FROM ({_MASKED_BLOCKS})"
        " WHERE doc_id IN (SELECT doc_id FROM final_pass)",
        texts=BLOCKS_SQL,
    ),
)
def masked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    masked = mask_messages(messages(spark, sf))
    return masked.select("msg_id", F.posexplode("block_masked").alias("block", "text")).where(
        "text is not null"
    )


def _field(path: str, line: str = "masked_line") -> str:
    return f"if(modified, get_json_object({line}, '$.{path}'), null)"


@query(
    "rebuild_messages",
    with_parts(
        f""", masked AS MATERIALIZED ({_MASKED_BLOCKS}),
        hit AS (SELECT DISTINCT doc_id // 10 AS msg_id FROM final_pass)
        SELECT m.msg_id, h.msg_id IS NOT NULL AS modified,
            CASE WHEN h.msg_id IS NULL THEN m.line END AS untouched,
            CASE WHEN h.msg_id IS NOT NULL THEN a.masked_text END AS text,
            CASE WHEN h.msg_id IS NOT NULL THEN b.masked_text END AS resource_text,
            CASE WHEN h.msg_id IS NOT NULL THEN 'f' END AS uri,
            CASE WHEN h.msg_id IS NOT NULL THEN 'plain' END AS plain,
            CASE WHEN h.msg_id IS NOT NULL THEN 'a@b.example.com' END AS image,
            CASE WHEN h.msg_id IS NOT NULL THEN CAST(m.msg_id AS VARCHAR) END AS id,
            CASE WHEN h.msg_id IS NOT NULL THEN m.role END AS tool_name
        FROM ({MESSAGES_SQL}) m LEFT JOIN hit h USING (msg_id)
        LEFT JOIN masked a ON a.doc_id = m.msg_id * 10
        LEFT JOIN masked b ON b.doc_id = m.msg_id * 10 + 1""",
        texts=BLOCKS_SQL,
        scanned="source <> 'assistant'",
    ),
)
def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    masked = mask_messages(messages(spark, sf), MESSAGE_POLICY)
    fields = {
        "text": "result.content[0].text",
        "resource_text": "result.content[1].resource.text",
        "uri": "result.content[1].resource.uri",
        "plain": "result.content[2]",
        "image": "result.content[3].data",
        "id": "id",
        "tool_name": "result._meta.tool_name",
    }
    return masked.select(
        "msg_id",
        "modified",
        F.expr("if(modified, null, masked_line)").alias("untouched"),
        *[F.expr(_field(path)).alias(alias) for alias, path in fields.items()],
    )


@query(
    "rebuild_long_messages",
    with_parts(
        f""", masked AS MATERIALIZED ({_MASKED_BLOCKS}),
        hit AS (SELECT DISTINCT doc_id // 10 AS msg_id FROM final_pass)
        SELECT m.msg_id, CASE WHEN h.msg_id IS NULL THEN m.line
            ELSE replace(replace(m.line, to_json(t.text), to_json(a.masked_text)),
                coalesce(to_json(r.text), '\x00'), coalesce(to_json(b.masked_text), '')) END AS line
        FROM ({MESSAGES_SQL}) m LEFT JOIN hit h USING (msg_id)
        LEFT JOIN texts t ON t.doc_id = m.msg_id * 10
        LEFT JOIN texts r ON r.doc_id = m.msg_id * 10 + 1
        LEFT JOIN masked a ON a.doc_id = m.msg_id * 10
        LEFT JOIN masked b ON b.doc_id = m.msg_id * 10 + 1""",
        texts=BLOCKS_SQL,
        scanned="source <> 'assistant'",
    ),
)
def rebuilt_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as if it were too long for a variant: masked in place, all other bytes kept."""
    masked = mask_messages(messages(spark, sf), MESSAGE_POLICY, longest=0)
    return masked.select("msg_id", F.col("masked_line").alias("line"))


_PASSED = f"""(SELECT count(*) FROM ({MESSAGES_SQL})) - (SELECT count(DISTINCT doc_id // 10)
    FROM final_pass)"""


@query(
    "message_stats",
    with_parts(
        f"""SELECT (SELECT count(*) FROM ({MESSAGES_SQL})) AS total_messages,
            (SELECT count(DISTINCT doc_id) FROM final_pass) AS scanned,
            {_PASSED} AS passthrough, CAST(0 AS BIGINT) AS errors""",
        texts=BLOCKS_SQL,
        scanned="source <> 'assistant'",
    ),
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return message_stats(mask_messages(messages(spark, sf), MESSAGE_POLICY))


@query(
    "request_methods",
    f"SELECT msg_id, CASE WHEN kind = 6 THEN 'tools/call' END AS method FROM ({MESSAGES_SQL})",
)
def methods(spark: SparkSession, sf: str) -> DataFrame:
    return request_methods(messages(spark, sf)).select("msg_id", "method")


_PASSED_SQL = with_parts(
    f"SELECT {_PASSED} AS n", texts=BLOCKS_SQL, scanned="source <> 'assistant'"
)


@query(
    "metric_counters",
    _audit_sql(
        f"""SELECT CAST(sum(total_entities) AS BIGINT) AS entities_detected_total,
            CAST(sum(total_entities) AS BIGINT) AS entities_redacted_total,
            count(*) AS messages_scanned_total, (SELECT n FROM ({_PASSED_SQL}))
                AS messages_passthrough_total,
            CAST(0 AS BIGINT) AS errors_total FROM summaries"""
    ),
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    scanned = scan_summaries(scan(texts(spark, sf), POLICY), "2024")
    return metric_counters(scanned, mask_messages(messages(spark, sf), MESSAGE_POLICY))


# --- streams ---------------------------------------------------------------------


def _stream_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The text tables as streams of files."""

    def stream(name: str) -> DataFrame:
        return (
            spark.readStream.schema(table(spark, sf, name).schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf)
        )

    given = spread(as_texts(stream("documents")), "doc_id", like=documents(spark, sf))
    orders = spread_orders(stream("orders"), like=table(spark, sf, "orders"))
    return given.unionByName(order_texts(orders))


@query(
    "stream_mask_text",
    with_parts(
        f"SELECT doc_id, source, masked_text AS text FROM ({masked_texts(_MIXED)})",
        keep=_KEEP,
        scanned=SCANNED,
    ),
)
def streamed_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "stream-texts")
    stream_mask_text(
        _stream_texts(spark, sf), f"{path}/out", f"{path}/checkpoint", POLICY
    ).awaitTermination()
    return spark.read.schema("doc_id bigint, source string, text string").parquet(f"{path}/out")


@query(
    "stream_mask_messages",
    with_parts(
        f""", masked AS MATERIALIZED ({_MASKED_BLOCKS}),
        hit AS (SELECT DISTINCT doc_id // 10 AS msg_id FROM final_pass)
        SELECT CASE WHEN h.msg_id IS NULL THEN m.line END AS untouched,
            CASE WHEN h.msg_id IS NOT NULL THEN a.masked_text END AS text,
            CASE WHEN h.msg_id IS NOT NULL THEN b.masked_text END AS resource_text
        FROM ({MESSAGES_SQL}) m LEFT JOIN hit h USING (msg_id)
        LEFT JOIN masked a ON a.doc_id = m.msg_id * 10
        LEFT JOIN masked b ON b.doc_id = m.msg_id * 10 + 1""",
        texts=BLOCKS_SQL,
        scanned="source <> 'assistant'",
    ),
)
def streamed_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "stream-lines")
    messages(spark, sf).select(F.col("line").alias("value")).write.text(f"{path}/in")
    stream_mask_messages(
        stream_messages(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint", MESSAGE_POLICY
    ).awaitTermination()
    lines = read_messages(spark, f"{path}/out").withColumn(
        "modified", F.col("line").contains("_REDACTED>")
    )
    return lines.select(
        F.expr("if(modified, null, line)").alias("untouched"),
        F.expr(_field("result.content[0].text", "line")).alias("text"),
        F.expr(_field("result.content[1].resource.text", "line")).alias("resource_text"),
    )


@query("stream_pseudonyms", f"SELECT doc_id, source, masked_text AS text FROM ({PSEUDO_SQL})")
def streamed_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive first, the derived texts (with higher ids) later."""
    path = new_folder(spark, "stream-pseudonyms")
    for part in text_parts(spark, sf):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        stream_pseudonyms(
            stream, f"{path}/out", f"{path}/dictionary", f"{path}/checkpoint"
        ).awaitTermination()
    return (
        spark.read.schema("doc_id bigint, source string, text string")
        .parquet(f"{path}/out")
        .drop("batch_id")
    )


@query("stream_tokens", with_parts(f"SELECT doc_id, source, masked_text AS text FROM ({masked_texts(_TOKEN, _NUMBERED)})"))
def streamed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches: the derived texts go on where the documents' numbers end."""
    path = new_folder(spark, "stream-tokens")
    for part in text_parts(spark, sf):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        stream_masked_with_tables(
            stream, f"{path}/out", f"{path}/checkpoint", Policy(use_reversible=True), tokens=f"{path}/tokens", keyring=keyring(spark)
        ).awaitTermination()
    return (
        spark.read.schema("doc_id bigint, source string, text string")
        .parquet(f"{path}/out")
        .drop("batch_id")
    )


@query("restore_stream", f"SELECT doc_id, text AS restored_text FROM ({TEXTS_SQL})")
def stream_restored(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream masked with tokens, and the tokens it stored, give back."""
    path = new_folder(spark, "stream-restored")
    stream_masked_with_tables(
        _stream_texts(spark, sf), f"{path}/out", f"{path}/checkpoint", Policy(use_reversible=True), tokens=f"{path}/tokens", keyring=keyring(spark)
    ).awaitTermination()
    masked = spark.read.schema("doc_id bigint, text string").parquet(f"{path}/out").select("doc_id", "text")
    return restore_text(masked, read_stream_tokens(spark, f"{path}/tokens"), keyring(spark)).select("doc_id", "restored_text")


@query(
    "stream_latency_window",
    _percentiles("(SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)"),
)
def streamed_window(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches, none of them in the order of events."""
    path = new_folder(spark, "stream-latencies")
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{path}/in")
        stream_latency_window(
            spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint", "value", ["ts", "event_id"]
        ).awaitTermination()
    held = latest_table(spark, f"{path}/out", rows.select("value", "ts", "event_id").schema)
    return window_percentiles(held, "value")


_NEAR = ", ".join(f"true AS p{p}_near" for p in (50, 95, 99))


@query("latency_sketches", f"SELECT count(value) AS n, {_NEAR} FROM events")
def sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Stored sketches of the events of each type, merged: is each percentile where it should be?"""
    values = table(spark, sf, "events").select("event_type", "value")
    path = new_folder(spark, "sketches")
    latency_sketches(values, "value", "event_type").write.parquet(path)
    found = sketch_percentiles(spark.read.parquet(path)).first()
    near = [
        # the value's own rows reach from the share below it to the share up to it
        F.expr(
            f"""count_if(value < {found[f"p{p}"]!r}D - 0.0005D) / count(value) <= {p / 100 + RANK_ERROR}
            and count_if(value <= {found[f"p{p}"]!r}D + 0.0005D) / count(value) >= {p / 100 - RANK_ERROR}"""
        ).alias(f"p{p}_near")
        for p in (50, 95, 99)
    ]
    return values.agg(F.count("value").alias("n"), *near)


@query("stream_compliance_report", ORACLES["compliance_report_json"])
def streamed_report(spark: SparkSession, sf: str) -> DataFrame:
    """The audit log in two batches, each read once; the report is folded from what they left."""
    path = new_folder(spark, "stream-report")
    # what the texts are scanned for is stored once and then dealt out
    log = materialized(_log(spark, sf))
    for part in range(2):
        log.where(F.pmod(F.xxhash64("tool_name", "timestamp"), F.lit(2)) == part).write.mode("append").parquet(f"{path}/in")
        stream_report_parts(
            spark.readStream.schema(log.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint"
        ).awaitTermination()
    return report_of_parts(spark.read.parquet(f"{path}/out").drop("batch_id"), "2024-02-01T00:00:00+00:00")


@query(
    "stream_audit",
    _audit_sql(
        """SELECT '2024-01-01' AS timestamp, NULL AS event_type, tool_name, entity_type, original_length,
            masked_text, confidence, masking_strategy, NULL AS total_entities FROM redactions
        UNION ALL SELECT '2024-01-01', event_type, tool_name, NULL, NULL, NULL, NULL, NULL,
            total_entities FROM summaries"""
    ),
)
def streamed_audit(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "stream-audit")
    stream_audit(
        _stream_texts(spark, sf), f"{path}/out", f"{path}/checkpoint", "2024-01-01", POLICY
    ).awaitTermination()
    return parse_audit(spark.read.text(f"{path}/out")).select(
        "timestamp", "event_type", "tool_name", "entity_type", "original_length", "masked_text",
        "confidence", "masking_strategy", "total_entities",
    )


@query(
    "stream_entity_counts",
    with_parts(
        "SELECT entity_type, count(*) AS n FROM final_pass GROUP BY 1",
        keep=_KEEP,
        scanned=SCANNED,
    ),
)
def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "stream-counts")
    stream_entity_counts(
        _stream_texts(spark, sf), f"{path}/out", f"{path}/checkpoint", POLICY
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out")


