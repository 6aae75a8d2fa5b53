"""Rules, recognizer spans, audit events, reports, metrics and alerts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilwork import AlertRoute, Policy, scan, scan_and_mask
from veilwork.operators.alerts import alert_events
from veilwork.operators.audit import audit_events, audit_log, audit_redactions, scan_summaries
from veilwork.operators.detect import entity_counts, explode_detections, ingest_ner_spans
from veilwork.operators.metrics import (
    approximate_percentiles,
    latency_percentiles,
    latest,
    metric_counters,
    window_percentiles,
)
from veilwork.operators.reports import (
    compliance_period,
    compliance_report,
    compliance_status,
    compliance_totals,
    dashboard_totals,
    distribution,
    recent_events,
    scan_report,
)
from veilwork.operators.rules import apply_entity_rules, apply_source_rules, resolve_rules
from veilwork.sources.audit_log import read_audit, write_audit

SCHEMA = "doc_id bigint, source string, text string"


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(1, "t1", "a@b.com and c@d.com, SSN: 123-45-6789"), (2, "t2", "none"), (3, "t1", None),
            (4, None, "card 4111-1111-1111-1111")]
    return scan_and_mask(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def log(masked):
    return audit_events(masked, F.concat(F.lit("2024-01-0"), F.col("doc_id")), F.col("doc_id") * 1.5)


def test_log_in_one_pass_equals_both_parts(masked, log):
    stamp = F.concat(F.lit("2024-01-0"), F.col("doc_id"))
    both = audit_log(
        audit_redactions(masked, stamp), scan_summaries(masked, stamp, F.col("doc_id") * 1.5)
    )
    text = [F.col(c) if c not in ("metadata", "entity_counts") else F.col(c).cast("string") for c in both.columns]
    key = lambda row: str(row)
    assert sorted(log.select(text).collect(), key=key) == sorted(both.select(text).collect(), key=key)


def test_events(masked, log):
    first = audit_redactions(masked, "t", key=("doc_id",)).where("doc_id = 1").collect()
    assert [r.entity_type for r in first] == ["SSN", "EMAIL", "EMAIL"]
    assert first[0].original_length == 11 and first[0].masked_text == "<SSN_REDACTED>"
    summary = {r.timestamp: r for r in log.where("event_type = 'scan_summary'").collect()}
    assert summary["2024-01-01"].entity_counts == {"EMAIL": 1, "SSN": 1}
    assert summary["2024-01-01"].total_entities == 3
    assert set(summary) == {"2024-01-01", "2024-01-02", "2024-01-04"}


def test_log_on_storage(spark, log, tmp_path):
    path = str(tmp_path / "log")
    write_audit(log, path)
    write_audit(log.limit(1), path)
    (tmp_path / "log" / "broken.json").write_text('  \n{"timestamp": \n[1]\n5\n{"timestamp": "z"}  \n')
    events = read_audit(spark, path)
    assert events.count() == log.count() + 2
    assert events.where("timestamp = 'z'").count() == 1
    assert read_audit(spark, str(tmp_path / "missing")).count() == 0


def test_compliance(log):
    # three confidences at the cap of 1, one of 0.98
    assert compliance_totals(log).first() == (3, 4, 0.995, 0)
    assert [tuple(r) for r in distribution(log, "entity_type").collect()] == [
        ("EMAIL", 2), ("CREDIT_CARD", 1), ("SSN", 1),
    ]
    assert [tuple(r) for r in distribution(log, "tool_name").collect()] == [("t1", 3), ("unknown", 1)]
    assert compliance_period(log).first() == ("2024-01-01", "2024-01-04")
    assert compliance_status(log).first()[0] == "COMPLIANT"
    report = json.loads(compliance_report(log, "now").first().report)
    assert report["average_confidence"] == compliance_totals(log).first().average_confidence
    assert report["tool_distribution"] == {"t1": 3, "unknown": 1}
    assert report["total_scans"] == 3 and report["report_generated"] == "now"
    assert dashboard_totals(log).first() == (3, 4, 3.5)


def test_empty_log(log):
    nothing = log.limit(0)
    assert compliance_status(nothing).first()[0] == "NO_DATA"
    assert compliance_period(nothing).first() == ("N/A", "N/A")
    assert compliance_totals(nothing).first() == (0, 0, 0.0, 0)
    report = json.loads(compliance_report(nothing).first().report)
    assert report["compliance_status"] == "NO_DATA" and report["entity_type_distribution"] == {}
    assert dashboard_totals(nothing).first() == (0, 0, 0.0)


def test_recent_events(log):
    rows = recent_events(log, [F.desc("timestamp"), F.desc("entity_type")], 2).collect()
    assert [(r.entity_type, r.severity) for r in rows] == [("CREDIT_CARD", "high"), ("SSN", "high")]


def test_scan_report(masked):
    row = scan_report(masked).where("doc_id = 4").first()
    assert json.loads(row.report) == {
        "original": "card 4111-1111-1111-1111",
        "masked": "card <CREDIT_CARD_REDACTED>",
        "dry_run": False,
        "entities": [{"type": "CREDIT_CARD", "text": "4111-1111-1111-1111", "start": 5, "end": 24,
                      "confidence": 0.98, "engine": "regex"}],
        "processing_time_ms": 0.0,
    }


def test_entity_counts(masked):
    row = entity_counts(masked).where("doc_id = 1").first()
    assert row.has_pii and row.entity_counts == {"EMAIL": 2, "SSN": 1}


@pytest.mark.parametrize("n", [1, 7, 100, 1000, 3333])
def test_percentiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.random() * 50, 2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "ms double")
    ordered = sorted(values)
    expected = tuple(round(ordered[min(int(n * p / 100), n - 1)], 3) for p in (50, 95, 99))
    assert latency_percentiles(df, "ms").first() == expected
    if n <= 1000:
        assert window_percentiles(df, "ms").first() == expected


def test_percentiles_of_nothing_and_sketch(spark):
    df = spark.createDataFrame([(1.0,)], "ms double")
    assert latency_percentiles(df.limit(0), "ms").first() == (0.0, 0.0, 0.0)
    assert window_percentiles(df.limit(0), "ms").first() == (0.0, 0.0, 0.0)
    assert approximate_percentiles(df, "ms").first() == (1.0, 1.0, 1.0)


def test_latest(spark):
    df = spark.range(5000).withColumn("ms", F.col("id") * 1.0)
    rows = latest(df, [F.desc("id")]).collect()
    assert len(rows) == 1000 and min(r.id for r in rows) == 4000


def test_counters(masked, log):
    summaries = log.where("event_type = 'scan_summary'")
    row = metric_counters(summaries).first().asDict()
    assert row["entities_detected_total"] == row["entities_redacted_total"] == 4
    assert (row["messages_scanned_total"], row["messages_passthrough_total"]) == (3, 0)


def test_rules_as_tables(spark, masked):
    rules = resolve_rules(
        spark.createDataFrame(
            [("email", False, None, None), ("Ssn", None, "hash", 1.1), ("nonsense", True, None, 0.1)],
            "entity_type string, enabled boolean, masking_strategy string, confidence_threshold double",
        ),
        "partial",
        0.6,
    )
    assert sorted(map(tuple, rules.collect())) == [
        ("EMAIL", False, "partial", 0.6), ("SSN", True, "hash", 1.1),
    ]
    kept = apply_entity_rules(explode_detections(masked), rules)
    assert [r.entity_type for r in kept.collect()] == ["CREDIT_CARD"]
    sources = spark.createDataFrame([("t1", "skip"), ("t2", "strict")], "source string, action string")
    ruled = apply_source_rules(masked.drop("scanned"), sources)
    assert {r.doc_id: r.scanned for r in ruled.collect()} == {1: False, 2: True, 3: False, 4: True}


def test_recognizer_spans(spark):
    rows = [(1, "PERSON", 0, 9, "Ann Smith"), (2, "PERSON", 0, 3, "BOB"), (3, "ORG", 0, 4, "ACME"),
            (4, "GPE", 0, 1, "X"), (5, "FAC", 0, 8, "Old Mill"), (6, "DATE", 0, 4, "2024"),
            (7, "PERSON", 0, 9, "ANN SMITH"), (8, "LOC", 0, 3, " Y ")]
    spans = spark.createDataFrame(rows, "doc_id bigint, label string, start int, end int, text string")
    found = {r.doc_id: (r.entity_type, r.confidence) for r in ingest_ner_spans(spans).collect()}
    assert found == {
        1: ("PERSON_NAME", 0.85), 2: ("PERSON_NAME", 0.6), 3: ("ORGANIZATION", 0.75), 4: ("LOCATION", 0.2),
        5: ("ADDRESS", 0.85), 7: ("PERSON_NAME", 0.7), 8: ("LOCATION", 0.2),
    }


def test_recognizer_spans_in_a_scan(spark):
    df = spark.createDataFrame([(1, "s", "Ann Smith a@b.com"), (2, "s", "Bob")], SCHEMA)
    spans = spark.createDataFrame(
        [(1, "PERSON", 0, 9, "Ann Smith"), (1, "ORG", 4, 17, "Smith a@b.com")],
        "doc_id bigint, label string, start int, end int, text string",
    )
    rows = scan(df, Policy(use_ner=True), ner=ingest_ner_spans(spans)).orderBy("doc_id").collect()
    assert [(d.entity_type, d.engine) for d in rows[0].detections] == [
        ("PERSON_NAME", "nlp"), ("EMAIL", "regex"),
    ]
    assert rows[1].detections == []


def test_alerts(masked):
    routes = [AlertRoute("u1"), AlertRoute("u2", ("x",)), AlertRoute("u3", ("x", "high_severity"))]
    found = explode_detections(masked, ("doc_id", "source"))
    rows = alert_events(found, routes, "now").collect()
    assert sorted((r.entity_type, r.url) for r in rows) == [
        ("CREDIT_CARD", "u1"), ("CREDIT_CARD", "u3"), ("SSN", "u1"), ("SSN", "u3"),
    ]
    assert "High-severity PII (SSN) detected in tool 't1' with confidence 1.00" in {r.message for r in rows}
    assert alert_events(found, [], "now").count() == 0
