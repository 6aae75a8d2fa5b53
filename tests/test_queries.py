"""The registered queries against their SQL, on the smallest tables.

A cross-section by default; ``ALL_QUERIES=1`` runs every one.
"""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from catalog.registry import ORACLES as OWN_ORACLES
from catalog.registry import QUERIES as OWN_QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "detect_all",
    "match_offsets",
    "remove_overlaps_across_engines",
    "context_rescore",
    "filter_skipped_sources",
    "mask_mixed",
    "mask_pseudo",
    "restore_text",
    "sink_token_mapping",
    "sink_audit_jsonl",
    "compliance_report_json",
    "scan_result",
    "metric_latency_percentiles",
    "rebuild_messages",
    "stream_pseudonyms",
    "stream_audit",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CHOSEN = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(OWN_QUERIES) - set(OWN_ORACLES) == {"mask_hash_sha3_256"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_every_sql_binds(key):
    connect(SF).execute(f"EXPLAIN {ORACLES[key]}")


@pytest.mark.parametrize("key", CHOSEN)
def test_query_equals_sql(spark, key):
    assert difference(spark, SF, QUERIES[key], ORACLES[key]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
