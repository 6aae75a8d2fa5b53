"""Work that must not be done twice, or by too few tasks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

import catalog.reporting
from catalog.inputs import table, text_parts
from veilwork.operators.dictionary import mask_with_tables
from veilwork.plans.scan import scan
from veilwork.policy import Policy
from veilwork.session import SPREAD_BYTES, materialized, spread


@pytest.mark.parametrize("policy", [Policy(default_strategy="pseudo"), Policy(use_reversible=True)])
def test_texts_that_wait_for_nothing_are_not_scanned_again(spark, policy):
    rows = [(1, "a", "mail me@corp.com"), (2, "a", "nothing"), (3, None, None), (None, "b", "or you@corp.com"), (2, "a", "nothing")]
    texts = spark.createDataFrame(rows, "doc_id long, source string, text string")
    ring = spark.createDataFrame([(1, bytearray(b"0" * 32))], "key_id int, key binary")
    masked, _ = mask_with_tables(scan(texts, policy), policy, keyring=ring)
    assert "ghp|gho|ghu" not in masked._jdf.queryExecution().optimizedPlan().toString()
    found = masked.select("doc_id", "masked_text").collect()
    assert sorted(r.masked_text for r in found if r.doc_id == 2) == ["nothing", "nothing"]
    assert len(found) == 5 and not any("corp" in (r.masked_text or "") for r in found)


def test_parts_of_a_spread_input_grow_with_it(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = (spread(spark.range(rows), "id").rdd.getNumPartitions() for rows in (10, 4 * cores * SPREAD_BYTES // 8))
    assert (few, many) == (cores, 4 * cores)


def test_keys_are_dealt_out_before_they_become_texts(spark, tmp_path):
    orders = [(k, 7 * k) for k in range(100)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    derived = text_parts(spark, str(tmp_path))[1]
    plan = derived._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("'Email: '" if "'Email: '" in plan else "Email: ") < plan.index("RepartitionByExpression")
    assert derived.count() == table(spark, str(tmp_path), "orders").count() == 100


def test_the_log_of_a_streamed_report_is_made_once(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def counted(tool):
        made.add(1)
        return tool

    events = materialized(
        spark.createDataFrame([("EMAIL", f"src{k}") for k in range(8)], "entity_type string, tool_name string").select(
            F.lit("2024-01-01").alias("timestamp"), F.lit(None).cast("string").alias("event_type"), "tool_name", "entity_type",
            F.lit("redact").alias("masking_strategy"), F.lit(0.5).alias("confidence"), F.lit(False).alias("dry_run"),
        )
    )
    log = events.withColumn("tool_name", F.udf(counted, StringType())("tool_name"))
    monkeypatch.setattr(catalog.reporting, "_log", lambda *_: log)
    report = catalog.reporting.streamed_report(spark, str(tmp_path)).first().report
    assert '"total_entities_redacted":8' in report
    assert made.value == 8
