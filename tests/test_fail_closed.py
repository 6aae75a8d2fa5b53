"""Whatever the strategy and the way in, no original value may remain."""

import json

import pytest
from pyspark.sql import functions as F

from veilwork.functions.strategies import hash_strategy
from veilwork.operators.detect import ingest_ner_spans, misplaced_spans, with_spans
from veilwork.operators.dictionary import mask_with_tables, restore_text
from veilwork.operators.messages import mask_messages, mask_messages_reversibly
from veilwork.plans.scan import mask, scan, scan_and_mask
from veilwork.policy import EntityRule, Policy
from veilwork.sources.audit_log import parse_audit
from veilwork.sources.texts import write_bucketed
from veilwork.streaming.streams import stream_mask_text, stream_message_pseudonyms

MAIL, PHONE = "john@example.com", "555-123-4567"
TEXT = f"mail {MAIL} tel {PHONE}"
SHA3 = (hash_strategy("sha3_256"),)
POLICIES = {
    "reversible": Policy(use_reversible=True),
    "pseudo": Policy(default_strategy="pseudo"),
    "sha3": Policy(default_strategy="hash", strategies=SHA3),
    "pseudo_and_reversible": Policy(use_reversible=True, entity_rules={"EMAIL": EntityRule(strategy="pseudo")}),
    "all": Policy(
        use_reversible=True,
        strategies=SHA3,
        entity_rules={"EMAIL": EntityRule(strategy="pseudo"), "SSN": EntityRule(strategy="hash")},
    ),
    "partial": Policy(default_strategy="partial"),
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "s", TEXT), (1, "s", f"again {TEXT}"), (None, "s", TEXT), (None, None, f"SSN: 123-45-6789 {MAIL}"), (3, "s", None)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


@pytest.fixture(scope="module")
def keyring(spark):
    return spark.createDataFrame([(1, bytearray(b"0123456789abcdef"))], "key_id int, key binary")


def clean(value):
    return value is None or not any(x in value for x in (MAIL, PHONE, "123-45-6789"))


@pytest.mark.parametrize("name", POLICIES)
@pytest.mark.parametrize("with_key", [False, True])
def test_texts(texts, keyring, name, with_key):
    policy = POLICIES[name]
    scanned = scan(texts, policy)
    masked, tokens = mask_with_tables(scanned, policy, keyring=keyring if with_key else None)
    rows = masked.collect()
    assert len(rows) == 5 and all(clean(r.masked_text) for r in rows)
    assert all(r.masked is not None for row in rows for r in row.redactions)
    assert (tokens is not None) == (with_key and policy.use_reversible)
    if tokens is not None and name == "reversible":
        back = restore_text(masked.select("doc_id", "masked_text"), tokens, keyring, text="masked_text")
        assert sorted(filter(None, (r.restored_text for r in back.collect()))) == sorted(
            filter(None, (r.text for r in texts.collect()))
        )
    assert all(clean(r.masked_text) for r in scan_and_mask(texts, policy).collect())


@pytest.mark.parametrize("name", POLICIES)
def test_plain_mask_raises_or_masks(texts, name):
    policy = POLICIES[name]
    if policy.without_tokens().needs_tables():
        with pytest.raises(ValueError):
            mask(scan(texts, policy), policy)
    else:
        assert all(clean(r.masked_text) for r in mask(scan(texts, policy), policy).collect())


@pytest.mark.parametrize("name", POLICIES)
@pytest.mark.parametrize("with_key", [False, True])
def test_messages(spark, keyring, name, with_key):
    line = json.dumps({"result": {"content": [{"type": "text", "text": TEXT}, {"type": "text", "text": "ok"}]}})
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, "not json")], "msg_id bigint, line string")
    masked, tokens = mask_messages_reversibly(df, POLICIES[name], keyring if with_key else None)
    rows = masked.collect()
    assert sorted(r.modified for r in rows) == [False, True, True, True]
    assert all(clean(r.masked_line) for r in rows)
    assert (tokens is not None) == (with_key and POLICIES[name].use_reversible)


def test_a_line_too_long_for_a_variant(spark):
    line = F.concat(
        F.lit('{"result": {"content": [{"type": "text", "text": "' + MAIL + ' '), F.repeat(F.lit("x"), 20_100_000), F.lit('"}]}}')
    )
    df = spark.range(1).select(F.lit(1).alias("msg_id"), line.alias("line"))
    hidden = F.contains("masked_line", F.lit('"<EMAIL_REDACTED> xxx')) & ~F.contains("masked_line", F.lit(MAIL))
    assert mask_messages(df).select(hidden.alias("ok")).first().ok


SPANS = "doc_id bigint, label string, start int, `end` int, text string"
NER = Policy(use_ner=True)


def test_recognized_spans_of_null_keys(spark):
    rows = [(None, "s", "Maria Smith met us"), (1, "s", "we met Maria Smith"), (2, "s", "nobody"), (2, "s", "nobody else")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = spark.createDataFrame(
        [(None, "PERSON", 0, 11, "Maria Smith"), (1, "PERSON", 7, 18, "Maria Smith"), (1, "ORG", 0, 6, "we met"), (9, "ORG", 0, 1, "x")], SPANS
    )
    out = {r.text: r.masked_text for r in scan_and_mask(df, NER, ner=ingest_ner_spans(found)).collect()}
    assert out == {
        "Maria Smith met us": "<PERSON_NAME_REDACTED> met us", "we met Maria Smith": "<ORGANIZATION_REDACTED> <PERSON_NAME_REDACTED>",
        "nobody": "nobody", "nobody else": "nobody else",
    }
    assert [r.doc_id for r in misplaced_spans(df, ingest_ner_spans(found)).collect()] == [9]


@pytest.mark.parametrize("key", [2, None])
def test_recognized_spans_of_repeated_keys_are_refused(spark, key):
    df = spark.createDataFrame([(key, "s", "Maria Smith met us"), (key, "s", "Teddy today at all")], "doc_id bigint, source string, text string")
    found = spark.createDataFrame([(key, "PERSON", 0, 11, "Maria Smith")], SPANS)
    with pytest.raises(ValueError, match="several texts"):
        scan(df, NER, ner=ingest_ner_spans(found))


def test_spans_at_wrong_offsets_are_reported(spark):
    df = spark.createDataFrame([(1, "s", "Maria Smith met us"), (2, "s", "é😀 Maria"), (3, "s", None)], "doc_id bigint, source string, text string")
    found = ingest_ner_spans(spark.createDataFrame(
        [(1, "PERSON", 1, 12, "Maria Smith"), (1, "PERSON", -3, 5, "Maria"), (1, "ORG", 12, 15, "met"), (2, "GPE", 3, 8, "Maria"), (2, "GPE", 40, 45, "Maria"), (3, "ORG", 0, 1, "x")],
        SPANS,
    ))
    masked = {r.doc_id: r.masked_text for r in scan_and_mask(df, NER, ner=found).collect()}
    assert masked == {1: "Maria Smith <ORGANIZATION_REDACTED> us", 2: "é😀 <LOCATION_REDACTED>", 3: None}
    wrong = sorted((r.doc_id, r.start) for r in misplaced_spans(df, found).collect())
    assert wrong == [(1, -3), (1, 1), (2, 40), (3, 0)]


def test_bucketed_texts_meet_their_spans_without_a_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(k, "s", f"Maria Smith {k}") for k in range(50)] + [(None, "s", "Maria Smith n")], "doc_id bigint, source string, text string")
    found = ingest_ner_spans(spark.createDataFrame([(k, "PERSON", 0, 11, "Maria Smith") for k in (*range(0, 50, 2), None)], SPANS))
    write_bucketed(df, "bucketed_texts", str(tmp_path / "texts"), 4)
    write_bucketed(found, "bucketed_spans", str(tmp_path / "spans"), 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = with_spans(spark.table("bucketed_texts"), spark.table("bucketed_spans"), ("doc_id",), "_ner")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # the branch of the texts with a key comes first
        whole = plan.split("\n   +- ")[0]
        assert "bucketed_texts" in whole and "SortMergeJoin" in whole and "Exchange" not in whole
        masked = scan_and_mask(spark.table("bucketed_texts"), NER, ner=spark.table("bucketed_spans"))
        assert sum("REDACTED" in r.masked_text for r in masked.collect()) == 26
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_texts")
        spark.sql("DROP TABLE bucketed_spans")


def test_a_key_id_with_two_keys_is_refused(spark, texts):
    ring = spark.createDataFrame([(1, bytearray(b"0123456789abcdef")), (1, bytearray(b"fedcba9876543210"))], "key_id int, key binary")
    with pytest.raises(ValueError, match="several keys"):
        mask_with_tables(scan(texts, POLICIES["reversible"]), POLICIES["reversible"], keyring=ring)


def test_streams(spark, texts, tmp_path):
    source = str(tmp_path / "in")
    texts.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(texts.schema).parquet(source)
    with pytest.raises(ValueError):
        stream_mask_text(stream, str(tmp_path / "o"), str(tmp_path / "c"), POLICIES["pseudo"])
    query = stream_mask_text(stream, str(tmp_path / "o2"), str(tmp_path / "c2"), POLICIES["reversible"])
    query.awaitTermination()
    assert all(clean(r.text) for r in spark.read.parquet(str(tmp_path / "o2")).collect())


def test_message_stream_with_pseudonyms(spark, tmp_path):
    lines = [json.dumps({"result": {"content": [{"type": "text", "text": t}]}}) for t in (TEXT, f"b {TEXT}")]
    for k, line in enumerate(lines):
        spark.createDataFrame([(k, line)], "msg_id bigint, line string").write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("msg_id bigint, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream_message_pseudonyms(stream, str(tmp_path / "o"), str(tmp_path / "d"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    found = [json.loads(r.line)["result"]["content"][0]["text"] for r in rows]
    assert len(found) == 2 and all(map(clean, found))
    assert len({t.removeprefix("b ") for t in found}) == 1


def test_audit_lines_are_read_alike_in_every_session(spark):
    lines = ['{"event_type": "a", "event_type": "b"}', "{broken", '{"event_type": "c"}', "", "[1]"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for setting in ("false", "true"):
        before = spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", setting)
        try:
            assert sorted(r.event_type for r in parse_audit(df).collect()) == ["b", "c"]
        finally:
            spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_restore_tokens_of_any_type(spark, keyring):
    detector = lambda t: (
        f"if(contains({t}, 'BADGE-7'), array(named_struct('entity_type', 'BADGE', 'start', instr({t}, 'BADGE-7') - 1,"
        f" 'end', instr({t}, 'BADGE-7') + 6, 'text', 'BADGE-7', 'confidence', 0.9D)), null)"
    )
    policy = Policy(use_reversible=True, detectors=(detector,))
    df = spark.createDataFrame([(1, "s", "has BADGE-7 here")], "doc_id bigint, source string, text string")
    masked, tokens = mask_with_tables(scan(df, policy), policy, keyring=keyring)
    assert "BADGE-7" not in masked.first().masked_text
    back = restore_text(masked.select("masked_text"), tokens, keyring, text="masked_text").first()
    assert back.restored_text == "has BADGE-7 here"


def test_many_matches_cost_little_more_each(spark):
    import time

    def seconds(n):
        text = " ".join(f"u{k}@example.com" for k in range(n))
        df = spark.createDataFrame([(1, "s", text)], "doc_id bigint, source string, text string")
        begin = time.perf_counter()
        assert scan(df, Policy(use_context=False)).selectExpr("size(detections) n").first().n == n
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(12_000) < 12 * max(seconds(3_000), 0.5)
