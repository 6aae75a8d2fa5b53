"""Streams give what batches give, also over several micro-batches and replays."""

import json

import pytest

from veilwork import Policy, scan_and_mask
from veilwork.operators.audit import audit_events
from veilwork.operators.dictionary import mask_with_tables, pseudonym_dictionary, restore_text
from veilwork.operators.messages import mask_messages
from veilwork.plans.scan import scan
from veilwork.policy import EntityRule
from veilwork.sources.audit_log import parse_audit
from veilwork.sources.lines import read_messages, stream_messages
from veilwork.streaming.stored import StoredDictionary, batch_folder, last_token, read_dictionary, read_stream_tokens
from veilwork.streaming.streams import (
    stream_audit,
    stream_entity_counts,
    stream_mask_messages,
    stream_mask_text,
    stream_masked_with_tables,
    stream_messages_with_tables,
    stream_pseudonyms,
)

SCHEMA = "doc_id bigint, source string, text string"
PARTS = [
    [(1, "s", "a@b.com and c@d.com"), (2, "s", "tel 555-123-4567"), (3, "skip", "a@b.com")],
    [(4, "s", "c@d.com then e@f.com"), (5, "s", "nothing")],
    [(6, None, "e@f.com a@b.com tel 555-123-4568")],
]
POLICY = Policy(source_actions={"skip": "skip"})


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes the parts one after the other and runs a stream after each."""
    source = str(tmp_path / "in")

    def run(start):
        for part in PARTS:
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
            start(spark.readStream.schema(SCHEMA).parquet(source)).awaitTermination()
        return spark.read.schema(SCHEMA).parquet(source)

    return run


def test_texts(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    texts = feed(lambda s: stream_mask_text(s, out, str(tmp_path / "c"), POLICY))
    batch = scan_and_mask(texts, POLICY).select("doc_id", "source", "masked_text")
    assert _rows(spark.read.parquet(out)) == _rows(batch)


def test_pseudonyms(spark, feed, tmp_path):
    out, dictionary = str(tmp_path / "out"), str(tmp_path / "dict")
    policy = Policy(default_strategy="pseudo", source_actions={"skip": "skip"})
    texts = feed(lambda s: stream_pseudonyms(s, out, dictionary, str(tmp_path / "c"), policy))
    batch = scan_and_mask(texts, policy).select("doc_id", "source", "masked_text")
    streamed = spark.read.parquet(out).drop("batch_id")
    assert _rows(streamed) == _rows(batch)
    stored = read_dictionary(spark, dictionary)
    assert stored.select("entity_type", "text").distinct().count() == stored.count() == 5
    assert read_dictionary(spark, dictionary, before=1).count() == 3


def test_pseudonyms_of_a_replayed_batch(spark, feed, tmp_path):
    out, dictionary = str(tmp_path / "out"), str(tmp_path / "dict")
    policy = Policy(default_strategy="pseudo", source_actions={"skip": "skip"})
    feed(lambda s: stream_pseudonyms(s, out, dictionary, str(tmp_path / "c"), policy))
    before = _rows(spark.read.parquet(out)), _rows(read_dictionary(spark, dictionary))
    # the commit of the last batch is lost, so it runs again
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "c" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    stream_pseudonyms(stream, out, dictionary, str(tmp_path / "c"), policy).awaitTermination()
    assert (_rows(spark.read.parquet(out)), _rows(read_dictionary(spark, dictionary))) == before


def test_audit(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    texts = feed(lambda s: stream_audit(s, out, str(tmp_path / "c"), "2024", POLICY))
    columns = ["event_type", "tool_name", "entity_type", "masked_text", "total_entities"]
    batch = audit_events(scan_and_mask(texts, POLICY), "2024").select(*columns)
    streamed = parse_audit(spark.read.text(out)).select(*columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    first = spark.read.text(batch_folder(out, 0)).count()
    assert first == 3 + 2


def test_counts(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    feed(lambda s: stream_entity_counts(s, out, str(tmp_path / "c"), POLICY))
    assert _rows(spark.read.parquet(out)) == [("EMAIL", 6), ("PHONE_NUMBER", 2)]


def test_messages(spark, tmp_path):
    lines = ['{"result": {"content": [{"type": "text", "text": "a@b.com"}]}}', "no", '{"a": 1}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("\n\n".join(lines))
    out = str(tmp_path / "out")
    stream = stream_messages(spark, str(tmp_path / "in"))
    stream_mask_messages(stream, out, str(tmp_path / "c"), POLICY).awaitTermination()
    batch = mask_messages(read_messages(spark, str(tmp_path / "in")), POLICY, key=())
    assert _rows(spark.read.text(out)) == _rows(batch.select("masked_line"))


# --- stored tables --------------------------------------------------------------


def replayed(tmp_path, name):
    """Forget that the last batch was committed, so that it runs again."""
    commits = sorted((tmp_path / name / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / name / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()


@pytest.fixture()
def keyring(spark):
    return spark.createDataFrame([(1, bytearray(b"0123456789abcdef"))], "key_id int, key binary")


def test_tokens_on_a_stream(spark, feed, tmp_path, keyring):
    out, tokens = str(tmp_path / "out"), str(tmp_path / "tokens")
    policy = Policy(use_reversible=True, source_actions={"skip": "skip"})

    def start(stream):
        return stream_masked_with_tables(stream, out, str(tmp_path / "c"), policy, tokens=tokens, keyring=keyring)

    texts = feed(start)
    masked, batch_tokens = mask_with_tables(scan(texts, policy), policy, keyring=keyring)
    streamed = spark.read.parquet(out).drop("batch_id")
    assert _rows(streamed) == _rows(masked.select("doc_id", "source", "masked_text"))
    stored = read_stream_tokens(spark, tokens)
    assert _rows(stored) == _rows(batch_tokens.select(*stored.columns))
    restored = restore_text(streamed, stored, keyring).select("doc_id", "source", "restored_text")
    assert _rows(restored) == _rows(texts.selectExpr("doc_id", "coalesce(source, 'unknown')", "text"))
    before = _rows(streamed), _rows(stored)
    replayed(tmp_path, "c")
    start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).awaitTermination()
    assert (_rows(spark.read.parquet(out).drop("batch_id")), _rows(read_stream_tokens(spark, tokens))) == before
    assert [last_token(spark, tokens, k) for k in (0, 1, 2, 3)] == [0, 3, 5, 8]


def test_tokens_and_fakes_on_one_stream(spark, feed, tmp_path, keyring):
    policy = Policy(use_reversible=True, entity_rules={"PHONE_NUMBER": EntityRule(strategy="pseudo")})
    out, at = str(tmp_path / "out"), {"dictionary": str(tmp_path / "d"), "tokens": str(tmp_path / "t")}
    texts = feed(lambda s: stream_masked_with_tables(s, out, str(tmp_path / "c"), policy, keyring=keyring, **at))
    masked, _ = mask_with_tables(scan(texts, policy), policy, keyring=keyring)
    assert _rows(spark.read.parquet(out).drop("batch_id")) == _rows(masked.select("doc_id", "source", "masked_text"))
    with pytest.raises(ValueError, match="keyring"):
        stream_masked_with_tables(texts, out, "c", policy, tokens="t")
    with pytest.raises(ValueError, match="dictionary"):
        stream_masked_with_tables(texts, out, "c", policy, tokens="t", keyring=keyring)


def test_tokens_in_a_stream_of_messages(spark, tmp_path, keyring):
    lines = ['{"result": {"content": [{"type": "text", "text": "a@b.com and c@d.com"}]}}', "no", '{"result": {"content": [{"type": "text", "text": "a@b.com"}]}}']
    for k, line in enumerate(lines):
        spark.createDataFrame([(k, line)], "msg_id bigint, line string").write.parquet(str(tmp_path / "in" / str(k)))
    out, tokens = str(tmp_path / "out"), str(tmp_path / "tokens")
    stream = spark.readStream.schema("msg_id bigint, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    stream_messages_with_tables(
        stream, out, str(tmp_path / "c"), Policy(use_reversible=True), tokens=tokens, keyring=keyring
    ).awaitTermination()
    masked = spark.read.parquet(out)
    assert not [r for r in masked.collect() if "@" in r.line]
    stored = read_stream_tokens(spark, tokens)
    assert stored.select("token").distinct().count() == stored.count() == 3
    back = restore_text(masked, stored, keyring, text="line")
    whole = sorted(json.dumps(json.loads(x), sort_keys=True) if x != "no" else x for x in (r.restored_text for r in back.collect()))
    assert whole == sorted(json.dumps(json.loads(x), sort_keys=True) if x != "no" else x for x in lines)


def values_of(spark, batch, count, span):
    rows = [(batch * 1000 + k, "EMAIL" if k % 3 else "PHONE_NUMBER", 0, f"v{(batch * span + k) % 5000}") for k in range(count)]
    return spark.createDataFrame(rows, "doc_id bigint, entity_type string, start int, text string")


def test_the_stored_dictionary_against_one_made_at_once(spark, tmp_path):
    stored = StoredDictionary(spark, str(tmp_path / "d"), bucket_rows=4)
    parts = [values_of(spark, k, 60, 40) for k in range(5)]
    for k, part in enumerate(parts):
        got = stored.extended(part, k, ("doc_id",))
        assert _rows(got.select("entity_type", "text")) == _rows(part.select("entity_type", "text").distinct())
        # a batch that runs again finds what it found before
        assert _rows(stored.extended(part, k, ("doc_id",))) == _rows(got)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    columns = ["entity_type", "text", "idx", "fake"]
    assert _rows(stored.read().select(columns)) == _rows(pseudonym_dictionary(whole).select(columns))
    largest, buckets = stored.numbers()
    assert sum(largest.values()) == stored.read().count() and buckets > 16
    assert stored.read(before=1).count() == 60


def test_a_batch_reads_what_its_values_need(spark, tmp_path):
    """Rows opened for a batch of four values, as the dictionary grows."""
    stored, opened = StoredDictionary(spark, str(tmp_path / "d"), bucket_rows=10), []

    def rows_opened(batch):
        asked = values_of(spark, batch, 4, 80)
        buckets = stored.numbers(batch)[1]
        only = [r[0] for r in asked.selectExpr(f"cast(pmod(xxhash64(entity_type, text), {buckets}) as int) b").distinct().collect()]
        return stored.read(batch, only).count()

    for k in range(4):
        stored.extended(values_of(spark, k, 80, 80), k, ("doc_id",))
        opened.append(rows_opened(k + 1))
    assert stored.read().count() == 320
    # four buckets of ten rows or so, whatever has gone before
    assert max(opened) <= 80 and opened[-1] <= 2 * max(opened[:2])
