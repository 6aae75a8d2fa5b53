"""Pseudonyms, tokens, and the joins and numbering below them."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilwork import EntityRule, Policy, scan, scan_and_mask
from veilwork.operators.detect import explode_detections
from veilwork.operators.dictionary import (
    mask_with_sha3,
    mask_with_tokens,
    merge_tokens,
    pseudonym_dictionary,
    restore_text,
    restore_tokens,
)
from veilwork.operators.lookup import lookup, with_positions

SCHEMA = "doc_id bigint, source string, text string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {}
    for i in range(400):
        # one value fills a third of all texts
        mail = "hot@example.com" if i % 3 == 0 else f"user{rng.randint(0, 60)}@example.com"
        out[i] = f"to {mail}, tel 555-123-{rng.randint(0, 50):04d} or {mail}" if i % 7 else "none"
    return out


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(i, "s", t) for i, t in texts.items()], SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def ring(spark):
    keys = [(1, bytearray(b"k" * 32)), (2, bytearray(b"q" * 32))]
    return spark.createDataFrame(keys, "key_id int, key binary")


def _expected_dictionary(table):
    found = explode_detections(scan(table)).collect()
    numbers, counters = {}, {}
    for d in sorted(found, key=lambda d: (d.doc_id, -d.start)):
        if (d.entity_type, d.text) not in numbers:
            counters[d.entity_type] = counters.get(d.entity_type, 0) + 1
            numbers[d.entity_type, d.text] = counters[d.entity_type]
    return numbers


def test_positions_are_dense_in_order(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    rows = with_positions(df, [F.desc("v")]).collect()
    assert sorted((r.position, r.v) for r in rows) == [(999 - v, v) for v in range(999, -1, -1)]


@pytest.mark.parametrize("counts", [None, "n"])
@pytest.mark.parametrize("share", [0.05, 1 / 2000])
def test_lookup_with_a_hot_key(spark, counts, share):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 100}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id int, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k1'")
    right = right.withColumn("value", F.upper("key"))
    if counts is None:
        right = right.drop("n")
    if counts is not None and share == 0.05:
        right = right.unionByName(spark.createDataFrame([("k1", 30, None)], right.schema))
    out = lookup(left, right, ["key"], counts, share).collect()
    assert sorted((r.id, r.key, r.value) for r in out) == sorted(
        (i, k, None if k == "k1" else k.upper()) for i, k in rows
    )


@pytest.mark.parametrize("known", [True, False])
def test_a_hot_key_leaves_the_shuffled_join(spark, known):
    """Its rows stay where they were, whether or not the right side knows it."""
    left = spark.range(0, 6000, 1, 6).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('k', id % 1000)) AS key"
    )
    right = left.select("key").distinct().withColumn("value", F.upper("key"))
    if not known:
        right = right.where("key <> 'hot'")
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = lookup(left, right, ["key"], share=0.05)
        placed = out.withColumn("p", F.spark_partition_id())
        sizes = [r.n for r in placed.groupBy("p").agg(F.count("*").alias("n"), F.max("value")).collect()]
        values = {(r.key, r.value) for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 6000 and max(sizes) < 1000
    assert ("hot", "HOT" if known else None) in values


def test_dictionary_follows_first_appearance(table):
    found = explode_detections(scan(table))
    rows = pseudonym_dictionary(found).collect()
    assert {(r.entity_type, r.text): r.idx for r in rows} == _expected_dictionary(table)


def test_dictionary_continues_a_known_one(table):
    found = explode_detections(scan(table))
    early, late = found.where("doc_id < 150"), found.where("doc_id >= 150")
    first = pseudonym_dictionary(early)
    second = pseudonym_dictionary(late, known=first)
    rows = first.unionByName(second).collect()
    assert {(r.entity_type, r.text): r.idx for r in rows} == _expected_dictionary(table)


def test_pseudonyms_are_consistent_and_mix_with_rules(table, texts):
    policy = Policy(
        default_strategy="pseudo", entity_rules={"PHONE_NUMBER": EntityRule(strategy="partial")}
    )
    numbers = _expected_dictionary(table)
    rows = scan_and_mask(table, policy).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        for d in reversed(r.redactions):
            fake = f"***-***-{d.text[-4:]}"
            if d.entity_type == "EMAIL":
                fake = f"user_{numbers['EMAIL', d.text]:04d}@anon.example"
            text = text[: d.start] + fake + text[d.end :]
        assert r.masked_text == text


def test_tokens_are_numbered_and_undone(table, texts, ring):
    policy = Policy(use_reversible=True)
    masked, tokens = mask_with_tokens(scan(table, policy), policy, ring)
    count, first = tokens.count(), masked.where("doc_id = 1").first()
    assert count == sum(t.count("@") + t.count("555") for t in texts.values())
    assert tokens.select("token").distinct().count() == count
    # text 0 has no values, text 1 is numbered from right to left
    assert first.masked_text == (
        "to __SHIELD_EMAIL_000003__, tel __SHIELD_PHONE_NUMBER_000002__ or __SHIELD_EMAIL_000001__"
    )
    back = restore_text(masked.select("doc_id", "masked_text"), tokens, ring, text="masked_text")
    assert {r.doc_id: r.restored_text for r in back.collect()} == texts


def test_tokens_that_cannot_be_resolved_stay(spark, table, ring):
    policy = Policy(use_reversible=True)
    _, tokens = mask_with_tokens(scan(table.where("doc_id = 1"), policy), policy, ring)
    text = "a __SHIELD_EMAIL_000001__ b __SHIELD_EMAIL_999999____SHIELD_NO__SHIELD_EMAIL_000003__"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id bigint, text string")
    rows = {r.doc_id: r.restored_text for r in restore_text(df, tokens, ring).collect()}
    original = {r.token: r.original for r in restore_tokens(tokens.select("token"), tokens, ring).collect()}
    assert rows == {
        1: text.replace("__SHIELD_EMAIL_000001__", original["__SHIELD_EMAIL_000001__"]).replace(
            "__SHIELD_EMAIL_000003__", original["__SHIELD_EMAIL_000003__"]
        ),
        2: None,
        3: "plain",
    }
    wrong = ring.where("key_id = 2").withColumn("key_id", F.lit(1))
    for keys in (wrong, ring.where("key_id = 2")):
        restored = restore_tokens(tokens.select("token"), tokens, keys)
        assert restored.where("original is not null").count() == 0
        assert restore_text(df, tokens, keys).where("doc_id = 1").first().restored_text == text


def test_tokens_without_a_key_fall_back(table):
    policy = Policy(use_reversible=True)
    masked, tokens = mask_with_tokens(scan(table.where("doc_id = 1"), policy), policy)
    assert tokens is None
    assert masked.first().masked_text == (
        "to <EMAIL_REDACTED>, tel <PHONE_NUMBER_REDACTED> or <EMAIL_REDACTED>"
    )


def test_ciphertext_is_repeatable_and_key_is_not_in_the_plan(table, ring):
    policy = Policy(use_reversible=True)
    _, tokens = mask_with_tokens(scan(table, policy), policy, ring)
    assert sorted(tokens.collect()) == sorted(tokens.collect())
    nonces = tokens.select(F.substring("ciphertext", 1, 12)).distinct().count()
    assert nonces == tokens.count()
    assert "kkkk" not in tokens._jdf.queryExecution().toString()


def test_later_tokens_win(spark):
    schema = "token string, entity_type string, key_id int"
    old = spark.createDataFrame([("a", "X", 1), ("b", "X", 1)], schema)
    new = spark.createDataFrame([("b", "Y", 2), ("c", "Y", 2)], schema)
    assert sorted(map(tuple, merge_tokens(old, new).collect())) == [
        ("a", "X", 1), ("b", "Y", 2), ("c", "Y", 2),
    ]


def test_sha3(table, texts):
    for r in mask_with_sha3(scan(table), salt="s").collect():
        text = texts[r.doc_id]
        for d in reversed(r.redactions):
            digest = hashlib.sha3_256(("s" + d.text).encode()).hexdigest()[:16]
            text = text[: d.start] + f"SHA3_256:{digest}" + text[d.end :]
        assert r.masked_text == text
