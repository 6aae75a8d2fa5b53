"""Texts found in the bytes of a message, against Python's own JSON reader."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork import Policy
from veilwork.functions.json_splice import find_blocks, with_texts
from veilwork.operators.messages import classify_messages, explode_blocks, mask_messages, mask_messages_reversibly

MAIL = "john@example.com"


def plain_blocks(line):
    """(kinds, texts) by reading the whole line; None without a list of content."""
    try:
        message = json.loads(line)
        content = message["result"]["content"]
    except (ValueError, KeyError, TypeError):
        return None
    if not isinstance(content, list):
        return None
    texts = []
    for block in content:
        text = None
        if isinstance(block, dict):
            holder = {"text": block, "resource": block.get("resource")}.get(block.get("type") if isinstance(block.get("type"), str) else None)
            text = holder.get("text") if isinstance(holder, dict) else None
        texts.append(text if isinstance(text, str) and text else None)
    return texts


words = st.text(st.sampled_from('ab"\\/é😀\n\t{}[]:,0'), max_size=8)
scalars = st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), words)
anything = st.recursive(scalars, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(words, c, max_size=3)), max_leaves=8)
blocks = st.one_of(
    anything,
    st.fixed_dictionaries({"type": st.sampled_from(["text", "resource", "image", 5])}, optional={"text": st.one_of(words, anything), "resource": st.one_of(anything, st.fixed_dictionaries({"text": words}, optional={"uri": words}))}),
)
results = st.one_of(anything, st.fixed_dictionaries({"content": st.one_of(anything, st.lists(blocks, max_size=4))}, optional={"_meta": st.one_of(anything, st.fixed_dictionaries({"tool_name": words}))}))
messages = st.one_of(anything, st.fixed_dictionaries({"result": results}, optional={"id": scalars, "x": anything}))


@settings(max_examples=400, deadline=None)
@given(messages, st.booleans(), st.sampled_from([None, 1]))
def test_texts_and_splices(message, ascii_only, indent):
    line = json.dumps(message, ensure_ascii=ascii_only, indent=indent).encode()
    found, expected = find_blocks(line), plain_blocks(line)
    assert (found is None) == (expected is None)
    if found is None:
        return
    assert found.texts == expected
    new = [None if t is None else f'new "{t}" \n' for t in found.texts]
    changed = json.loads(with_texts(line, found.starts, found.ends, new, found.dead))
    assert plain_blocks(json.dumps(changed)) == new
    assert with_texts(line, found.starts, found.ends, [None] * len(new), []) == line


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from('{}[]:,"\\ a1-.e0tru\n'), max_size=14))
def test_what_is_no_json(text):
    line = f'{{"result": {{"content": [{{"type": "text", "text": "t", "x": {text}}}]}}}}'
    try:
        json.loads(line)
        valid = True
    except ValueError:
        valid = False
    assert (find_blocks(line.encode()) is not None) == valid


def test_the_last_of_repeated_keys_counts():
    line = b'{"result": {"content": [{"type": "text", "text": "old"}]}, "result": {"content": [{"type": "image", "type": "text", "text": "a", "text": "b"}]}}'
    found = find_blocks(line)
    assert (found.kinds, found.texts) == (["text"], ["b"])
    changed = with_texts(line, found.starts, found.ends, ["c"], found.dead)
    assert b"old" not in changed and json.loads(changed) == {"result": {"content": [{"type": "text", "text": "c"}]}}


def test_deep_nesting_and_odd_tools():
    deep = b'{"x": ' + b"[" * 50_000 + b"]" * 50_000 + b', "result": {"_meta": {"tool_name": 5}, "content": [7, {"type": "text", "text": "\\ud83d\\ude00"}]}}'
    found = find_blocks(deep)
    assert (found.tool, found.texts) == ("5", [None, "😀"])
    assert find_blocks(b"") is None and find_blocks(b'{"result": {"content": {}}}') is None


def test_a_line_of_forty_megabytes(spark):
    """Written by Spark from a short one, masked in place, and otherwise equal to the byte."""
    row = spark.createDataFrame([(1, "s")], "msg_id bigint, tool string").select(
        "msg_id",
        F.concat(
            F.lit('{"id":  1, "pad": "'), F.repeat(F.lit("pädding "), 2_600_000), F.lit('", "list": ['), F.repeat(F.lit("1, "), 3_000_000),
            F.lit('2], "result": { "_meta": {"tool_name": "s"}, "content": [{"type":"text", "text": "mail ' + MAIL + ' \\u00e9"}, {"type": "text", "text": "'),
            F.repeat(F.lit("word "), 2_000_000), F.lit('"}]}}'),
        ).alias("line"),
    )
    masked = mask_messages(row)
    hidden = F.replace("line", F.lit(f'"mail {MAIL} \\u00e9"'), F.lit('"mail <EMAIL_REDACTED> é"'))
    got = masked.select(
        F.octet_length("line").alias("size"), "source", "modified", "blocks_with_pii", (F.col("masked_line") == hidden).alias("same")
    ).first()
    assert got.size > 40_000_000
    assert tuple(got)[1:] == ("s", True, 1, True)
    assert [tuple(r) for r in classify_messages(row).select("message_class", "tool_name").collect()] == [("candidate", "s")]
    assert [r.block for r in explode_blocks(row).collect()] == [0, 1]


@pytest.mark.parametrize("policy", [Policy(), Policy(default_strategy="pseudo"), Policy(use_reversible=True)])
def test_both_ways_give_the_same_messages(spark, policy):
    lines = [
        '{"result": {"_meta": {"tool_name": "t"}, "content": [{"type": "text", "text": "x %s"}, 5, {"type": "resource", "resource": {"text": "tel 555-123-4567", "uri": "f"}}]}}' % MAIL,
        '{"result": {"content": [{"type": "text", "text": "nothing"}]}}', '{"result": {"content": 5}}', "no", '{"result": ', '{"result": null}', None,
        '{"result": {"content": [{"type": "text", "text": "old", "text": "%s"}]}}' % MAIL,
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "msg_id bigint, line string")
    ring = spark.createDataFrame([(1, bytearray(b"0123456789abcdef"))], "key_id int, key binary")

    def rows(longest):
        masked, _ = mask_messages_reversibly(df, policy, ring, longest=longest)
        return {r.msg_id: (r.source, r.scanned, r.modified, r.block_masked, r.masked_line) for r in masked.collect()}

    short, long = rows(1000), rows(0)
    for k, line in enumerate(lines):
        # a null line has no length, so it is read in SQL
        assert short[k][2:4] == long[k][2:4]
        assert (short[k][4] == long[k][4] == line) if not short[k][2] else json.loads(short[k][4]) == json.loads(long[k][4])
        assert MAIL not in (long[k][4] or "")
