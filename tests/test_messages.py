"""JSON messages."""

import json

import pytest

from veilwork import Policy
from veilwork.operators.messages import (
    classify_messages,
    explode_blocks,
    mask_messages,
    message_stats,
    request_methods,
)
from veilwork.sources.lines import read_messages

FULL = {
    "jsonrpc": "2.0",
    "id": 1,
    "big": 12345678901234567890,
    "result": {
        "content": [
            {"type": "text", "text": "mail a@b.com \"q\" \n é", "x": None, "n": [1, {"z": 1.5}]},
            "text a@b.com",
            {"type": "resource", "resource": {"uri": "f", "text": "SSN 123-45-6789", "k": True}},
            {"type": "image", "data": "a@b.com", "text": "a@b.com"},
            {"type": "text", "text": ""},
            {"type": "text"},
            {"type": "text", "text": 5},
            {"type": "resource", "resource": "a@b.com"},
        ],
        "_meta": {"tool_name": "t1"},
        "other": {"content": ["a@b.com"]},
    },
}
LINES = [
    json.dumps(FULL),
    "not json result a@b.com",
    json.dumps({"id": 2, "method": "tools/call", "params": {"text": "a@b.com"}}),
    json.dumps({"id": 3, "result": None}),
    json.dumps({"id": 4, "result": {"content": "a@b.com"}}),
    json.dumps(["result", "a@b.com"]),
    json.dumps("result a@b.com"),
    '{"id": 7,  "result": {"content": [{"type": "text", "text": "nothing"}]}}',
    json.dumps({"id": 8, "result": {"content": [{"type": "text", "text": "a@b.com"}], "_meta": {"tool_name": "skipped"}}}),
    '{"id": 9, "\\u0072esult": {"content": [{"type": "text", "text": "a@b.com"}]}}',
    '{"id": 9, "id": 10, "result": {"content": [{"type": "text", "text": "x", "text": "a@b.com"}]}}',
]
POLICY = Policy(source_actions={"skipped": "skip"})


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "msg_id bigint, line string")


def test_classes(table):
    rows = {r.msg_id: (r.message_class, r.tool_name) for r in classify_messages(table, POLICY).collect()}
    assert {i for i, r in rows.items() if r[0] == "candidate"} == {0, 7, 9, 10}
    assert (rows[0][1], rows[7][1], rows[8][1], rows[1][1]) == ("t1", "unknown", "skipped", None)


def test_blocks(table):
    rows = sorted((r.msg_id, r.block, r.block_type, r.text) for r in explode_blocks(table).collect())
    assert rows[:2] == [(0, 0, "text", FULL["result"]["content"][0]["text"]), (0, 2, "resource", "SSN 123-45-6789")]
    assert [r[:2] for r in rows[2:]] == [(7, 0), (8, 0), (9, 0), (10, 0)]


def _expected_full(first, second):
    out = json.loads(json.dumps(FULL))
    out["result"]["content"][0]["text"] = first
    out["result"]["content"][2]["resource"]["text"] = second
    return out


def test_masked_lines(table):
    rows = {r.msg_id: r for r in mask_messages(table, POLICY).collect()}
    assert json.loads(rows[0].masked_line) == _expected_full(
        'mail <EMAIL_REDACTED> "q" \n é', "SSN <SSN_REDACTED>"
    )
    assert json.loads(rows[9].masked_line)["result"]["content"][0]["text"] == "<EMAIL_REDACTED>"
    assert json.loads(rows[10].masked_line) == {
        "id": 10, "result": {"content": [{"type": "text", "text": "<EMAIL_REDACTED>"}]},
    }
    assert {i for i, r in rows.items() if r.modified} == {0, 9, 10}
    for i in set(rows) - {0, 9, 10}:
        assert rows[i].masked_line == LINES[i]


def test_pseudonyms_in_messages(table):
    rows = {r.msg_id: r for r in mask_messages(table, Policy(default_strategy="pseudo", source_actions={"skipped": "skip"})).collect()}
    assert json.loads(rows[0].masked_line) == _expected_full(
        'mail user_0001@anon.example "q" \n é', "SSN 000-00-0001"
    )
    assert json.loads(rows[10].masked_line)["result"]["content"][0]["text"] == "user_0001@anon.example"
    assert rows[8].masked_line == LINES[8]


def test_stats_and_methods(table):
    assert message_stats(mask_messages(table, POLICY)).first() == (len(LINES), 4, 8, 0)
    methods = {r.msg_id: r.method for r in request_methods(table).collect()}
    assert {i: m for i, m in methods.items() if m} == {2: "tools/call"}


def test_lines_from_files(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"one\n\n  \ntw\xffo\r\nlast")
    assert sorted(r.line for r in read_messages(spark, str(tmp_path)).collect()) == sorted(
        ["one", "  ", "tw�o\r", "last"]
    )
