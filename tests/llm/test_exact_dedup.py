import hashlib
import os
import re
import tempfile

from veilwork.llm.exact_dedup import ContentTable, exact_duplicates, grace


def record(text, first, n=1):
    return [hashlib.sha256(text.encode()).digest(), text, False, first, first, n]


def test_spills_recursively_and_cleans_up(tmp_path, monkeypatch):
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    texts = [f"text {k % 300} " * 20 for k in range(1500)]
    got = list(grace(iter([record(t, k) for k, t in enumerate(texts)]), 2000))
    assert sorted((r[3], r[5]) for r in got) == [(k, 5) for k in range(300)]
    assert os.listdir(tmp_path) == []


def test_equal_digests_of_different_contents_stay_apart():
    table = ContentTable()
    for k in range(3000):
        table.add([bytes(32), f"content {k % 7}", False, k, k, 1])
    assert sorted(r[3] for r in table.records) == list(range(7))


def test_edge_rows(spark):
    rows = [
        (5, "a  b", "x"),
        (3, "a\tb", "y"),
        (3, "a \n b", "z"),
        (None, "a b", "n"),
        (9, None, None),
        (8, "", "e"),
        (7, " ", "s"),
        (None, "lonely", None),
        (1, "a b", None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    got = exact_duplicates(df, memory_bytes=500).collect()
    assert len(got) == len(rows)
    group = [r for r in got if r.text_sha256 == hashlib.sha256(b"a b").hexdigest()]
    assert [(r.keep_id, r.group_size) for r in group] == [(3, 4)] * 4
    assert sorted((str(r.doc_id), r.kept) for r in group) == [("3", False), ("3", True), ("5", False), ("None", False)]
    others = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r not in group}
    assert others == {(9, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True), (None, None, 1, True), (1, 1, 1, True)}
    assert exact_duplicates(df.limit(0)).count() == 0


def test_a_text_in_a_third_of_all_rows(spark):
    df = spark.range(6000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'hot text', concat('t', cast(id div 2 AS string))) AS text"
    )
    got = exact_duplicates(df.repartition(5)).toPandas().set_index("doc_id").sort_index()
    pdf = df.toPandas().set_index("doc_id").sort_index()
    smallest = pdf.reset_index().groupby("text").doc_id.agg(["min", "size"])
    assert (got.keep_id == pdf.text.map(smallest["min"])).all()
    assert (got.group_size == pdf.text.map(smallest["size"])).all()
    assert (got.kept == (got.keep_id == got.index)).all()
    assert re.fullmatch("[0-9a-f]{64}", got.text_sha256[0])
