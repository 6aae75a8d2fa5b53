import re

from veilwork.llm.license_scan import BASE_PHRASES, parse_expression, permits, scan_licenses
from veilwork.llm.queries import QUERIES


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


TEXTS = [
    None,
    "",
    "MIT License mit-license mit license\nCC BY, cc.by",
    "gnu general public license gnu general public license apache license",
    "İ mit　license mit license \x85 K cc by",
    "permit license mit licenses cc bye",
    "-- " * 50,
    "mit license " * 3000,
]


def test_base_columns_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, labels int")
    for r in scan_licenses(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_expressions():
    assert parse_expression(" MIT OR Apache-2.0 AND BSD-3-Clause")[0] == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse_expression("(MIT OR GPL-2.0-only) WITH x AND ISC")[0] == ["mit", "gpl-2.0-only", "or", "x", "with", "isc", "and"]
    assert parse_expression("GPL-2.0 WITH Classpath-exception-2.0")[1] == ["gpl-2.0"]
    assert parse_expression("and mit") is None
    assert parse_expression("(mit") is None
    assert parse_expression("") is None
    assert parse_expression("MIT */ more")[0] == ["mit"]
    assert permits(["mit", "gpl-3.0", "or"]) and not permits(["mit", "gpl-3.0", "and"])


def test_tags_add_labels_and_base_stays(spark):
    text = "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nApache License\n"
    r = scan_licenses(spark.createDataFrame([(None, text)], "doc_id bigint, text string")).first()
    assert (r.base_labels, r.labels, r.permissive, r.doc_id) == ("apache", "apache,gpl,mit", True, None)
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_license_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]) for r in got)
    assert any(r.n_base for r in got)
