import random

import pytest
from brute import sha, without_repeated
from hypothesis import given, settings
from hypothesis import strategies as st

import veilwork.llm.substring_dedup as sd
from veilwork.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=5), st.text("abc", max_size=15))
def test_matching_statistics(texts, query):
    automaton = sd.SuffixAutomaton()
    for t in texts:
        automaton.add(list(t))
    expected = [
        max(n for n in range(k + 1) if any(query[k - n : k] in t for t in texts) or n == 0)
        for k in range(1, len(query) + 1)
    ]
    assert list(automaton.matches(list(query))) == expected


def table(seed, count=120):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 40))] for _ in range(6)]
    rows = []
    for k in range(count):
        words = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            b = r.randint(0, len(p))
            words += p[b : b + r.randint(0, 40)] + [str(r.randint(0, 9)) for _ in range(r.randint(0, 6))]
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    if hot:  # all shared anchors are cut into windows, some of them decided at once
        monkeypatch.setattr(sd, "HOT_LEAST", 3)
        monkeypatch.setattr(sd, "HOT_WINDOWS", 20)
    rows = table(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, sd.remove_repeated(df).collect()))
    expected = sorted(without_repeated(rows))
    assert sum(r[2] for r in expected) > 200
    assert got == expected


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [
        (5, long, 0),
        (5, long, 0),
        (7, long.replace(" ", "\n", 3) + " tail", 0),
        (None, long, 0),
        (None, long, 0),
        (6, None, 0),
        (8, "", 0),
        (9, "é x " * 30, 0),
        (10, long.upper(), 0),
        (11, " ".join(f"w{k}" for k in range(12)), 0),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = sorted(map(tuple, sd.remove_repeated(df).collect()), key=str)
    assert got == sorted(without_repeated([r[:2] for r in rows]), key=str)
    assert sd.remove_repeated(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = sorted((d, n, g, sha(t)) for d, n, g, t in without_repeated(rows))
    assert sorted(map(tuple, QUERIES["op10_substring_dedup"](spark, sf).collect())) == expected
