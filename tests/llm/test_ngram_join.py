import random

import pytest
from brute import components

from veilwork.llm.base import min_labels
from veilwork.llm.ngram_join import similar_components
from veilwork.llm.queries import QUERIES


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = spark.range(300)
    got = {r.id: r.component for r in min_labels(nodes, df).collect()}
    expected = {k: 0 if k <= 40 else 100 if 100 <= k < 130 else 200 if k in (200, 201) else k for k in range(300)}
    assert got == expected


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for group in range(12):
        base = [r.choice(words) for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(1, 25)):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(text))
                text[k : k + r.randint(0, 2)] = [r.choice(words)]
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_all_pairs(spark, seed, size, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, similar_components(df, words=size, percent=percent).collect()))
    assert got == components(rows, size, percent)


def test_edge_rows(spark):
    rows = [
        (4, "a b", 1),
        (4, "a b", 1),
        (3, "A\tB", 1),
        (9, None, 1),
        (8, "", 1),
        (None, "a b", 1),
        (None, None, 1),
        (None, "only here", 1),
        (2, "a b c", 1),
        (5, "x " * 20000, 1),
        (6, "X " * 20000, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    got = sorted(map(tuple, similar_components(df).collect()), key=str)
    expected = [
        (4, 1, 3), (4, 1, 3), (3, 1, 3), (9, 0, 9), (8, 0, 8), (None, 1, 3), (None, 0, None),
        (None, 1, None), (2, 1, 2), (5, 1, 5), (6, 1, 5),
    ]
    assert got == sorted(expected, key=str)
    assert similar_components(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op4_ngram_jaccard_join"](spark, sf).collect()))
    assert got == components(rows, 4, 85)
