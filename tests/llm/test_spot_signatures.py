import hashlib
import re

import pytest
from pyspark.sql import functions as F

from veilwork.llm.spot_signatures import ANCHORS, edited_fingerprints, likeness, spots
from veilwork.llm.queries import QUERIES


def brute_spots(text, chain=2):
    words = re.findall(r"[^\W_]+", text.lower())
    out = []
    for k, w in enumerate(words):
        if w in ANCHORS and k + 1 < len(words) and words[k + 1] not in ANCHORS:
            content = [x for x in words[k + 1 :] if x not in ANCHORS][:chain]
            if len(content) == chain:
                out.append(" ".join([w, *content]))
    return set(out) or set(words)


def edits(rows):
    """{doc_id: (n, edited, next text)} for (id, text) rows with distinct ids."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0]))
    out = {}
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        out[doc] = (len(text), text[: len(text) - cut] + after[:cut], after)
    return out


def jaccard(a, b):
    a, b = brute_spots(a), brute_spots(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


TEXTS = [
    "The cat of the house is a very old, old cat of the of the the end",
    "the the the of of",
    "no spots here",
    "",
    "... !!",
    "Der Hund und die Katze; und der große Hund 😀 x",
    "the " * 30000 + "cat ran",
    "theory often andy a",
]


def test_spots_against_brute_force(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    for r in df.select("k", spots(F.col("text")).alias("s")).collect():
        expected = brute_spots(TEXTS[r.k])
        hashes = spark.createDataFrame([(x,) for x in expected], "x string").select(F.hash("x")).collect()
        assert r.s == sorted(h[0] for h in hashes)


def test_pruning_changes_nothing_above_the_threshold(spark):
    sets = [list(range(n)) for n in (0, 1, 2, 7, 8, 9, 10, 11, 30)]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<int>, b array<int>")
    for r in df.select("a", "b", likeness(F.col("a"), F.col("b")).alias("x"), likeness(F.col("a"), F.col("b"), 0.8).alias("y")).collect():
        union = len(set(r.a) | set(r.b))
        real = len(set(r.a) & set(r.b)) / union if union else 1.0
        assert r.x == pytest.approx(real)
        assert r.y == (pytest.approx(real) if real >= 0.8 else pytest.approx(0.0))


def check(rows, got):
    expected, texts = edits(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        n, edited, after = expected[r.doc_id]
        own = texts[r.doc_id] or ""
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(own, edited))
        assert r.near_next == pytest.approx(jaccard(own, after))
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)


def test_edge_rows(spark):
    rows = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(None, "the last one of all"), (100, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).repartition(3)
    check(rows, edited_fingerprints(df).collect())
    one = edited_fingerprints(df.where("doc_id = 0")).collect()
    check(rows[:1], one)
    twice = df.where("doc_id = 0").union(df.where("doc_id = 0"))
    assert [r.fingerprint for r in edited_fingerprints(twice).collect()] == [one[0].fingerprint] * 2
    assert edited_fingerprints(df.limit(0)).count() == 0


def test_query_against_brute_force_and_plan_without_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = QUERIES["op6_spot_fingerprints"](spark, sf)
    check(rows, df.collect())
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert not re.search("Python|Arrow|Pandas", plan)
    # both uses of the texts read one shuffle of them
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan") : final.index("Initial Plan")]
    assert len(re.findall(r"partial_first\(text", final)) == 1
