import zlib

import numpy as np
from pyspark.sql import functions as F

from veilwork.llm.language_id import _NO_LETTER, identify, profiles, ranked
from veilwork.llm.queries import QUERIES


def brute_ranks(text, size):
    plain = _NO_LETTER.sub(" ", f" {text.lower()} ")
    counts = {}
    for n in (1, 2, 3):
        for k in range(len(plain) - n + 1):
            gram = plain[k : k + n]
            if gram != " ":
                counts[gram] = counts.get(gram, 0) + 1
    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]]


def test_ranks_against_brute_force():
    for text in ("the cat and the hat", "Straße über alles; é", "x" * 50, "😀 日本語 ab"):
        assert ranked(text, 30).tolist() == brute_ranks(text, 30)


def test_profiles_and_distances_against_brute_force(spark):
    rows = [(1, "aaa bbb aab", "x"), (2, "ccc ccd", "y"), (3, "aab", None), (4, "ccd", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {}
    for r in profiles(df, "text", "lang", 10).orderBy("lang", "place").collect():
        learned.setdefault(r.lang, []).append(r.code)
    assert learned == {"x": brute_ranks("aaa bbb aab   ccd", 10), "y": brute_ranks("ccc ccd", 10)}
    for r in identify(df, F.lit(True), size=10).collect():
        mine = brute_ranks(rows[r.doc_id - 1][1], 10)
        distance = {
            lang: sum(abs(p.index(g) - k) if g in p else 10 for k, g in enumerate(mine)) for lang, p in learned.items()
        }
        best = min(sorted(distance), key=distance.get)
        assert r.lang_pred == best
        assert abs(r.score - (1 - distance[best] / (10 * len(mine)))) < 1e-12


def test_edge_rows(spark):
    rows = [(1, None, "en", 0), (1, None, "en", 0), (None, "", None, 0), (3, "123 --- 😀", "en", 0), (4, "the cat", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in identify(df, F.lit(True)).collect()}
    assert got == {(1, "und"), (None, "und"), (3, "und"), (4, "en")}
    nothing = identify(df, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert identify(df.limit(0), F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_language_id"](spark, sf).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert len(right) > 200 and np.mean(right) > 0.97
