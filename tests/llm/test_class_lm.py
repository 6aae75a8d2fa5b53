import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import veilwork.llm.class_lm as lm
from veilwork.llm.queries import QUERIES


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [""]


def base_scores(rows, trains):
    counts = Counter(t for doc, text in rows if trains(doc) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for doc, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        out[doc] = (len(own), sum(counts[t] > 0 for t in own), total, base)
    return out


def test_query_against_brute_force_and_better_than_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    trains = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    expected = base_scores(rows, trains)
    got = QUERIES["op8_class_lm_scores"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, not trains(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    text = "the cat sat the dog sat a cat ran the end a dog"
    rows = spark.createDataFrame([(text,), ("a cat",), ("ran dog x",)], "text string")
    model, counts, word, n = lm.train(rows, classes=4)
    units, class_of = model.units, model.class_of
    words = sorted({t for r in rows.collect() for t in tokens(r.text)} - {""})
    known = np.zeros(4)
    known[class_of[units.end]] += 1.0
    for w in words:
        whole, ending = lm._WORDS.hashes(w)
        c = class_of[units.of(whole, ending)][0]
        known[c] += n[np.searchsorted(word, whole[0])] * 10 ** model.known[c]
    within = known + 10**model.unknown
    used = np.bincount(class_of, minlength=4) > 0
    has = np.isin(np.arange(4), [class_of[units.of(*lm._WORDS.hashes(w))][0] for w in words] + [class_of[units.end]])
    assert within[used & has] == pytest.approx(1.0)
    assert (10**model.step).sum(1) == pytest.approx(1.0)


def test_words_not_at_hand_count_the_same(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["a b c a b", "b c d", "q", "a a a zz", "zz b", None] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    training = F.col("doc_id") % 3 != 0

    def run():
        return {r.doc_id: tuple(r)[1:] for r in lm.score_texts(df, training).collect()}

    whole = run()
    monkeypatch.setattr(lm, "WORDS_AT_HAND", 2)
    few = run()
    expected = base_scores(rows, lambda d: d % 3 != 0)
    for doc, (n, known, total, base, _, _) in few.items():
        assert (n, known, total) == expected[doc][:3]
        assert base == pytest.approx(expected[doc][3])
        assert whole[doc][3] == pytest.approx(base)


def test_edge_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (None, "", 0), (2, "x " * 20000, 0), (3, "Été\x0bA a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    got = lm.score_texts(df, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 4, 20001]
    assert all(r.n_known == r.n_tokens and r.score <= 0 for r in got)
    nothing = lm.score_texts(df, F.lit(False)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.score == r.base_score for r in nothing)
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_sweeps_go_on_until_the_likelihood_stops_rising(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(lm.whole_text().alias("text"))
    model, *_ = lm.train(docs, classes=16)
    units, class_of = model.units, model.class_of
    end = np.array([units.end])
    texts = [np.concatenate([units.of(*lm._WORDS.hashes(r.text)), end]) for r in docs.collect()]
    joined = np.concatenate([end, *texts])
    left, right = joined[:-1], joined[1:]

    def table(assigned):
        counts = np.zeros((units.count, 32), np.int64)
        np.add.at(counts, (right, assigned[left]), 1)
        np.add.at(counts, (left, 16 + assigned[right]), 1)
        return counts

    def value(assigned):
        pairs = Counter(zip(assigned[left].tolist(), assigned[right].tolist()))
        sizes = Counter(assigned[left].tolist())
        return sum(n * math.log(n / (sizes[a] * sizes[b])) for (a, b), n in pairs.items())

    moved = lm.exchange(table(class_of), class_of, 16, units.end)
    assert (moved == class_of).all() or value(moved) <= value(class_of) + 1e-6


def test_what_is_learned_of_words_is_not_copied_for_each_text():
    words, asked = lm.Words(), []

    def compute(whole, ending):
        asked.append(len(whole))
        return whole % 7

    for k in range(2000):
        words.hashes(f"w{k} w{k // 2}")
        numbers = np.array([words[f"w{k}".encode()], words[f"w{k // 2}".encode()]])
        assert (words.values(compute, numbers) == words.whole[numbers] % 7).all()
    held = words.learned[compute][0]
    words.hashes("another")
    words.values(compute, np.array([0]))
    assert words.learned[compute][0] is held
    assert sum(asked) == len(words)


def test_sweeps_read_packed_pairs(spark):
    rows = spark.createDataFrame([("a b a c",), ("b a",), ("",)], "text string")
    words = lm._count_words(rows).toPandas()
    units = lm.Units(words["word"].to_numpy(), np.empty(0, np.int64))
    pairs = lm._bigrams(rows, units)
    packed = lm._packed(pairs.coalesce(1))
    # one row for all, where each pair was a row on its way to Python
    assert packed.count() == 1 < pairs.count()
    class_of = np.arange(units.count)
    table = lm._neighbours(packed, units, class_of, units.count)
    expected = np.zeros((units.count, 2 * units.count), np.int64)
    for r in pairs.collect():
        expected[r["right"], r["left"]] += r["n"]
        expected[r["left"], units.count + r["right"]] += r["n"]
    assert (table == expected).all() and table.sum() == 2 * (6 + 3)


def test_pairs_leave_a_task_packed_and_are_added_up_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS_AT_ONCE", 3)
    rows = spark.createDataFrame([("a b a c",), ("b a b a",), ("",), ("a b",)] * 5, "text string").repartition(4)
    words = lm._count_words(rows).toPandas()
    units = lm.Units(words["word"].to_numpy(), np.empty(0, np.int64))
    packed = lm._packed_bigrams(rows, units)
    assert dict(packed.dtypes) == {"left": "binary", "right": "binary", "n": "binary"}
    # no row of the shuffle is a pair: nothing is added up by Spark, pair by pair
    assert "HashAggregate" not in packed._jdf.queryExecution().toString()
    found = [(r["left"], r["right"], r["n"]) for r in lm._bigrams(rows, units).collect()]
    number = dict(zip(words["word"], units.of(words["word"].to_numpy(), words["ending"].to_numpy())))
    a, b, c = (int(number[lm.Words().hashes(w)[0][0]]) for w in "abc")
    e = units.end
    assert sorted(found) == sorted(
        [(e, a, 10), (a, b, 15), (b, a, 15), (a, c, 5), (c, e, 5), (e, b, 5), (a, e, 5), (b, e, 5), (e, e, 5)]
    )
