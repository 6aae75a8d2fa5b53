import random
import re
import zlib
from collections import Counter

import pytest

from veilwork.llm.fm_index import WordIndex
from veilwork.llm.queries import QUERIES
from veilwork.llm.spelling import search, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(rows, least_chars=7, least_count=2, times=10, every=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    gaps = {}
    for w in words:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} if len(w) < 200 else {w}:
            gaps.setdefault(v, set()).add(w)
    long = [w for w in words if len(w) >= 199]
    out = {}
    for w, n in words.items():
        around = {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} if len(w) < 200 else {w}
        near = {v for g in around for v in gaps.get(g, ())} | set(long if len(w) >= 199 else ())
        near = [v for v in near if one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= times * n else None
        out[w] = (form, n, len(near), words.get(form))

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return sorted((w, f, root(w), n, near, form_n) for w, (f, n, near, form_n) in out.items())


def got(df, **how):
    return sorted(map(tuple, spelling_variants(df, **how).collect()))


def vocabulary(seed, size, letters="ab", low=1, high=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(size)})


@pytest.mark.parametrize("seed, letters, low, high", [(1, "ab", 1, 9), (2, "abcé", 2, 8), (3, "a", 1, 40), (4, "abcdefghij", 7, 7)])
def test_index_against_all_pairs(seed, letters, low, high):
    words = vocabulary(seed, 400, letters, low, high)
    indexed = words[:: 2] + words[1::4]
    asked = words[::3] + ["zzz", "azb", "ab" * 30]
    found = []
    for first_half in (True, False):
        for which, number in search(indexed, asked, first_half):
            found += [(asked[w], indexed[v]) for w, v in zip(which.tolist(), number.tolist())]
    assert len(found) == len(set(found))
    assert set(found) == {(w, v) for w in asked for v in indexed if one_edit(w, v)}


def test_index_of_one_word_and_of_too_many_letters():
    assert [x.tolist() for x in WordIndex(["abcdefg"]).near(["abcdefh", "abcdefg"], True)] == [[0], [0]]
    with pytest.raises(ValueError):
        WordIndex([chr(k) for k in range(300, 600)])


def texts(seed, letters="abcdé"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 11))) for _ in range(25)]
    rows = []
    for doc in range(60):
        words = []
        for _ in range(r.randint(0, 40)):
            w = base[min(int(r.expovariate(0.3)), 24)]
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", r.choice(letters), w[k] + r.choice(letters)]) + w[k + 1 :]
            words.append(r.choice([w, w.upper(), w.title()]))
        rows.append((doc * 7 % 61, r.choice([" ", ", ", "1"]).join(words)))
    return rows


# a block of 3 cuts every key into blocks that meet in pairs
@pytest.mark.parametrize("seed, how", [
    (1, {}), (2, {"block": 3}), (3, {"times": 2, "least_chars": 4, "block": 20}),
    (4, {"slip_every": 0, "least_count": 1, "times": 3}), (5, {"least_chars": 1, "least_count": 1, "times": 2}),
])
def test_against_all_pairs(spark, seed, how):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = plain(rows, **{{"slip_every": "every"}.get(k, k): v for k, v in how.items() if k != "block"})
    assert expected and got(df, **how) == expected


def test_edge_rows(spark):
    long = "abcdefghij" * 600
    rows = [
        (1, "GARDENS gardens ÉGARDEN égarden" + " gardene" * 30), (1, "GARDENS gardens"), (None, "Gardens gardenes " * 2), (3, None),
        (None, None), (4, ""), (5, "a b 123 ×÷×÷×÷×÷ ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ"), (6, f"{long} {long}"), (7, f"{long}x {long}x"),
        (8, "a" * 6000 + " " + "A" * 6000 + " " + "a" * 5999), (9, "a" * 5999),
    ]
    df = spark.createDataFrame([(d, t, "w", 5, 1) for d, t in rows], "doc_id bigint, text string, word string, n int, part int")
    assert got(df) == plain(rows)
    assert spelling_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, times=1)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_spelling_variants"](spark, f"/root/testdata/sf{sf}")
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain(rows)
    assert any(e[1] for e in expected)
    assert sorted(map(tuple, found.collect())) == expected
