import math

import numpy as np
import pytest

from veilwork.llm.queries import QUERIES
from veilwork.llm.whitening import leading_eigenpairs, packed, unpacked, whiten
import pyarrow as pa


def plain(rows, wanted=4):
    """{(id, k-th row of it, component): (n, deviation, whitened up to sign, explained)}, by a dense solver."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v):
            kept.append((key, tuple(math.floor(256 * c) for c in v)))
    distinct = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(distinct), distinct.sum(0)
    centred = (distinct - sums / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for key, x in kept:
        deviation = int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))
        y = (np.array(x, float) - (sums / n).astype(float)) @ vectors
        for k in range(min(wanted, len(values))):
            out.append((key, k + 1, n, deviation, y[k] / math.sqrt(values[k]), values[k] / np.trace(cov)))
    return out, values


def compare(found, rows, wanted=4):
    expected, values = plain(rows, wanted)
    got = [tuple(r) for r in found.collect()]
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, (r[:4] for r in expected)))
    for k in range(1, wanted + 1):
        ours = sorted((str(r[0]), r[3], r[4]) for r in got if r[1] == k)
        theirs = sorted((str(r[0]), r[3], r[4]) for r in expected if r[1] == k)
        a, b = np.array([r[2] for r in ours]), np.array([r[2] for r in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        share = [r for r in got if r[1] == k][0][5]
        assert share == pytest.approx([r for r in expected if r[1] == k][0][5], rel=1e-9)
    assert all(r[6] <= 1e-9 for r in got) and len({r[6] for r in got}) <= 1


def vectors(seed, count, dimension):
    r = np.random.default_rng(seed)
    x = r.standard_normal((count, dimension)) * np.linspace(1.5, 0.2, dimension)
    x[::7] = x[0]  # copies
    return [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]


@pytest.mark.parametrize("seed, count, dimension", [(1, 300, 6), (2, 500, 40), (3, 900, 70)])
def test_against_a_dense_solver(spark, seed, count, dimension):
    rows = vectors(seed, count, dimension)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    compare(whiten(df), rows)


def test_more_than_the_first_components(spark):
    rows = vectors(4, 400, 12)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    compare(whiten(df, components=7), rows, 7)


@pytest.mark.parametrize("shape", ["flat", "steep", "pairs", "far"])
def test_iteration_on_hard_spectra(shape):
    d = 120
    values = {
        "flat": np.linspace(1.02, 1.0, d),
        "steep": 10.0 ** -np.linspace(0, 12, d),
        "pairs": np.repeat(np.linspace(2, 1, d // 2), 2),
        "far": np.r_[1e6, 1e3, np.linspace(1.3, 1.0, d - 2)],
    }[shape]
    turn = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]
    matrix = turn * values @ turn.T
    matrix = (matrix + matrix.T) / 2
    found = leading_eigenpairs(lambda b: matrix @ b, d, 4)
    assert found.values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][:4], rel=1e-9, abs=1e-12 * values[0])
    assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12
    assert (found.residuals <= 1e-10 * values[0]).all()


def test_packing_round_trip():
    x = np.array([[0, -128, 127], [0, 128, 1], [-(1 << 15) - 1, 0, 0], [(1 << 63) - 1, -(1 << 63), 5], [0, -129, 127]])
    held = packed(x)
    assert len({len(h) for h in held}) == 4
    back = np.vstack(list(unpacked(pa.array(held), 3)))
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, x.tolist()))


def test_edge_rows(spark):
    good = [[0.5, 0.25, -0.1], [0.1, 0.9, 0.3], [-0.7, 0.2, 0.6], [0.3, -0.4, 0.8], [0.11, 0.5, 0.52]]
    rows = [(k, v) for k, v in enumerate(good)] + [
        (0, good[1]), (None, good[2]), (7, None), (8, []), (9, [1.0, None, 2.0]), (10, [1.0, float("nan"), 2.0]),
        (11, [float("inf"), 0.0, 0.0]), (12, [1.0, 2.0]), (13, [0.0, -0.0, 1e-9]),
    ]
    df = spark.createDataFrame([(k, v, 1, "x", 2) for k, v in rows], "vec_id bigint, embedding array<float>, n int, x string, component int")
    fitting = [(k, v) for k, v in rows if v is None or len(v) != 2]
    fitting = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in fitting]
    compare(whiten(df), fitting, 3)
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("vec_id IN (7, 8, 9, 10)")).collect() == []


def test_no_variance_and_too_large_numbers(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, whiten(same).collect()))
    assert got == [(k, c, 1, 0, None, None, None) for k in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], "vec_id bigint, embedding array<double>")
    got = whiten(line).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in got] == [False, True, True] * 5
    assert [r.explained for r in got[:3]] == pytest.approx([1, 0, 0], abs=1e-12)
    large = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    got = whiten(large).where("component = 1").orderBy("vec_id").collect()
    # the saturated numbers add up to -1
    assert [r.deviation for r in got] == [None, None, 1 + 1280**2] and got[0].n == 3


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_a_dense_solver(spark, sf):
    found = QUERIES["op11_embedding_whitening"](spark, f"/root/testdata/sf{sf}")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding")
    compare(found, [tuple(r) for r in table.collect()])
