"""Whitened embeddings against a library's eigenvectors over exact integers, and the spectrum of awkward matrices."""

import math
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import queries, spectrum, whitening


def matrices():
    rnd = np.random.default_rng(1)
    q = np.linalg.qr(rnd.standard_normal((30, 30)))[0]
    yield from (m @ m.T for m in rnd.standard_normal((6, 20, 20)))
    for values in ([5.0] * 4 + [3.0] * 3 + [1.0] * 23, np.linspace(9, 1, 30), 10.0 ** -np.arange(30), [7.0, 7.0 - 1e-9, *np.arange(28) / 30],
                   [1.0] * 30, [2.0] + [0.0] * 29):
        yield (q * np.array(values)) @ q.T
    yield np.diag([4.0, -3.0, 2.0, 0.0, 2.0])
    yield np.array([[0.0, 1.0], [1.0, 0.0]])
    yield np.zeros((3, 3))
    yield np.array([[5.0]])


@pytest.mark.parametrize("matrix", list(matrices()))
def test_leading_eigenvalues_and_vectors(matrix):
    values, vectors = spectrum.leading(matrix, 8)
    want = np.sort(np.linalg.eigvalsh((matrix + matrix.T) / 2))[::-1][:8]
    scale = np.abs(matrix).sum(axis=1).max() or 1.0
    assert np.allclose(values, want, atol=1e-13 * scale, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() <= 1e-13 * scale


@pytest.mark.parametrize("matrix", list(matrices()))
def test_counts_are_those_of_the_eigenvalues(matrix):
    values = np.linalg.eigvalsh(matrix)
    for a, b in zip(values, values[1:]):
        if b - a > 1e-8:
            assert spectrum.count_above(matrix, (a + b) / 2) == (values > (a + b) / 2).sum()


def expected(vectors):
    """By library: exact deviations, and whitened values up to sign."""
    length = max(Counter(map(len, vectors)).items(), key=lambda x: (x[1], x[0]))[0]
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors if len(v) == length]
    n, total = len(x), [sum(col) for col in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, total)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, total)] for v in x])
    covariance = centred.T @ centred / n
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1][:8], found[:, ::-1][:, :8]
    return n, deviations, centred @ (found / np.sqrt(values)), values / np.trace(covariance)


def check(rows, ids, vectors):
    n, deviations, white, explained = expected(vectors)
    k = white.shape[1]
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error <= 1e-4
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert sorted(got) == sorted(set(zip(ids, deviations)))
    for j in range(k):
        signs = set()
        for i, vec_id in enumerate(ids):
            r = got[vec_id, deviations[i]][j + 1]
            assert r.explained == pytest.approx(explained[j], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(white[i, j]), abs=1e-7)
            if abs(white[i, j]) > 1e-3:
                signs.add(r.whitened * white[i, j] > 0)
        assert len(signs) == 1


def test_query_matches_the_library(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    known = table.collect()
    got = queries.op11_embedding_whitening(spark, sf_dir)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    check(got.collect(), [r.vec_id for r in known], [r.embedding for r in known])
    table.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_embedding_whitening(spark, str(tmp_path)).collect() == []


def test_awkward_vectors_are_left_out(spark):
    rnd = np.random.default_rng(5)
    good = [(i, v.tolist()) for i, v in enumerate(rnd.standard_normal((60, 3)) * [5, 2, 1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 1.0, 2.0]), (105, [1.0, 2.0]), (106, [1e30, 1.0, 1.0])]
    rows = [("x", v, i, 1) for i, v in [*good, *bad, good[3]]]
    table = spark.createDataFrame(rows, "n string, embedding array<double>, vec_id long, component int").repartition(4)
    found = whitening.whiten(spark, table).collect()
    kept = [*good, good[3]]
    assert Counter(r.vec_id for r in found) == Counter({i: 3 * c for i, c in Counter(i for i, _ in kept).items()})
    unique = {(r.vec_id, r.component): r for r in found}
    n, deviations, white, _ = expected([v for _, v in kept])
    for i, (vec_id, _) in enumerate(kept):
        for j in range(3):
            assert unique[vec_id, j + 1].deviation == deviations[i]
            assert abs(unique[vec_id, j + 1].whitened) == pytest.approx(abs(white[i, j]), abs=1e-7)


def test_components_without_variance_are_left_out(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(spark, same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(spark, line).collect()} == {1}


def test_a_deviation_beyond_long_is_null(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 2.0 ** 39, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(spark, rows).collect()} == {None}
