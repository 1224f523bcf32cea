"""Whitening against numpy's own decomposition of the whole covariance."""

import math

import numpy as np
import pytest

from sparkprof.llm import whitening
from sparkprof.llm.queries import QUERIES


def quantized(rows):
    return np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows], dtype=np.int64)


def check(found, ids, x, components, order=None):
    """Every column of the result, by brute force."""
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    deviation = {}
    for i, row in zip(ids, x.tolist()):
        deviation[i] = sum((n * a - int(s)) ** 2 for a, s in zip(row, sums.tolist()))
    assert len(found) == n * components
    given = np.zeros((n, components))
    at = {i: k for k, i in enumerate(ids)}
    for r in found:
        given[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["deviation_wide"] is None
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(covariance)) - 1) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9
    expected = centred @ directions[:, :components] / np.sqrt(values[:components])
    sign = np.sign((given * expected).sum(axis=0))
    assert np.abs(given - expected * sign).max() < 1e-8


def test_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    result = QUERIES["op13_whitening"][0](spark, small)
    assert result.columns[:3] == ["vec_id", "component", "n"]
    check(result.collect(), [r["vec_id"] for r in rows], quantized([r["embedding"] for r in rows]), 8)


def test_odd_rows(spark):
    """Nulls, holes, other lengths, clashing names; ties between eigenvalues do not matter to the identity."""
    random = np.random.default_rng(3)
    sound = random.standard_normal((40, 5)) * [5, 4, 3, 2, 1]
    rows = [(i, v.tolist(), 1, "a") for i, v in enumerate(sound)]
    odd = [(100, None, 1, "a"), (101, [1.0, None, 1.0, 1.0, 1.0], 1, "a"), (102, [float("nan")] * 5, 1, "a"),
           (103, [float("inf")] * 5, 1, "a"), (104, [], 1, "a"), (105, [1.0, 2.0], 1, "a")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x int, place string")
    check(whitening.whiten(frame, 3).collect(), range(40), quantized(sound), 3)
    # Every row counts: repeated rows and null ids too.
    twice = frame.unionByName(frame).unionByName(frame.filter("vec_id = 0").selectExpr("cast(null as long) vec_id", "embedding", "x", "place"))
    result = whitening.whiten(twice, 3).collect()
    assert len(result) == 81 * 3 and {r["n"] for r in result} == {81}
    assert sum(r["vec_id"] is None for r in result) == 3
    equal = {}
    for r in result:
        equal.setdefault((r["vec_id"], r["component"]), set()).add(r["whitened"])
    assert all(len(v) == 1 for v in equal.values())


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, [None]]])
def test_no_variance_gives_no_rows(spark, vectors):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert whitening.whiten(frame).collect() == []


def test_fewer_dimensions_than_components(spark):
    """Two dimensions, of which one is constant: one component."""
    frame = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(10)], "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert len(found) == 10 and all(r["component"] == 1 and abs(r["explained"] - 1) < 1e-12 for r in found)


def test_large_numbers(spark):
    """Sums beyond a long stay exact; what does not fit a long is in the wide column."""
    values = [[1e30, 0.0], [-1e30, 1.0], [1e12, 2.0], [3.0, 5.0]]
    frame = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    ends = [max(-(1 << 60), min(1 << 60, math.floor(1024 * v[0]))) + 100_000 for v in values]
    others = [math.floor(1024 * v[1]) + 100_000 for v in values]
    for r in whitening.whiten(frame, 1).collect():
        i = r["vec_id"]
        exact = (4 * ends[i] - sum(ends)) ** 2 + (4 * others[i] - sum(others)) ** 2
        assert r["deviation"] is None and r["deviation_wide"] == (exact if exact < 10**38 else None)


@pytest.mark.parametrize("size", [1, 2, 9, 60])
def test_eigenpairs_of_close_and_repeated_values(size):
    """Clusters of equal eigenvalues: the vectors span the right space, orthonormal to rounding."""
    random = np.random.default_rng(size)
    basis = np.linalg.qr(random.standard_normal((size, size)))[0]
    spectrum = np.sort(np.round(random.uniform(1, 5, size)) + 1e-6 * random.integers(0, 2, size))[::-1]
    matrix = basis * spectrum @ basis.T
    values, vectors = whitening.eigenpairs(lambda b: matrix @ b, size, 6)
    k = min(6, size)
    assert np.abs(values - spectrum[:k]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-11
