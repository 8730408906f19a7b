"""Whitening against covariances of exact fractions and a plain product of centred vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from geoloom.llm.whitening import components, covariance, whitened

SCHEMA = "vec_id long, embedding array<float>, x string, n long, component string"


def plain(rows, most):
    """{row: (component, n, deviation, whitened up to sign, explained)} by fractions and eigh."""
    sound = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for k, v in sound]
    fit = list({x for _, x in xs})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(width)]
    centred = [[Fraction(n * x[i] - sums[i], n) for i in range(width)] for x in fit]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(width)] for i in range(width)])
    values, vectors = components(v, most)
    out = []
    for k, x in xs:
        d = [n * x[i] - sums[i] for i in range(width)]
        w = np.array([float(Fraction(e, n)) for e in d]) @ vectors / np.sqrt(values)
        out += [(k, j + 1, n, sum(e * e for e in d), w[j], values[j] / np.trace(v)) for j in range(len(values))]
    return out, v


def some_rows(seed, n, width):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(j, 1 + j % 3) / 20 + (k := draw.gauss(0, 1)) * 0 + 0.01 * j * k for j in range(width)]) for i in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, rows[0][1]), (None, rows[1][1]), (3, rows[2][1]), (n + 2, None), (n + 3, [float("nan")] * width),
                   (n + 4, [float("inf")] + [0.0] * (width - 1)), (n + 5, [None] + [0.0] * (width - 1)), (n + 6, []), (n + 7, [1.0])]


@pytest.mark.parametrize("width", [3, 20])
def test_whitened_equals_plain(spark, width):
    rows = some_rows(width, 60, width)
    df = spark.createDataFrame([(k, v, "clash", 5, "c") for k, v in rows], SCHEMA).repartition(4)
    want, v = plain([r for r in rows if r[1] is None or len(r[1]) == width], 16)
    got = [tuple(r)[:6] for r in whitened(df).collect()]
    errors = {r.identity_error for r in whitened(df).collect()}
    key = lambda r: (str(r[0]), r[1], r[3], round(r[4], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert max(errors) < 1e-9
    assert {g[1] for g in got} == set(range(1, min(16, width) + 1))


def test_polarisation_is_exact():
    draw = random.Random(3)
    ys = [[draw.randrange(-90, 90) for _ in range(6)] for _ in range(500)]
    squares = {(i, j): sum((y[i] + (y[j] if i != j else 0)) ** 2 for y in ys) for i in range(6) for j in range(i, 6)}
    rest, n = [sum(y[i] for y in ys) for i in range(6)], len(ys)
    want = [[float(sum(Fraction((n * y[i] - rest[i]) * (n * y[j] - rest[j]), n * n) for y in ys) / n) for j in range(6)] for i in range(6)]
    assert covariance(squares, n, rest).tolist() == want


def test_too_few_and_too_large(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [0.5, 0.25], "", 0, "")] * 3, SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [], "", 0, "")], SCHEMA)).count() == 0
    two = whitened(spark.createDataFrame([(1, [0.5, 0.25], "", 0, ""), (2, [0.0, 0.25], "", 0, "")], SCHEMA)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 12), r.explained) for r in two] == [(1, 1, 2, 1024, 1.0, 1.0), (2, 1, 2, 1024, -1.0, 1.0)]
    far = whitened(spark.createDataFrame([(1, [1e30, 0.0], "", 0, ""), (2, [-3.0, 4.0], "", 0, ""), (3, [7.0, 1.0], "", 0, "")], SCHEMA)).collect()
    assert {r.component for r in far} == {1} and all(r.deviation is None for r in far)
    with_large = whitened(spark.createDataFrame([(1, [2e6, 0.0], "", 0, ""), (2, [-3.0, 4.0], "", 0, ""), (3, [7.0, 1.0], "", 0, "")], SCHEMA)).collect()
    x = [(128000000, 0), (-192, 256), (448, 64)]
    s = [sum(v) for v in zip(*x)]
    assert {(r.vec_id, r.deviation) for r in with_large} == {(k + 1, sum((3 * v - t) ** 2 for v, t in zip(x[k], s))) for k in range(3)}
