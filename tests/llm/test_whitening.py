"""Whitening: spectra by FEAST against dense solvers, exact deviations, odd vectors."""

import math

import numpy as np
import pytest

from tracewright.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def spectra(d, rng):
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    yield rng.uniform(0, 1, d), q
    yield np.ones(d), q
    yield np.r_[[1e6], np.ones(d - 1)], q
    yield 10.0 ** -np.arange(d), q
    yield np.r_[[3.0], np.zeros(d - 1)], q
    yield np.r_[np.full(min(d, 10), 5.0), np.ones(max(0, d - 10))], q
    yield np.zeros(d), q


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_components_and_inertia(d):
    rng = np.random.default_rng(d)
    for w, q in spectra(d, rng):
        a = (q * w) @ q.T
        a = (a + a.T) / 2
        w = np.sort(w)[::-1]
        for s in (0.4, 0.9, 2.0):
            assert W.above(a, s) == (w > s).sum()
        e, u = W.leading(a, 8)
        assert len(e) == min(8, (w > d * 1e-14 * max(w[0], 1e-300)).sum())
        scale = max(w[0], 1e-300)
        assert np.abs(e - w[: len(e)]).max(initial=0) <= 1e-13 * scale
        assert np.linalg.norm(a @ u - u * e, axis=0).max(initial=0) <= 1e-12 * scale
        assert np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-13


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(5)
    for n in range(1, 30):
        a = rng.standard_normal((n, n)) * rng.integers(0, 2, (n, n))
        a = np.triu(a, 1) + np.triu(a, 1).T
        w = np.linalg.eigvalsh(a)
        assert W.above(a, 0.123) == (w > 0.123).sum()


def brute(rows, count=8):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    m = np.array([[(n * v[k] - s[k]) / n for k in range(d)] for _, v in x])
    v = m.T @ m / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return n, [sum((n * v[k] - s[k]) ** 2 for k in range(d)) for _, v in x], m @ u / np.sqrt(e), e / v.trace()


def test_digest(spark):
    rng = np.random.default_rng(1)
    good = [(k if k % 9 else 3, (rng.standard_normal(12) * np.arange(1, 13) + 7).tolist()) for k in range(200)]
    good += [(None, [0.5] * 12), (2**60 + 1, [1.0] * 12), (2**60 + 1, [1.0] * 12)]
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [None] * 12), (5, [float("nan")] + [1.0] * 11), (6, [float("inf")] * 12), (7, [3e38] * 12)]
    frame = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "1 as x", "2 as n", "3 as component").repartition(3)
    got = W.digest(frame).collect()
    n, deviation, white, explained = brute(good)
    assert len(got) == 8 * n == 8 * len(good) and {r["n"] for r in got} == {n}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, v) for (i, _), v in zip(good, deviation)}
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append((r["vec_id"] or -1, r["deviation"], r["whitened"]))
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-10
    for k in range(8):
        want = sorted((i or -1, v, y) for (i, _), v, y in zip(good, deviation, white[:, k]))
        mine = sorted(by[k + 1])
        sign = np.sign(np.dot([a[2] for a in want], [a[2] for a in mine]))
        assert np.abs(np.array([a[2] for a in want]) - sign * np.array([a[2] for a in mine])).max() < 1e-9


def test_cases_without_components(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert W.digest(frame([(1, [1.0])]).where("false")).count() == 0
    assert W.digest(frame([(1, None), (2, [])])).count() == 0
    assert W.digest(frame([(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    line = W.digest(frame([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 5 and abs(line[0]["explained"] - 1) < 1e-12
    tie = W.digest(frame([(k, [float(k), 1.0]) for k in range(3)] + [(k, [1.0 * k]) for k in range(3)])).collect()
    assert len(tie) == 3


def test_deviation_beyond_a_long():
    far = W.Fit(4, [0, 4], np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[1 << 40, 1], [-(1 << 40), 1], [3, 1]], dtype=np.int64)
    assert far.deviations(x) == [None, None, 144]
    assert far.deviations(x[2:]) == [144]
