"""Windows from running sums, and selection under false-discovery control."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import cointegration, solvers

DAY0 = dt.date(2020, 1, 1)


def pair(n, seed, bound=True):
    rng = np.random.default_rng(seed)
    b = 4 + np.cumsum(rng.normal(0, 0.01, n))
    own = rng.normal(0, 0.01, n) if bound else np.cumsum(rng.normal(0, 0.01, n))
    return 1 + 0.7 * b + own, b


def rows_of(name, a, b):
    return [(name, "q", DAY0 + dt.timedelta(days=i), None if np.isnan(x) else float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]


KINDS = "a string, b string, date date, la double, lb double"


def test_windows_equal_plain_regressions():
    for seed, bound in ((1, True), (2, False)):
        a, b = pair(700, seed, bound)
        lo = np.array([0, 13, 200, 0, 448])
        hi = np.array([252, 265, 452, 700, 700])
        got = cointegration.taus(a, b, lo, hi)
        assert got == pytest.approx([solvers.engle_granger(a[s:e], b[s:e])[0] for s, e in zip(lo, hi, strict=True)], rel=1e-6)


def test_fixed_lags_equal_least_squares():
    a, b = pair(200, 3)
    for lags in (0, 1, 4):
        x = np.column_stack([b[20:150], np.ones(130)])
        e = a[20:150] - x @ np.linalg.lstsq(x, a[20:150], rcond=None)[0]
        de = np.diff(e)
        x, y = np.column_stack([e[lags:-1], *(de[lags - i : len(de) - i] for i in range(1, lags + 1))]), de[lags:]
        q = np.linalg.lstsq(x, y, rcond=None)[0]
        se = np.sqrt(((y - x @ q) ** 2).sum() / (len(y) - lags - 1) * np.linalg.inv(x.T @ x)[0, 0])
        assert cointegration.taus(a, b, np.array([20]), np.array([150]), lags)[0] == pytest.approx(q[0] / se, rel=1e-7)


def test_degenerate_windows():
    n = 120
    flat = cointegration.taus(np.ones(n), np.arange(n) * 1.0, np.array([0]), np.array([n]))
    same = cointegration.taus(np.arange(n) * 2.0, np.arange(n) * 1.0, np.array([0]), np.array([n]))
    assert all(np.isnan(t[0]) or np.isfinite(t[0]) for t in (flat, same))
    assert len(cointegration.taus(np.ones(n), np.ones(n), np.empty(0, int), np.empty(0, int))) == 0


def test_rolling_and_folds(spark):
    a, b = pair(400, 4)
    a[50] = np.nan
    df = spark.createDataFrame(rows_of("p", a, b), KINDS)
    got = {r.date: (r.n, r.tau, r.p) for r in cointegration.rolling(df, 150, 50).collect()}
    assert sorted(got) == [DAY0 + dt.timedelta(days=k) for k in (250, 300, 350)]  # earlier windows hold the gap
    tau, p = solvers.engle_granger(a[100:250], b[100:250])
    assert got[DAY0 + dt.timedelta(days=250)] == (150, pytest.approx(tau, rel=1e-6), pytest.approx(p, abs=1e-6))
    folds = spark.createDataFrame([(0, DAY0 + dt.timedelta(days=199)), (1, DAY0 + dt.timedelta(days=299)), (2, DAY0 + dt.timedelta(days=5))], "fold int, fit_end date")
    known = {r.fold: (r.n, r.tau) for r in cointegration.by_fold(df, folds, 100).collect()}
    keep = ~np.isnan(a)
    for fold, end in ((0, 200), (1, 300)):
        on = np.flatnonzero(keep[:end])
        assert known[fold] == (end - 1, pytest.approx(solvers.engle_granger(a[on], b[on])[0], rel=1e-6))
    assert set(known) == {0, 1}


def test_planted_pairs_survive_and_others_do_not(spark):
    rows = []
    for k in range(8):
        rows += rows_of(f"{'bound' if k < 2 else 'free'}{k}", *pair(400, 30 + k, k < 2))
    df = spark.createDataFrame(rows, KINDS)
    found = solvers.cointegration(df, "a", "b", least=252)
    best = cointegration.best_pairs(found, 0.10).collect()
    assert len(best) == 1 and best[0].a.startswith("bound") and best[0].q <= 0.10
    assert cointegration.best_pairs(found.where("a LIKE 'free%'").where("p > 0.2"), 0.10).count() == 0
    folds = spark.createDataFrame([(0, DAY0 + dt.timedelta(days=300)), (1, DAY0 + dt.timedelta(days=399))], "fold int, fit_end date")
    chosen = {r.fold: r.a for r in cointegration.best_pairs(cointegration.by_fold(df, folds, 252), 0.10, "fold").collect()}
    assert set(chosen) == {0, 1} and all(v.startswith("bound") for v in chosen.values())
